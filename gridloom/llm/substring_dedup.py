"""Repeated word windows by level-wise doubling.

Level 1 takes windows of half the length (25 words). Of each run of 26 neighbouring half windows only the one of least hash is
kept: any 50 words contain such a run, so equal 50-word windows keep the same one. Half windows that occur in one document
alone fall. Level 2 takes the windows of twice that length whose kept half window survived; the least doc_id of each
decides which words go. From there two survivors that stand end to end make a window of twice the length, level after level,
until no window survives; the last length at which a document has one is its longest_repeat.

Exact copies of a text with a smaller doc_id need no windows: all their windows start there, too. Every shuffle carries hashes
and numbers; texts move by doc_id where candidates meet them and where the result is made. Surviving hashes are a table of
their own, so a hash that a third of all documents hold is split by the adaptive skew join.

Defined cases: null and empty texts have no words; texts under 50 words lose nothing; a document doesn't repeat itself;
equal doc_ids aren't smaller than each other; null doc_ids neither remove nor lose words; equal rows each give a row.
Words go where two windows have the same two 64-bit hashes, made apart; single words are told apart by 64 bits. A worker holds
one Arrow batch (16 MB of texts or one text) and some 300 bytes a word of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordHashes, bounded_batches, discard, windows, written

LENGTH = 50

_WORDS: dict[str, WordHashes] = {}


def _hashes(text: str | None) -> np.ndarray:
    return _WORDS.setdefault("words", WordHashes()).of(text)


def selected(half: np.ndarray, run: int) -> np.ndarray:
    """For each run of neighbouring half windows the place of its least hash, the leftmost of equals."""
    view = np.lib.stride_tricks.sliding_window_view(half, run)
    out = np.empty(len(view), np.int64)
    for a in range(0, len(view), 65536):  # bounded memory on long texts
        out[a : a + 65536] = view[a : a + 65536].argmin(axis=1)
    return out + np.arange(len(view))


def _halves(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the half windows, and the selected place for each whole window."""
    half = windows(h, length // 2)
    return half, selected(half, length - length // 2 + 1)


def first_level(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key, n_words, places and hashes of the kept half windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places, hashes = [], [], []
            for t in b.column("text").to_pylist():
                h = _hashes(t)
                n.append(len(h))
                if len(h) < length:
                    at, own = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                else:
                    half, pick = _halves(h, length)
                    at = np.unique(pick)
                    own = half[at]
                places.append(at.astype(np.int32).tolist())
                hashes.append(own.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_words", "places", "hashes"],
            )

    return docs.mapInArrow(run, "doc_id bigint, key binary, n_words bigint, places array<int>, hashes array<bigint>")


def second_level(candidates: DataFrame, length: int) -> DataFrame:
    """doc_id, key, at, hash, check of the whole windows whose kept half window is among the surviving places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, key, t, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "places")), strict=True):
                h = _hashes(t)
                if len(h) < length:
                    continue
                _, pick = _halves(h, length)
                at = np.flatnonzero(np.isin(pick, np.array(places, np.int64)))
                whole, check = (windows(x, length)[at].view(np.int64) for x in (h, ~h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(at), pa.int64()), pa.array([key] * len(at), pa.binary()), pa.array(at.astype(np.int32), pa.int32()), pa.array(whole, pa.int64()), pa.array(check, pa.int64())],
                    ["doc_id", "key", "at", "hash", "check"],
                )

    return candidates.mapInArrow(run, "doc_id bigint, key binary, at int, hash bigint, check bigint")


def _shared(found: DataFrame) -> DataFrame:
    """hash, check, least of the windows that occur in several documents."""
    return found.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash", "check", "least")


def longest_repeats(found: DataFrame, length: int) -> DataFrame:
    """doc_id, key, longest: doubles the repeated windows (doc_id, key, at, hash, check) of a length until none survives."""
    spark = found.sparkSession
    levels: list[tuple[DataFrame, str]] = []
    found, path = written(found.select("doc_id", "key", "at", "hash", "check").distinct(), "level")
    while found.limit(1).count():
        levels.append(written(found.select("doc_id", "key").distinct().withColumn("longest", F.lit(length).cast("bigint")), "longest"))
        second = found.select("doc_id", "key", (F.col("at") - length).alias("at"), F.col("hash").alias("h"), F.col("check").alias("c"))
        both = found.join(second, ["doc_id", "key", "at"]).select("doc_id", "key", "at", F.xxhash64("hash", "h").alias("hash"), F.xxhash64("c", "check").alias("check"))
        double, double_path = written(both, "double")
        shared, shared_path = written(_shared(double), "shared")
        found, fresh = written(double.join(shared, ["hash", "check"]).select("doc_id", "key", "at", "hash", "check"), "level")
        discard(spark, path, double_path, shared_path)
        path = fresh
        length *= 2
    if not levels:
        discard(spark, path)
        return found.select("doc_id", "key", F.lit(0).cast("bigint").alias("longest")).limit(0)
    every = levels[0][0]
    for level, _ in levels[1:]:
        every = every.union(level)
    out, _ = written(every.groupBy("doc_id", "key").agg(F.max("longest").alias("longest")), "repeats")
    discard(spark, path, *[p for _, p in levels])
    return out


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, starts (windows to remove), copy (all windows go), longest of the documents that have repeated windows. A table in the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = _keyed(docs).filter("doc_id is not null")
    first, first_path = written(first_level(own, length), "first")
    least = first.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key", "least")
    marked = first.join(least, "key", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    marked, marked_path = written(marked.withColumn("twin", F.col("least").isNotNull()).drop("least"), "marked")
    discard(spark, first_path)
    twins = marked.filter(F.col("twin") & (F.col("n_words") >= length)).select("doc_id", "key", "n_words", "copy").distinct()
    halves = marked.filter("not copy").select("doc_id", "key", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("doc_id", "key", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    shared, shared_path = written(halves.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("hash"), "shared")
    alive = halves.join(shared, "hash").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    candidates = own.join(alive, ["doc_id", "key"])
    whole, whole_path = written(second_level(candidates.select("doc_id", "key", "text", "places"), length), "windows")
    owners, owners_path = written(_shared(whole), "owners")
    kept, kept_path = written(whole.join(owners, ["hash", "check"]), "repeated")
    discard(spark, shared_path, whole_path, owners_path)
    gone = kept.filter("doc_id > least").groupBy("doc_id", "key").agg(F.collect_set("at").alias("starts"))
    whole_length = (length * F.pow(F.lit(2), F.floor(F.log2(F.col("n_words") / length)))).cast("bigint")  # a text with copies repeats whole
    twins = twins.select("doc_id", "key", "copy", whole_length.alias("own"))
    both = longest_repeats(kept, length).join(gone, ["doc_id", "key"], "left").join(twins, ["doc_id", "key"], "full")
    both = both.select("doc_id", "key", "starts", F.coalesce("copy", F.lit(False)).alias("copy"), F.greatest("longest", "own").alias("longest"))
    out, _ = written(both, "gone")
    discard(spark, kept_path, marked_path)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def kept_words(text: str, starts: list[int] | None, copy: bool | None, length: int) -> tuple[int, list[bytes]]:
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if copy and n >= length:
        return n, []
    if not starts:
        return n, words
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    keep = np.cumsum(edge[:n]) == 0
    return n, [words[i] for i in np.flatnonzero(keep).tolist()]


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, longest_repeat, kept (the words that stay, joined by one space) for each row of docs."""
    return _result(docs, length, lambda kept: kept.decode("utf-8", "replace"), "kept string", pa.string())


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, longest_repeat, kept_sha256 for each row of docs."""
    return _result(docs, length, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string", pa.string())


def _result(docs: DataFrame, length: int, last, column: str, kind: pa.DataType) -> DataFrame:
    joined = _keyed(docs).join(repeated(docs, length), ["doc_id", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [kept_words(t, s, c, length) for t, s, c in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "copy")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()), b.column("longest"), pa.array([last(b" ".join(k)) for _, k in rows], kind)],
                ["doc_id", "n_words", "n_removed", "longest_repeat", column.split()[0]],
            )

    joined = joined.select("doc_id", "text", "starts", "copy", F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"))
    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, longest_repeat bigint, {column}")
