"""Quality by a log-likelihood ratio of hashed word n-grams, in DataFrame operations only.

Single words and word pairs are hashed into `buckets` buckets. Two multinomials over the buckets, one of the trusted target
(documents labelled good) and one of the whole raw corpus, give each bucket a log ratio; a document's score is the mean of the
ratios of its n-grams, so it doesn't depend on length. Every document is held against the same threshold.

The statistics are one aggregation with partial sums (at most `buckets` rows leave a task) and come to the driver as one
array of that fixed size; scoring is a projection without shuffle.

Defined cases: null and empty texts have no words, score 0 and fail the base rules; without any target document all ratios
are 0; equal rows each give a row; several labels of a document count as target if one is good; null doc_ids have no label.
A text's words and hashes are arrays in one row: some 150 bytes a word of the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let

#: White space between words; characters that count as symbols.
GAP = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Params:
    """threshold: least mean log ratio of a kept document; broadcast_ids: most target ids that are sent to all executors (some 20 MB)."""

    buckets: int = 10_000
    smoothing: float = 1.0
    threshold: float = -0.05
    broadcast_ids: int = 500_000


def _shifted(a: Column, b: Column, by: int) -> Column:
    """Hashes of a[i] and b[i + by], for each i that has both."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(b) - by, F.lit(0))), F.slice(b, F.lit(by + 1), F.greatest(F.size(b) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _hashed(own: DataFrame, *more: str) -> DataFrame:
    """Hashes of the words (h) and of neighbouring pairs (p) of own (doc_id, text, ...), and what is asked for besides: its columns, word_chars."""
    own = own.withColumn("words", F.array_remove(F.split("text", GAP, -1), ""))
    own = own.withColumns({"h": F.transform("words", lambda w: F.xxhash64(w)), "word_chars": F.length(F.array_join("words", "")).cast("bigint")})
    return own.select("h", _shifted(F.col("h"), F.col("h"), 1).alias("p"), *more)


def target_ids(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))


def log_ratios(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> list[float]:
    """log(target probability / raw probability) of each bucket, over all documents."""
    ids = target_ids(labels)
    if ids.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids:  # else texts are shuffled once, by doc_id
        ids = F.broadcast(ids)
    grams = _hashed(_own(docs).join(ids, "doc_id", "left"), "target").select("target", F.explode(F.concat("h", "p")).alias("g"))
    by_bucket = grams.groupBy(F.pmod("g", F.lit(p.buckets)).cast("int").alias("b"))
    rows = by_bucket.agg(F.count("*").alias("raw"), F.count("target").alias("target")).collect()  # at most p.buckets rows
    raw, target = [0] * p.buckets, [0] * p.buckets
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * p.buckets
    import math

    base = math.log((sum(raw) + p.smoothing * p.buckets) / (sum(target) + p.smoothing * p.buckets))
    return [base + math.log((t + p.smoothing) / (r + p.smoothing)) for t, r in zip(target, raw, strict=True)]


def repeated_words(h: Column, p: Column) -> Column:
    """How many words stand in a window of WINDOW words that occurs twice or more; h and p as _hashed() gives them.

    Windows are hashed by doubling: pairs, fours, fives. Only where two windows are equal they are sorted with their places;
    neighbours with equal hashes give the repeated places, and the sorted places the covered words: n log n steps for any text.
    """
    hashes = _shifted(_shifted(p, p, 2), h, 4)

    def covered(own: Column) -> Column:
        pairs = F.sort_array(F.transform(own, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = let(
            pairs,
            lambda s: F.sort_array(
                F.filter(
                    F.transform(s, lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"])),
                    lambda x: x.isNotNull(),
                )
            ),
        )
        steps = let(places, lambda q: F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(h) > WINDOW, let(hashes, lambda own: F.when(F.size(F.array_distinct(own)) < F.size(own), covered(own)).otherwise(0))).otherwise(0)


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs."""
    ratios = F.split(F.lit(",".join(repr(x) for x in log_ratios(docs, labels, p))), ",").cast("array<double>")  # folded to one literal
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    add = lambda a, x: a + F.get(ratios, F.pmod(x, F.lit(p.buckets)).cast("int"))
    some = F.contains("text", F.lit(SYMBOLS[1]))
    for c in SYMBOLS[2:-1]:
        some = some | F.contains("text", F.lit(c))
    counted = _hashed(_own(docs), "doc_id", "text", "word_chars").select(
        "doc_id",
        "word_chars",
        F.when(some, F.regexp_count("text", F.lit(SYMBOLS))).otherwise(0).cast("bigint").alias("n_symbols"),
        F.when(F.contains("text", F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("bigint").alias("n_dup_lines"),
        F.size("h").cast("bigint").alias("n_words"),
        repeated_words(F.col("h"), F.col("p")).cast("bigint").alias("n_repeat_words"),
        (F.aggregate("h", F.lit(0.0), add) + F.aggregate("p", F.lit(0.0), add)).alias("total"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    mean = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1)).otherwise(0.0)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (mean >= p.threshold)).alias("kept"), mean.alias("score")
    )
