"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

A file holds consecutive documents in ascending doc_id order. Ids are replaced by their frequency rank over the whole corpus
(frequent ids get small ranks, ties by id), and each rank takes 1 to 4 bytes. Two bits a rank give its length; the bits of
four ranks make one control byte. All control bytes stand together, before all data bytes, so a file is decoded by
numpy look-ups: a table of 256 rows gives the four lengths of each control byte.

File layout, little-endian: magic, version, number of documents, number of ids (u8 x 4), then doc_id (i8) and count (u4) of
each document, a byte for each document that tells if its doc_id is null, the control bytes and the data bytes. The rank
table is a file of its own, rank.u4. Files are written and read by pyarrow's file systems: the shared folder must be one that
these reach (a mounted one, or hdfs with libhdfs).

Defined cases: null and empty texts are the end id alone; null doc_ids come first; rows with equal doc_ids stand side by
side, ordered by their ids' bytes; an empty table gives no data file. A worker holds one Arrow batch (16 MB of texts or one
text), the ids of `kept` chunks, and when files are made the ids of one file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, discard, work_path, written

MAGIC, VERSION = 0x4B4F544C, 1
END_ID = 1
#: Ids in one file, about; a file is decoded as a whole.
FILE_IDS = 4_000_000
FILES = pa.schema({"file": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()})
#: The white space of the tokenizer's \s; Python's split() has four control characters besides.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = "\x1c\x1d\x1e\x1f"
#: ASCII marks; without the apostrophe, which may belong to the letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where lower case is the tokenizer's own."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def stays_letters(chunk: str) -> bool:
    """Whether a chunk of letters is of letters alone when it is normalised, too."""
    return normalize("NFC", chunk).lower().isalpha()


def _control_table() -> np.ndarray:
    """Row c: the byte lengths of the four ranks under control byte c."""
    c = np.arange(256)[:, None]
    return (c >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


LENGTHS = _control_table()


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of n entries, by look-ups in LENGTHS."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


#: The normalizer and pre-tokenizer under which chunks between white space can be encoded apart.
APART = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def encodes_apart(library) -> bool:
    """Whether a tokenizer normalises and splits texts as APART says; under any other one whole texts go to the library."""
    spec = json.loads(library.to_str())
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return [x["type"] for x in parts] == APART[0] and parts[1]["pattern"] == {"Regex": "\\s+"} and splits[0].get("pattern") == {"Regex": APART[1]} and spec["model"].get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """Ids of whole texts by the tokenizers library; each chunk between white space is encoded once while there is room for it."""

    def __init__(self, path: str, kept: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.apart = encodes_apart(self.library)
        # the same model for words of letters between single blanks, which need no regex to be told apart
        self.plain = Tokenizer(self.library.model)
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = kind_of(self.library.get_vocab_size())
        self.ids: dict[str, bytes] = {"": b""}
        self.kept = kept
        self.mark_id, self.mark = max(((i, t.content) for i, t in self.library.get_added_tokens_decoder().items()), default=(0, ""))
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str | None]) -> pa.BinaryArray:
        """Packed ids with the end id, for each text. Arrow numbers the chunks of all texts, so Python sees each distinct one once."""
        if not self.apart:
            return pa.array([np.array([*self.library.encode(t or "", add_special_tokens=False).ids, END_ID], self.kind).tobytes() for t in texts], pa.binary())
        split = self.chunks([t or "" for t in texts])
        coded = split.values.dictionary_encode()
        found = self.of(coded.dictionary.to_pylist())
        found.append(END_ID.to_bytes(self.kind.itemsize, "little"))
        ends = split.offsets.to_numpy()[1:]
        at = np.insert(coded.indices.to_numpy(), ends, len(found) - 1)
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        each = size[at]
        stop = np.cumsum(each, dtype=np.int32)
        shift = (np.cumsum(size, dtype=np.int32) - size)[at] - (stop - each)
        ids = np.frombuffer(b"".join(found), self.kind).take(np.arange(stop[-1], dtype=np.int32) + np.repeat(shift, each))
        offsets = np.concatenate(([0], self.kind.itemsize * stop[ends + np.arange(len(ends))])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    @staticmethod
    def chunks(texts: list[str]) -> pa.ListArray:
        """The parts between white space; lower case already where that is the same as the tokenizer's own."""
        if any(c in t for t in texts for c in ODD):
            return pa.array([SPACE.split(t) for t in texts], pa.list_(pa.string()))
        return pc.utf8_split_whitespace(pa.array([t.lower() if latin(t) else t for t in texts], pa.string()))

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. Marks after letters are words of their own, so letters and marks are looked up apart."""
        known = self.ids
        out = list(map(known.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        words, rest, cut = set(), set(), []
        for i in new:
            w = chunks[i]
            letters = w.rstrip(MARKS)
            if letters.isalpha() and (letters.isascii() or stays_letters(letters)):
                words.add(letters)
                if len(letters) < len(w):
                    marks = w[len(letters) :]
                    rest.add(marks)
                    cut.append((w, letters, marks))
            else:
                rest.add(w)
        own = self.library_ids(list(words.difference(known)), list(rest.difference(known)))
        for w, letters, marks in cut:
            own[w] = (known.get(letters) or own[letters]) + (known.get(marks) or own[marks])
        for i in new:
            out[i] = own[chunks[i]]
        if len(known) < self.kept:
            known.update(islice(((w, x) for w, x in own.items() if len(w) < 48), self.kept - len(known)))
        return out

    def library_ids(self, words: list[str], rest: list[str]) -> dict[str, bytes]:
        """Two calls for many chunks. A chunk of letters is one word, whose last token alone is marked as a word's end; between the others stands the end-of-text token; chunks that may hold a special token go alone."""
        own = {w: np.array(self.library.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in rest if "<|" in w}
        for group, mark, library in ((words, " ", self.plain), ([w for w in rest if "<|" not in w], self.mark, self.library)):
            if group:
                ids = np.array(library.encode_batch_fast([mark.join(group)], add_special_tokens=False)[0].ids, self.kind)
                raw, width = ids.tobytes(), self.kind.itemsize
                if group is words:
                    ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                    starts = [0, *ends[:-1]]
                else:
                    ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                    starts = [0, *(e + 1 for e in ends[:-1])]
                own.update((w, raw[width * a : width * e]) for w, a, e in zip(group, starts, ends, strict=True))
        return own


_LOADED: dict[str, WordEncoder] = {}


def kind_of(size: int) -> np.dtype:
    """The type of packed ids: two bytes where the vocabulary allows it."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def joined(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `most` bytes: more texts share the work on their distinct chunks."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (packed, with the end id) of each row; and from each task one row of counted alone: how often it met each id."""
    bounded_batches(docs.sparkSession)
    size = vocabulary_size(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordEncoder(path)
        total = np.zeros(size, "<i8")
        for b in joined(batches):
            ids = _LOADED[path].encode(b.column("text").to_pylist())
            total += np.bincount(np.frombuffer(ids.buffers()[2], kind_of(size)), minlength=size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counted"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["doc_id", "ids", "counted"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, ids binary, counted binary")


def counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus: the rows of counts are added up in each task, then by id; one number an id travels to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counted").to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.filter("counted is not null").select("counted").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_file(where: str, doc_ids: list[int | None], counts_: list[int], ranks: np.ndarray) -> None:
    """Write under a name of its own, then rename: a task that runs twice or dies leaves no half file."""
    control, data = pack(ranks)
    head = np.array([MAGIC, VERSION, len(doc_ids), len(ranks)], "<u8").tobytes()
    body = [head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(counts_, "<u4").tobytes(), bytes(x is None for x in doc_ids), control, data]
    fs, name = pafs.FileSystem.from_uri(where)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        for part in body:
            f.write(part)
    fs.move(temporary, name)


def read_file(raw: bytes, ids_of_ranks: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and all ids of one file's bytes."""
    magic, version, docs, n = np.frombuffer(raw, "<u8", 4).tolist()
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file")
    at = 32
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    at += 8 * docs
    each = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    doc_ids = [None if null else x for x, null in zip(doc_ids, raw[at : at + docs], strict=True)]
    at += docs
    quads = -(-n // 4)
    return doc_ids, each, ids_of_ranks[unpack(raw[at : at + quads], raw[at + quads :], n)]


def write_corpus(docs: DataFrame, path: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode, rank and write a corpus; gives the folder and one row (file, n_docs, n_ids, first) for each file, first counting the ids before it.

    Encoding runs once and is kept in the shared folder; the second pass deals the ids out by ranges of doc_id and writes a
    few files a task. Only sums travel to the driver: a count for each id of the vocabulary, three numbers a file.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "tokens")
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    ids, kept = written(encoded(docs, path), "ids")
    size = vocabulary_size(path)
    kind = kind_of(size)
    order = np.argsort(-counts(ids, size), kind="stable").astype("<u4")
    with fs.open_output_stream(f"{name}/rank.u4") as f:
        f.write(order.tobytes())
    rank = np.empty(size, "<u4")
    rank[order] = np.arange(size, dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0
        out: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal doc_ids, parts, held, k
            if doc_ids:
                where = f"part-{part:06d}-{k:04d}.ids"
                write_file(f"{folder}/{where}", doc_ids, [len(x) // kind.itemsize for x in parts], rank[np.frombuffer(b"".join(parts), kind)])
                out.append((where, len(doc_ids), held))
                doc_ids, parts, held, k = [], [], 0, k + 1

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                doc_ids.append(d)
                parts.append(x)
                held += len(x) // kind.itemsize
                if held >= FILE_IDS:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"file": f, "n_docs": d, "n_ids": n} for f, d, n in out], FILES)

    bounded_batches(spark)
    own = ids.filter("ids is not null").select("doc_id", "ids")
    dealt = own.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    files = pa.Table.from_pylist([r.asDict() for r in dealt.mapInArrow(run, "file string, n_docs bigint, n_ids bigint").collect()], FILES).sort_by("file")
    discard(spark, kept)
    n = files["n_ids"].to_numpy()
    return folder, spark.createDataFrame(files.append_column("first", pa.array(np.cumsum(n) - n, pa.int64())))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1)


def read_corpus(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{name}/rank.u4") as f:
            order = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_stream(f"{name}/{r['file']}") as f:
                    doc_ids, each, ids = read_file(f.read(), order)
                ends = np.cumsum(each)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(r["first"] + ends - each, pa.int64()), pa.array(each, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = files.select("file", "first").repartition(max(1, min(files.count(), 10_000)), "file")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
