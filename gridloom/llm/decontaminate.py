"""Benchmark decontamination by template windows.

Words become a template: numbers, units of measure and names (capitalised inside a sentence) turn into typed placeholders, all
else into lower case without outer punctuation. A capitalised word at the start of a sentence or text may be a name or not: its
windows are made in both readings, so what stands before an item doesn't matter. A window of WINDOW template words with fewer than LITERALS
words of its own is taken as it stands, values and all: bare figures match equal figures only.

The items' windows are a table, and documents meet it by a join on the windows' hashes. Before the shuffle a document's windows pass two
filters of a fixed number of bits, one of the items' words and one of their windows, so that little but true hits moves; a large benchmark
makes the filters denser and the join longer, nothing else, and one scan of the documents serves any number of items. Each pair of document and
item with enough hits is then aligned on its own: the windows found at one shift, or at shifts that differ by at most SLACK of the
item's length, must reach SIMILARITY of the item's places, and each value of the item must stand for one value of the document and the other
way round. So an item with other numbers or names is found, also behind a text of the same template that contradicts it, and a chance
mix of placeholders, or of the item's parts, is not. The work of a pair is that of its hits, sorted once.

Defined cases: items of 1 to 4 words must be found whole; items without words (null, empty) match nothing; equal items each
match; repeated documents each match; null and empty documents hold none; null ids stay; documents are scanned to their end; extra
columns of either table may have any name.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import FACTOR, bounded_batches, mixed, written

WINDOW = 5
SIMILARITY = 0.8
#: Words put in or left out that one alignment bears, as a share of the item's length.
SLACK = 0.1
#: Words of its own, neither numbers nor units nor names, that a window of placeholders needs.
LITERALS = 2
#: Bits of a filter for each entry, and least and most bits of a filter.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Units of measure.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur "
    "degree degrees percent mph kmh".split()
)
NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-zA-Z]{1,2})?")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
NUM, UNIT, NAME = 1, 2, 3


_SHORT = (1 << 59) - 1


def core(word: str) -> str:
    return OUTER.sub("", word)


def word_hash(word: str) -> int:
    """59 bits, and none of the placeholders' numbers."""
    return max(xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) & _SHORT, 4)


class Filter:
    """A Bloom filter over 64-bit hashes; three bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) - 1)

    @staticmethod
    def size(entries: int) -> int:
        return min(max(LEAST_BITS, 1 << (FILTER_BITS * entries).bit_length()), MOST_BITS)

    @staticmethod
    def _places(h: np.ndarray) -> tuple[np.ndarray, ...]:
        h = h.astype(np.uint64)  # hashes already
        return h, h >> np.uint64(17), h >> np.uint64(31)

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            self.bits[p & self.mask] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for p in self._places(h):
            left = left[self.bits[p[left] & self.mask]]
        out[left] = True
        return out


class Words(dict):
    """word -> id << 2 | may be a name << 1 | ends a sentence; id: the placeholder's number, else the hash of the word without outer punctuation."""

    def __missing__(self, word: bytes) -> int:
        w = word.decode("utf-8", "replace")
        c = w.strip(string.punctuation)
        letters = c.isalpha()  # most words: no number, and nothing more to strip
        if not letters:
            c = core(w)
        low = c.lower()
        ends = not w[-1].isalpha() and w.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":")
        if not letters and c and NUMBER.fullmatch(c):
            i, name = NUM, False
        elif low in UNITS:
            i, name = UNIT, False
        else:
            i, name = word_hash(low or w), c[:1].isupper() and c[1:].islower()
        v = i << 2 | name << 1 | ends
        if len(self) < 600_000 and len(word) < 64:
            self[word] = v
        return v


def template(words: list[bytes], table: Words, known: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    """Template ids of a text's words, 0 for those that the filter doesn't know, and which may be names as well: the capitalised ones at a sentence's or the text's start."""
    v = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    if not len(v):
        return v, np.zeros(0, bool)
    starts = np.concatenate(([True], (v[:-1] & 1).astype(bool)))
    name = (v & 2).astype(bool)
    ids = v >> 2
    if known is not None:
        ids = np.where((ids <= NAME) | known.holds(ids), ids, 0)
    return np.where(name & ~starts, NAME, ids), name & starts


_BITS = 1 << np.arange(WINDOW)
#: For each set of words in a window, as bits, its parts but the empty one: all in one array, where they start and how many.
_PARTS = [[m for m in range(1, 1 << WINDOW) if m & ~code == 0] for code in range(1 << WINDOW)]
_PART, _COUNT = np.array([m for parts in _PARTS for m in parts], np.int64), np.array([len(parts) for parts in _PARTS])
_START = np.cumsum(_COUNT) - _COUNT


def _hashed(ids: np.ndarray) -> np.ndarray:
    """One hash for each row of word numbers."""
    h = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for column in ids.astype(np.uint64).T:
            h = mixed(h * FACTOR + column)
    return h


def _read(t: np.ndarray, either: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, place, plain, words read as names, as bits) of the windows at some places in all readings of the words that may be names; those with an unknown word are left out."""
    where = at[:, None] + np.arange(size)
    ids, code = t[where], either[where] @ _BITS[:size]
    sure = (ids > 0).all(axis=1)
    more = np.repeat(np.flatnonzero(code > 0), _COUNT[code[code > 0]])
    part = _PART[_ranges(_START[code[code > 0]], _START[code[code > 0]] + _COUNT[code[code > 0]])]
    also = np.where(part[:, None] & _BITS[:size] > 0, NAME, ids[more])
    ok = (also > 0).all(axis=1)
    names = np.concatenate([np.zeros(sure.sum(), np.int64), part[ok]])
    return np.concatenate([ids[sure], also[ok]]), np.concatenate([at[sure], at[more[ok]]]), names == 0, names

#: A window and what stands around it: a slot that no window covers is looked up there.
_AROUND = np.arange(1 - WINDOW, 2 * WINDOW - 1)
_SPAN = len(_AROUND)
#: Beside the placeholders' numbers: a word that may be a name, and one that is one elsewhere in the item.
EITHER, NAMED = 4, 5


def found_windows(words: list[bytes], table: Words, sizes: list[int], known: Filter | None = None, wanted: Filter | None = None) -> tuple[np.ndarray, ...]:
    """(hash, place, plain, slots) of a text's windows in all readings; of those alone that the filters of words and windows let pass.

    slots: for each place of _AROUND the hash of the word << 3 | the kind of its slot, 0 for other words. A window with fewer than
    LITERALS words of its own (or than it has words) is hashed with its values.
    """
    t, either = template(words, table, known)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    good = np.concatenate(([0], np.cumsum((t > 0) | either)))
    for size in sizes:
        at = np.flatnonzero(good[size:] - good[:-size] == size)
        if not len(at):
            continue
        ids, at, plain, names = _read(t, either, at, size)
        poor = (ids > NAME).sum(axis=1) < min(LITERALS, size)
        h, places = _hashed(ids[~poor]), np.unique(at[poor])
        at, plain = at[~poor], plain[~poor]
        if len(places):  # as they stand: once for each place, whatever the reading
            values = _hashes(words, places[:, None] + np.arange(size))
            if known is not None:
                sure = known.holds(values.ravel()).reshape(values.shape).all(axis=1)
                places, values = places[sure], values[sure]
            h, at, plain = np.concatenate([h, mixed(_hashed(values))]), np.concatenate([at, places]), np.concatenate([plain, np.ones(len(places), bool)])
        if wanted is not None:
            passed = wanted.holds(h)
            h, at, plain = h[passed], at[passed], plain[passed]
        out.append((h, at, plain))
    h, at, plain = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, at, plain, _slots(words, t, either, at)


def _hashes(words: list[bytes], where: np.ndarray) -> np.ndarray:
    """The hashes of the words at some places, without case and outer punctuation."""
    places, back = np.unique(where, return_inverse=True)
    said = (words[p].decode("utf-8", "replace") for p in places.tolist())
    return np.array([word_hash(core(w).lower() or w) for w in said], np.int64)[back].reshape(where.shape)


def _slots(words: list[bytes], t: np.ndarray, either: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), _SPAN), np.int64)
    if not len(at):
        return out
    where = at[:, None] + _AROUND
    inside = (where >= 0) & (where < len(t))
    kind = np.where(either, EITHER, np.where((t > 0) & (t <= NAME), t, 0))
    inside[inside] = kind[where[inside]] > 0
    hashes = _hashes(words, where[inside])
    kinds = kind[where[inside]]
    named = np.unique(_hashes(words, np.flatnonzero(t == NAME))) if (kinds == EITHER).any() and (t == NAME).any() else kinds[:0]
    kinds = np.where((kinds == EITHER) & np.isin(hashes, named), NAMED, kinds)
    out[inside] = hashes << 3 | kinds
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi), one range after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _numbers() -> Iterator[int]:
    """Numbers for the rows of a task, the same when it is repeated."""
    first = TaskContext.get().partitionId() << 40
    while True:
        yield first
        first += 1


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, number = Words(), _numbers()
    for b in batches:
        rows = [[] for _ in _ITEM]
        for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            k, words = next(number), _split(text)
            if not words:
                continue
            size = min(WINDOW, len(words))
            h, at, plain, slots = found_windows(words, table, [size])
            own = [h.view(np.int64).tolist(), [k] * len(h), [i] * len(h), at.tolist(), plain.tolist(), [v.tobytes() for v in slots], [len(words) - size + 1] * len(h), [len(words)] * len(h), [size] * len(h)]
            for into, new in zip(rows, own, strict=True):
                into += new
        yield pa.RecordBatch.from_arrays([pa.array(r, kind) for r, kind in zip(rows, _ITEM.values(), strict=True)], list(_ITEM))


_ITEM = {"hash": pa.int64(), "item": pa.int64(), "item_id": pa.int64(), "here": pa.int64(), "own_plain": pa.bool_(), "own": pa.binary(), "places": pa.int64(), "length": pa.int64(), "size": pa.int64()}
_ITEM_SCHEMA = "hash bigint, item bigint, item_id bigint, here bigint, own_plain boolean, own binary, places bigint, length bigint, size bigint"
_HIT = {"hash": pa.int64(), "doc": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "there": pa.int64(), "plain": pa.bool_(), "said": pa.binary()}
_HIT_SCHEMA = "hash bigint, doc bigint, doc_id bigint, mark bigint, there bigint, plain boolean, said binary"


def _filter_of(hashes: DataFrame, column: str) -> Filter:
    """The filter of a column of hashes: each task fills its own bits, and as many as there are tasks (eight at most) meet on the driver."""
    size = Filter.size(hashes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(size, bool))
        for b in batches:
            own.add(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own.bits).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(size, bool)
    for r in hashes.select(column).coalesce(8).mapInArrow(run, "bits binary").collect():
        bits |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return Filter(bits)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = {word_hash(core(w).lower() or w) for t in b.column("text").to_pylist() for w in (x.decode("utf-8", "replace") for x in _split(t))}
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64())], ["word"])


def _prober(known: Filter, wanted: Filter, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of documents that may be an item's."""
    packed = [np.packbits(f.bits).tobytes() for f in (known, wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, window = (Filter(np.unpackbits(np.frombuffer(p, np.uint8)).astype(bool)) for p in packed)
        table, number = Words(), _numbers()
        for b in batches:
            rows = [[] for _ in _HIT]
            for d, mark, text in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), strict=True):
                k = next(number)
                h, at, plain, slots = found_windows(_split(text), table, sizes, word, window)
                if len(h):
                    for into, new in zip(rows, [h.view(np.int64).tolist(), [k] * len(h), [d] * len(h), [mark] * len(h), at.tolist(), plain.tolist(), [v.tobytes() for v in slots]], strict=True):
                        into += new
            yield pa.RecordBatch.from_arrays([pa.array(r, kind) for r, kind in zip(rows, _HIT.values(), strict=True)], list(_HIT))

    return run


def aligned(there: np.ndarray, here: np.ndarray, said: np.ndarray, own: np.ndarray, places: int, length: int, names: bool) -> tuple[int, int] | None:
    """(places found, slots) of the first sound alignment of a document and an item, the fullest shifts first; None if there is none.

    there, here: a hit's place in document and item; said, own: the slots around it. A slot counts at the shift of a window that
    covers it, the nearest to the alignment's, else at that of a window beside it. names: words that may be names are slots.
    """
    shift = there - here
    order = np.argsort(shift, kind="stable")
    shift, here, said, own = shift[order], here[order], said[order], own[order]
    least, slack = SIMILARITY * places, int(SLACK * length)
    values, n = np.unique(shift, return_counts=True)
    low, high = np.searchsorted(shift, values - slack), np.searchsorted(shift, values + slack, side="right")
    covered = (_AROUND >= 0) & (_AROUND < min(WINDOW, length))
    for k in np.argsort(-n, kind="stable").tolist():
        a, b = int(low[k]), int(high[k])
        if b - a < least:
            continue
        near = a + np.argsort(np.abs(shift[a:b] - values[k]), kind="stable")
        _, first = np.unique(here[near], return_index=True)
        if len(first) < least:
            continue
        near = near[np.sort(first)]
        where = here[near][:, None] + _AROUND
        part = lambda x: np.concatenate([x[:, covered].ravel(), x[:, ~covered].ravel()])
        where, mine, other = part(where), part(own[near]), part(said[near])
        _, once = np.unique(where, return_index=True)
        mine, other = mine[once], other[once]
        kind, their = mine & 7, other & 7
        name = (kind == NAME) | (kind == NAMED) | (names & (kind == EITHER))
        slot = np.where(name, their >= NAME, (kind > 0) & (kind < NAME) & (kind == their))
        mine, other = mine[slot] >> 3, other[slot] >> 3
        pairs = len(set(zip(mine.tolist(), other.tolist(), strict=True)))
        if pairs == len(np.unique(mine)) == len(np.unique(other)):
            return len(first), int(slot.sum())
    return None


def _judged(table: pa.Table) -> pa.Table:
    """One pair of document and item: a row if the document holds the item."""
    col = lambda c: table.column(c).to_numpy()
    bits = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64).reshape(-1, _SPAN)
    there, here, said, own = col("there"), col("here"), bits("said"), bits("own")
    places, length = int(col("places")[0]), int(col("length")[0])
    plain = col("plain").astype(bool) & col("own_plain").astype(bool)
    # words that may be names are read as names too, else as words
    got = aligned(there, here, said, own, places, length, True)
    if got is None and plain.any():
        got = aligned(there[plain], here[plain], said[plain], own[plain], places, length, False)
    first = lambda c: [table.column(c)[0].as_py()] if got else []
    found, slots = got or (0, 0)
    out = [first("doc_id"), first("mark"), first("item_id"), [found] if got else [], [found / places] if got else [], [slots] if got else []]
    return pa.table({n: pa.array(v, kind) for (n, kind), v in zip(_LEAK.items(), out, strict=True)})


_LEAK = {"doc_id": pa.int64(), "mark": pa.int64(), "item_id": pa.int64(), "n_found": pa.int64(), "share": pa.float64(), "n_slots": pa.int64()}
_LEAK_SCHEMA = "doc_id bigint, mark bigint, item_id bigint, n_found bigint, share double, n_slots bigint"


def _marked(docs: DataFrame) -> list:
    return [docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("mark")]


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks() with the hash of the document's text (mark)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bench = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    items, _ = written(bench.mapInArrow(_item_windows, _ITEM_SCHEMA), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to WINDOW
    if not sizes:
        return spark.createDataFrame([], _LEAK_SCHEMA)
    known = _filter_of(bench.select("text").mapInArrow(_item_words, "word bigint").distinct(), "word")
    wanted = _filter_of(items.select("hash").distinct(), "hash")
    own = docs.select(*_marked(docs), docs["text"].cast("string").alias("text")).filter("text is not null")
    hits = own.mapInArrow(_prober(known, wanted, sizes), _HIT_SCHEMA).join(items.drop("size"), "hash")
    hits, _ = written(hits.drop("hash"), "item-hits")
    # pairs whose hits can't reach the similarity go before they are gathered
    enough = hits.groupBy("doc", "item").agg(F.count_distinct("here").alias("found"), F.max("places").alias("all")).filter(F.col("found") >= SIMILARITY * F.col("all")).select("doc", "item")
    return hits.join(enough, ["doc", "item"], "left_semi").groupBy("doc", "item").applyInArrow(_judged, _LEAK_SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_found, share, n_slots: a row for each document and item that it holds."""
    return _leaks(docs, benchmark).drop("mark")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that hold no item. A row travels as one struct, so its columns may have any name."""
    gone, _ = written(_leaks(docs, benchmark).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "leaking")
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_marked(docs))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    return own.join(gone, same, "left_anti").select("row.*")
