"""Near-duplicates by BagMinHash: weighted Jaccard of word-shingle multisets.

Exact copies meet first, by the digest of their text; what follows works on one node for each text. A text's shingles of
five words with their counts are a weighted set. Each shingle owns Poisson processes over its weight axis: one over [0, 1),
then one over each dyadic interval [1, 2), [2, 4), ...; a point counts if its level lies below the shingle's count, and falls
on one of the signature's places, which keeps its earliest point. Two places agree with the probability of the weighted
Jaccard similarity, and a shingle that occurs w times costs log w processes, of which only points before a horizon
are made.

Signatures are cut into bands; texts that share a band's hash are candidates. Within a bucket not all pairs are made. First
the member that shares most buckets meets all others, which links most of a group of near copies to its centre. What a bucket
still holds of several components, copies too far from the centre as a rule, is bucketed anew by the rarest elements of its
multisets: two sets that reach the similarity must share one of them, with room for their overlap behind it. In these buckets
leaders meet the members of other components, more in each round, until each pair is compared, has no room or is connected.
So a link that a band shows is lost by a misleading sketch alone (see SPARE), and a group of n copies takes about n
comparisons. Candidates are ruled out by sizes and sketches where those are far off, and verified exactly on the multisets.

Defined cases: a text of 1 to 4 words is one shingle; texts without words (null, empty, white space) link with their exact
copies alone, null counting as empty; null doc_ids take part and get the class of their text, which is null where all ids
of a class are; equal rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import FACTOR, WordHashes, bounded_batches, discard, mixed, windows, written


@dataclass(frozen=True)
class Params:
    """bands of rows places each: a pair is met with probability 0.997 at a similarity of 0.8, 0.42 at 0.6 and 0.02 at 0.4."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 8


#: Standard deviations under the similarity from which sketches rule a pair out: one in a billion links.
SPARE = 6
#: Cells in which elements are counted to order them by rarity.
COUNTS = 1 << 20

_WORDS: dict[str, WordHashes] = {}


def _word_hashes() -> WordHashes:
    return _WORDS.setdefault("words", WordHashes())


def shingles(text: str | None, size: int) -> np.ndarray:
    """A hash for each shingle of the text, in order."""
    h = _word_hashes().of(text)
    if not len(h):
        return np.zeros(0, np.uint64)
    return windows(h, min(size, len(h)))


def elements(text: str | None, size: int) -> np.ndarray:
    return _set(shingles(text, size))


def _set(s: np.ndarray) -> np.ndarray:
    """A multiset of shingles as a sorted set: one id for each shingle and copy number."""
    s = np.sort(s)
    if not len(s):
        return s
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    copy = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    with np.errstate(over="ignore"):
        return np.sort(mixed(s + copy.astype(np.uint64) * FACTOR))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets given by elements()."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signature(s: np.ndarray, places: int) -> np.ndarray:
    """Earliest points of the Poisson processes of a non-empty multiset of shingles, as bit patterns.

    Points are made in blocks; a process ends when its time is past the last place's point, as nothing it gives can count.
    """
    keys, counts = np.unique(s, return_counts=True)
    steps = 1 + np.ceil(np.log2(counts)).astype(np.int64)  # intervals [0,1), [1,2), [2,4), ... below the count
    own = np.repeat(np.arange(len(keys)), steps)
    k = np.arange(len(own)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(k == 0, 0.0, 2.0 ** (k - 1))
    rate = np.where(k == 0, 1.0, low)
    weight = counts[own].astype(float)
    with np.errstate(over="ignore"):
        seed = mixed(keys[own] + (k.astype(np.uint64) + np.uint64(1)) * FACTOR)
        best, t, live, made = np.full(places, np.inf), np.zeros(len(own)), np.arange(len(own)), 0
        end = places / len(s) * (np.log(places) + 0.5)  # about when the last place is met
        while len(live):
            left = max(0.0, end - t[live].min())
            block = 1 + int(min(left * rate[live].max(), max(left, 4096 / len(live))))
            j = np.arange(made + 1, made + block + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            u = mixed(seed[live, None] ^ j)
            # 44 bits give the gap, 20 the place; the level has a hash of its own
            at = np.log(((u >> np.uint64(20)).astype(float) + 0.5) * 2.0**-44) / -rate[live, None]
            at[:, 0] += t[live]
            at = np.cumsum(at, axis=1)
            t[live] = at[:, -1]
            ok = at <= best.max()
            high = np.flatnonzero(low[live])
            if len(high):
                r = rate[live[high], None]
                level = low[live[high], None] + r * ((mixed(u[high]) >> np.uint64(11)).astype(float) * 2.0**-53)
                ok[high] &= level < weight[live[high], None]
            np.minimum.at(best, ((u[ok] & np.uint64(0xFFFFF)) % np.uint64(places)).astype(np.int64), at[ok])
            last = best.max()
            end = last if np.isfinite(last) else max(end, t.min()) * 1.25
            made, live = made + block, live[t[live] < last]
    # the last bits are dropped: they may hang on how a sum was blocked
    return best.astype(np.float32).view(np.uint32).astype(np.uint64)


def band_hashes(text: str | None, p: Params) -> list[int] | None:
    s = shingles(text, p.shingle)
    if not len(s):
        return None
    sig = mixed(signature(s, p.bands * p.rows)).reshape(p.bands, p.rows)
    out = np.arange(p.bands, dtype=np.uint64) * FACTOR
    with np.errstate(over="ignore"):
        for column in sig.T:
            out = mixed(out * FACTOR + column)
    return out.view(np.int64).tolist()


def _node() -> object:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("node")


def _nodes(docs: DataFrame, p: Params) -> DataFrame:
    """node, doc_id, bands (null without words) of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = [band_hashes(t, p) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array(bands, pa.list_(pa.int64()))], ["node", "doc_id", "bands"])

    own = docs.select(_node(), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "node binary, doc_id bigint, bands array<bigint>")


def _sketch(s: np.ndarray, p: Params) -> bytes:
    """The low byte of each place of the signature."""
    return mixed(signature(s, p.bands * p.rows)).astype(np.uint8).tobytes()


def _sets(members: DataFrame, rows: DataFrame, docs: DataFrame, p: Params) -> tuple[DataFrame, str]:
    """node, n, sketch, set of the given nodes; all rounds read the written table.

    One row gives a node its text: the one with the least doc_id. So texts are dealt out by node and doc_id, and the copies of
    one text go to different tasks.
    """
    bounded_batches(docs.sparkSession)
    first = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first"))
    first = first.withColumnRenamed("node", "of")
    texts = docs.select(_node(), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(first, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["node", "doc_id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t, p.shingle) for t in b.column("text").to_pylist()]
            columns = [pa.array([len(s) for s in own], pa.int64()), pa.array([_sketch(s, p) for s in own], pa.binary()), pa.array([_set(s).tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), *columns], ["node", "n", "sketch", "set"])

    return written(texts.select("node", "text").mapInArrow(sets, "node binary, n bigint, sketch binary, set binary"), "sets")


def _of_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of a (left_...) and of b (right_...)."""
    for side, name in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{name}_{c}") for c in columns]), side)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, str]:
    """The pairs (a, b) of nodes whose multisets reach the similarity.

    Pairs whose sizes rule it out, or whose sketches agree in so few places that it lies SPARE standard deviations away, need no
    exact check; so sets travel for pairs near the similarity alone.
    """
    places = p.bands * p.rows
    least = places * (p.similarity - SPARE * (p.similarity * (1 - p.similarity) / places) ** 0.5)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, places) for c in ("left_sketch", "right_sketch"))
            yield b.filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_())).select(["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left_set").to_pylist(), b.column("right_set").to_pylist()
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= p.similarity for x, y in zip(left, right, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sized = _of_both(pairs, sets, "n", "sketch").filter(F.least("left_n", "right_n") >= p.similarity * F.greatest("left_n", "right_n"))
    near, path = written(sized.select("a", "b", "left_sketch", "right_sketch").mapInArrow(alike, "a binary, b binary"), "near")
    links = written(_of_both(near, sets, "set").select("a", "b", "left_set", "right_set").mapInArrow(compare, "a binary, b binary"), "links")
    discard(pairs.sparkSession, path)
    return links


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """node, label of each node that has a link: the least node of its component, by neighbours' labels and pointer jumping."""
    spark = links.sparkSession
    edges, path = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels, old = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("a") == F.col("node")).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = new.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved"))
        new, fresh = written(new, "labels")
        moved = new.filter("moved").limit(1).count()
        discard(spark, old)
        labels, old = new.select("node", "label"), fresh
        if not moved:
            discard(spark, path)
            return labels, old


class _Links:
    """The links found so far, and the components that they make: node, label."""

    def __init__(self, sets: DataFrame, p: Params):
        self.sets, self.p = sets, p
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.paths: list[str] = []
        self.old: str | None = None

    def meet(self, pairs: DataFrame) -> None:
        """Verify the pairs; what links joins components."""
        spark = self.sets.sparkSession
        pairs, path = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if pairs.limit(1).count():
            found, own = _verified(pairs, self.sets, self.p)
            self.paths.append(own)
            self.links = found if self.links is None else self.links.union(found)
            before = self.old
            self.labels, self.old = components(self.links)
            if before:
                discard(spark, before)
        discard(spark, path)

    def labelled(self, members: DataFrame) -> DataFrame:
        """members with the label of their component: a node without links is its own."""
        if self.labels is None:
            return members.withColumn("label", F.col("node"))
        return members.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(members: DataFrame) -> DataFrame:
    """The buckets in which members (bucket, label) of several components are left."""
    return members.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("open")).filter("open").select("bucket")


def _prefixes(nodes: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, str]:
    """bucket, node, room, n: the first elements of each node's set in one global order, the rarest first.

    Two sets that reach the similarity share an element of these, and of the first one that they share, room (how many elements
    of the set stand from there on) is at least their overlap on both sides. The order goes by how often elements occur in these
    nodes, counted in COUNTS cells: any order is right, a rough one of rarity is enough to keep the buckets small.
    """
    spark = sets.sparkSession
    bounded_batches(spark)
    own, path = written(sets.join(nodes, "node", "left_semi").select("node", "set"), "hot")
    cells = np.uint64(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            every = np.frombuffer(b"".join(b.column("set").to_pylist()), np.uint64)
            total += np.bincount((every % cells).astype(np.int64), minlength=COUNTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    seen = own.select("set").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(COUNTS, np.int32)
    got = seen.filter("n > 1").toArrow()  # at most COUNTS rows of two numbers
    table[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    sent = spark.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in batches:
            for node, x in zip(b.column("node").to_pylist(), b.column("set").to_pylist(), strict=True):
                s = np.frombuffer(x, np.uint64)
                c = often[(s % cells).astype(np.int64)]
                most = int(len(s) - p.similarity * len(s) + 1e-9) + 1
                first = np.lexsort((s, c))[:most]
                place = np.flatnonzero(c[first] > 0)  # what occurs once can't be shared
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[first[place]].view(np.int64), pa.int64()), pa.array([node] * len(place), pa.binary()), pa.array(len(s) - place, pa.int64()), pa.array([len(s)] * len(place), pa.int64())],
                    ["bucket", "node", "room", "n"],
                )

    out, hot = written(own.mapInArrow(cut, "bucket bigint, node binary, room bigint, n bigint"), "prefixes")
    discard(spark, path)
    sent.unpersist()
    return out, hot


def _alive(members: DataFrame, s: float) -> DataFrame:
    """Members that have room for a partner in their bucket: the smaller of two needs room for 2s / (1 + s) of itself, the larger for what the smallest such one asks."""
    strong = F.col("room") * (1 + s) >= 2 * s * F.col("n") - 1e-6
    least = members.filter(strong).groupBy("bucket").agg(F.min("n").alias("least"))
    return members.join(least, "bucket").filter(strong | (F.col("room") * (1 + s) >= s * (F.col("n") + F.col("least")) - 1e-6)).drop("least")


def _first_round(members: DataFrame, found: _Links) -> tuple[DataFrame, str]:
    """In each bucket (bucket, node, size) the member that shares most buckets meets all others; gives the nodes of the buckets that stay open.

    The centre of a group of near copies shares more buckets than they do with each other, so this links most of the group.
    """
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    lead = members.join(weights, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    lead, path = written(lead, "leaders")
    found.meet(members.join(lead, "bucket").filter("a <> node").select("a", F.col("node").alias("b")))
    left = found.labelled(members.join(lead, "bucket").filter("a <> node").select("bucket", "node"))
    left, rest = written(left, "left")
    out = written(left.join(_open(left), "bucket").select("node").distinct(), "open")
    discard(members.sparkSession, path, rest)
    return out


def _rounds(members: DataFrame, found: _Links, s: float) -> None:
    """Members (bucket, node, room, n) meet until each pair of a bucket with room for both is compared or connected.

    In each round some leaders, of small components first, meet the members of other components; eight times as many in the
    next round, in the buckets that are still open.
    """
    spark, path, leaders = members.sparkSession, None, 4
    members = members.withColumn("done", F.lit(False))
    while True:
        here = found.labelled(members.select("bucket", "node", "room", "n", "done"))
        here, fresh = written(here.join(_open(here.filter("not done")), "bucket"), "buckets")
        if path:
            discard(spark, path)
        path = fresh
        if not here.limit(1).count():
            break
        parts = here.filter("not done").groupBy("bucket", "label").agg(F.count("*").alias("size"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("size", F.desc("room"), "node"))
        lead = here.filter("not done").join(parts, ["bucket", "label"]).withColumn("k", rank).filter(F.col("k") <= leaders)
        lead, led = written(lead.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("room").alias("ra"), F.col("n").alias("na")), "leaders")
        both = here.filter("not done").alias("h").join(
            lead.alias("l"),
            (F.col("h.bucket") == F.col("l.bucket")) & (F.col("label") != F.col("la")) & (F.least("room", "ra") * (1 + s) >= s * (F.col("n") + F.col("na")) - 1e-6),
        )
        found.meet(both.select("a", F.col("node").alias("b")))
        gone = lead.select("bucket", F.col("a").alias("node"), F.lit(True).alias("led"))
        members, more = written(here.drop("label").join(gone, ["bucket", "node"], "left").select("bucket", "node", "room", "n", (F.col("done") | F.coalesce("led", F.lit(False))).alias("done")), "members")
        discard(spark, path, led)
        path = more
        leaders *= 8
    discard(spark, path)


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links, node, label for each row of docs.

    n_links counts the links that were verified for the row's text: each text of a class has one at least, unless the class is
    one text. label alone tells classes apart: ids may be null or equal. The result is a table in the shared folder, the only
    one of this run that stays there.
    """
    spark = docs.sparkSession
    rows, rows_path = written(_nodes(docs, p), "nodes")
    members = rows.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members, members_path = written(members.join(shared, "bucket"), "members")
    sets, sets_path = _sets(members, rows, docs, p)
    found = _Links(sets, p)
    work = [members_path, sets_path]
    if members.limit(1).count():
        left, left_path = _first_round(members, found)
        work.append(left_path)
        if left.limit(1).count():
            hot, hot_path = _prefixes(left, sets, p)
            work.append(hot_path)
            _rounds(_alive(hot, p.similarity), found, p.similarity)
    texts = found.labelled(rows.groupBy("node").agg(F.min("doc_id").alias("first")))
    ids = texts.groupBy("label").agg(F.min("first").alias("class_id"))
    named = texts.join(ids, "label").select("node", "class_id", "label")
    if found.links is not None:
        ends = found.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        named = named.join(ends, "node", "left")
    else:
        named = named.withColumn("n_links", F.lit(None).cast("bigint"))
    named = named.select("node", "class_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out, _ = written(rows.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "n_links", "node", "label"), "classes")
    discard(spark, rows_path, *work, *found.paths, *filter(None, [found.old]))
    return out


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, unchanged, of one document for each class: the one that gives the class its id."""
    found = classes(docs, p)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "class_id").agg(F.min("node").alias("kept"))
    kept = kept.select("kept", F.col("class_id").alias("kept_id"))
    # dealt out by text and id: the copies of one text go to different tasks
    own = docs.select(F.struct(_node(), F.col("doc_id").cast("bigint").alias("id")).alias("key"), F.struct(*_columns(docs)).alias("row"))
    own = own.select("key.node", "key.id", "row").join(kept, (F.col("node") == F.col("kept")) & F.col("id").eqNullSafe(F.col("kept_id")))
    return own.dropDuplicates(["node", "id"]).select("row.*")


def _columns(docs: DataFrame) -> list[Column]:
    return [docs[f"`{c}`"] for c in docs.columns]
