"""Hard negatives by a pivot table.

Vectors become integers, floor(256 * x), and a score is their inner product. With M the largest norm, each row gets one more
component, sqrt(M^2 - |x|^2), and an anchor 0: then |q - x|^2 = |q|^2 + M^2 - 2 * score, so the largest product is the smallest distance.
The pivot table holds each row's distances to PIVOTS rows, taken farthest first from a sample of at most SAMPLE rows (those of the
least hash of their id): the sample places the pivots alone, every row is indexed and searched. By the triangle inequality
|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), so the pivots bracket each score; the rows of the table lie by nearest pivot,
and the brackets of a whole chunk of rows come from its smallest and largest distances. What a bracket can't exclude is scored
exactly, in integers, so results don't depend on the pivots; in vectors without clusters the brackets exclude little.

Anchors go in blocks of about BLOCK to all tasks, each block against all rows of the table, first for the positives and then, with their
scores as bounds, for the negatives. A task holds BLOCK * k candidates and a chunk of rows, whatever the table's size; the
candidates of all tasks are merged by a window for each anchor (and positive), of k rows a task. No row is shuffled, so no label can
be hot.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; shorter vectors end in zeros; rows with
the anchor's own vec_id are not its others; repeated rows are rows of their own, and so are repeated anchors; scores beyond 62 bits
are refused; no anchors, no positives or no fitting negatives give no rows; a negative score has no hard negatives (the range is empty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, discard, written

PIVOTS, SAMPLE = 12, 4096
#: Anchors that go to the tasks at once, rows that are bracketed at once, and anchors of these at once.
BLOCK, CHUNK, STRIP = 4096, 4096, 256
#: Positives of an anchor, and negatives of each.
K = 5


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector array<bigint>: the rows that take part."""
    own = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["label"].cast("bigint").alias("label"), vectors["embedding"].cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of integers, zeros behind the shorter ones."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


class Space:
    """The largest square of a norm, the width of the vectors and the pivots, with their added component."""

    def __init__(self, square: int, width: int, sample: np.ndarray):
        self.square, self.width = square, max(width, 1)
        self.exact = np.float64 if square < 1 << 52 else np.int64  # products of floats are exact below
        rows = self.lifted(sample.astype(np.float64))
        chosen, far = [], np.full(len(rows), np.inf)
        for _ in range(min(PIVOTS, len(rows))):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = rows[chosen]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))[:, None]])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """To the pivots; anchors have 0 as their added component."""
        x = x.astype(np.float64)
        lifted = np.hstack([x, np.zeros((len(x), 1))]) if anchors else self.lifted(x)
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


class Anchors:
    """A block of anchors with their distances to the pivots."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.space, self.ids, self.labels, self.vectors = space, ids, labels, vectors.astype(space.exact)
        self.to = space.distances(vectors, anchors=True)
        self.reach = (vectors.astype(np.float64) ** 2).sum(axis=1) + space.square
        self.slack = 1 + 1e-7 * self.reach  # a distance near 0 is right to 1e-8 of the reach's root

    def brackets(self, own: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some anchors with rows, or chunks, whose distances to each pivot lie from least to most."""
        near, far = np.zeros((len(own), len(least))), np.full((len(own), len(least)), np.inf)
        for p in range(self.to.shape[1]):
            q = self.to[own, p][:, None]
            np.maximum(near, np.maximum(least[:, p] - q, q - most[:, p]), out=near)
            np.minimum(far, q + most[:, p], out=far)
        reach, slack = self.reach[own][:, None], self.slack[own][:, None]
        return (reach - far * far) / 2 - slack, (reach - near * near) / 2 + slack

    def scores(self, a: int, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.vectors[a]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, labels, vectors and distances of up to CHUNK rows."""
    kept: list[pa.RecordBatch] = []

    def one() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(kept).combine_chunks()
        col = lambda c: t.column(c).chunk(0)
        whole = lambda c, kind: np.frombuffer(b"".join(col(c).to_pylist()), kind).reshape(t.num_rows, -1)
        return col("vec_id").to_numpy(), col("label").to_numpy(), whole("vector", "<i4").astype(space.exact), whole("distances", "<f8")

    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) >= CHUNK:
            yield one()
            kept.clear()
    if sum(x.num_rows for x in kept):
        yield one()


def _strips(anchors: Anchors, own: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows that its bracket can't exclude, their lower bounds): scores from floor to ceiling are sought."""
    low, high = anchors.brackets(own, to.min(axis=0)[None], to.max(axis=0)[None])
    own = own[(high[:, 0] >= floor[own]) & (low[:, 0] <= ceiling[own])]  # the whole chunk
    for k in range(0, len(own), STRIP):
        some = own[k : k + STRIP]
        low, high = anchors.brackets(some, to, to)
        open_ = (high >= floor[some][:, None]) & (low <= ceiling[some][:, None])
        for i, a in enumerate(some.tolist()):
            rows = np.flatnonzero(open_[i])
            if len(rows):
                yield a, rows, low[i, rows]


def _best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of the K highest scores, ties by smaller id, in order."""
    if len(scores) > 4 * K:
        few = np.flatnonzero(scores >= np.partition(scores, -K)[-K])
        return few[np.lexsort((ids[few], -scores[few]))[:K]]
    return np.lexsort((ids, -scores))[:K]


def _positives(anchors: Anchors):
    """Each task's K best rows of the same label for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {a: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for a in range(len(anchors.ids))}
        floor, ceiling = np.full(len(found), -np.inf), np.full(len(found), np.inf)
        for ids, labels, vectors, to in _chunks(batches, anchors.space):
            for label in np.unique(labels):
                rows, own = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
                if not len(own):
                    continue
                for a, few, low in _strips(anchors, own, floor, ceiling, to[rows]):
                    few = rows[few]
                    other = ids[few] != anchors.ids[a]
                    few, low = few[other], low[other]
                    if len(few) > K:  # K rows reach the K-th lower bound for certain
                        few = few[_upper(anchors, a, to[few]) >= np.partition(low, -K)[-K]]
                    s, i = np.concatenate([found[a][0], anchors.scores(a, vectors[few])]), np.concatenate([found[a][1], ids[few]])
                    best = _best(s, i)
                    found[a] = s[best], i[best]
                    if len(best) == K:
                        floor[a] = s[best[-1]]
        yield _rows([(a, int(s), int(i)) for a, (scores, own) in found.items() for s, i in zip(scores, own, strict=True)], "a score vec_id")

    return run


def _upper(anchors: Anchors, a: int, to: np.ndarray) -> np.ndarray:
    return anchors.brackets(np.array([a]), to, to)[1][0]


def _negatives(anchors: Anchors, positives: dict[int, list[tuple[int, int]]]):
    """Each task's K best rows of another label for each anchor and positive, with scores from 0.8 times the positive's up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {a: [s for s, _ in own] for a, own in positives.items()}
        found = {(a, j): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for a, own in kept.items() for j in range(len(own))}
        floor, ceiling = np.full(len(anchors.ids), np.inf), np.full(len(anchors.ids), -np.inf)
        lowest = {a: [-(-4 * s // 5) if s >= 0 else np.inf for s in own] for a, own in kept.items()}  # 5 * score >= 4 * the positive's
        for a, own in kept.items():
            floor[a], ceiling[a] = min(lowest[a]), max(own)
        for ids, labels, vectors, to in _chunks(batches, anchors.space):
            for label in np.unique(labels):
                rows, own = np.flatnonzero(labels == label), np.flatnonzero((anchors.labels != label) & (ceiling >= floor))
                for a, few, _ in _strips(anchors, own, floor, ceiling, to[rows]):
                    few = rows[few]
                    s, i = anchors.scores(a, vectors[few]), ids[few]
                    fit = (s >= floor[a]) & (s <= ceiling[a]) & (i != anchors.ids[a])
                    s, i = s[fit], i[fit]
                    if not len(s):
                        continue
                    for j, top in enumerate(kept[a]):
                        fit = (s >= lowest[a][j]) & (s <= top)
                        if fit.any():
                            t, u = (np.concatenate(x) for x in zip(found[a, j], (s[fit], i[fit]), strict=True))
                            best = _best(t, u)
                            found[a, j] = t[best], u[best]
                            if len(best) == K:
                                lowest[a][j] = max(lowest[a][j], int(t[best[-1]]))
                    floor[a] = min(lowest[a])
        yield _rows([(a, j, int(anchors.ids[a]), positives[a][j][1], positives[a][j][0], int(i), int(s)) for (a, j), (scores, own) in found.items() for s, i in zip(scores, own, strict=True)], _FOUND)

    return run


_FOUND = "a j anchor_id positive_id positive_score negative_id negative_score"


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _schema(names: str) -> str:
    return ", ".join(f"{c} bigint" for c in names.split())


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """vec_id, label, vector and distances as bytes, rows by nearest pivot; what quantised() gives must fit the space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), space.width)
            to = space.distances(x)
            packed = lambda m, kind: pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
            near = to.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), packed(x, "<i4"), packed(to, "<f8"), pa.array(near, pa.int32()), pa.array(to[np.arange(len(to)), near])], ["vec_id", "label", "vector", "distances", "near", "away"])

    table = rows.mapInArrow(run, "vec_id bigint, label bigint, vector binary, distances binary, near int, away double")
    return table.repartitionByRange("near", "away", "vec_id").sortWithinPartitions("near", "away").drop("near", "away")


def space_of(rows: DataFrame) -> Space | None:
    """The space of quantised rows; None without rows."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(F.max(norm).alias("square"), F.max(F.size("vector")).alias("width")).first()
    if size["square"] is None:
        return None
    if size["square"] >= 2.0**62:
        raise ValueError("vectors are too long: scores must stay below 62 bits")
    sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    width = max(size["width"], 1)
    # above 2^53 the sum of squares is rounded: a little more is as right, the sphere only has to hold all rows
    square = int(size["square"]) if size["square"] < 2.0**52 else int(size["square"] * (1 + 1e-9))
    return Space(square, width, _matrix(sample.column("vector").combine_chunks(), width))


def mine(vectors: DataFrame, each: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows whose vec_id is divisible by `each`.

    vectors: vec_id, label, embedding. The result stays in the shared folder; the pivot table is deleted.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = quantised(vectors)
    space = space_of(rows)
    if space is None:
        return _ranked(spark.createDataFrame([], "part int, " + _schema(_FOUND)))
    index, path = written(pivot_table(rows, space), "pivots")
    own = index.filter(F.col("vec_id") % each == 0)
    blocks = -(-own.count() // BLOCK)
    results = [_block(spark, space, index, own, k, blocks) for k in range(blocks)]
    out = spark.createDataFrame([], "part int, " + _schema(_FOUND))
    for part, _ in results:
        out = out.unionByName(part)
    discard(spark, path)
    return _ranked(out)


def _block(spark: SparkSession, space: Space, index: DataFrame, own: DataFrame, k: int, blocks: int) -> tuple[DataFrame, str]:
    """The candidates of one block of anchors from all rows, written."""
    some = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).select("vec_id", "label", "vector").orderBy("vec_id", "label", "vector").toArrow()
    vectors = np.frombuffer(b"".join(some.column("vector").to_pylist()), "<i4").reshape(some.num_rows, -1)
    anchors = Anchors(space, some.column("vec_id").to_numpy(), some.column("label").to_numpy(), vectors)
    best = Window.partitionBy("a").orderBy(F.desc("score"), "vec_id")
    near = index.mapInArrow(_positives(anchors), _schema("a score vec_id")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K)
    positives: dict[int, list[tuple[int, int]]] = {}
    for r in near.orderBy("a", "rank").collect():  # K a row of the block
        positives.setdefault(r["a"], []).append((r["score"], r["vec_id"]))
    return written(index.mapInArrow(_negatives(anchors, positives), _schema(_FOUND)).withColumn("part", F.lit(k)), f"negatives-{k}")


def _ranked(found: DataFrame) -> DataFrame:
    best = Window.partitionBy("part", "a", "j").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB SQL, every anchor with every row.
SQL = """
with r as (select vec_id::bigint as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.id as anchor_id, b.id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score from r a join r b on a.id % 100 = 0 and a.id <> b.id),
 p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id))::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score qualify rank <= 5
"""
