"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features, all from the text: densities of a hand-written and of a learned lexicon, hits near a second person, shares of
capitals, punctuation and obfuscated words, exclamation marks, word length, and the logarithm of the length. The learned
lexicon holds word starts whose occurrences stand almost only in texts labelled toxic.

Training uses labelled rows whose crc32(doc_id as text) mod 4 is 0, 1 or 3, at most `sample` of them by the order of a
hash (a documented bound): lexicon and trees from the remainders 0 and 1, calibration from 3; how pure a learned start must be is
chosen by these two as folds. Rows of remainder 2 decide nothing. Everything else runs over all
rows without shuffle: features are a projection, trees and calibration an Arrow step behind it.

Defined cases: null and empty texts have zero features and get the score of those; equal rows each give a row; null doc_ids
are held in (remainder taken as none); without both classes among the labels the score is the share of toxic ones, 0 if
there is no label. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, crc32_of, discard, written

#: Insults of the hand-written lexicon, and words of the second person.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "dumb", "fool", "ugly", "hate", "dumm", "trottel", "abschaum", "débile", "imbécile", "ordure", "estúpido", "imbécil", "basura")
SECOND = ("you", "your", "you're", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "tú", "usted", "te")


@dataclass(frozen=True)
class Params:
    """sample: most labelled rows that train; lexicon: most learned word starts; support, purity: when a start is learned.

    purity is one of purities, by the folds of at most `tuning` training rows; the given one where these can't tell.
    """

    sample: int = 30_000
    lexicon: int = 80
    support: int = 6
    purity: float = 0.8
    purities: tuple[float, ...] = (0.75, 0.85, 0.95)
    tuning: int = 10_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    lexicon: list[str]
    base: float
    trees: list[tuple]
    knots: list[tuple[float, float]]


FEATURES = ("seed", "learned", "any_hit", "near", "capitals", "punctuation", "exclamation", "obfuscated", "mean_word", "log_length")


def _starts(words: list[str]) -> str:
    """A pattern of words that begin with one of the given strings, in lower-case text."""
    import re

    return f"(?<![\\p{{L}}])(?:{'|'.join(re.escape(w) for w in sorted(words, key=lambda w: (len(w), w)))})"


def features(docs: DataFrame, lexicon: list[str], *keep: str) -> DataFrame:
    """The dense features of each row, beside the columns to keep."""
    own = docs.withColumn("low", F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("own", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = own.withColumn("n", F.length("own").cast("double")).withColumn("words", F.greatest(F.lit(1.0), F.size(F.split("own", " ")).cast("double")))
    some = F.lit(False)
    for w in INSULTS:
        some = some | F.contains("low", F.lit(w))
    count = lambda pattern, text="low": F.regexp_count(text, F.lit(pattern)).cast("double")
    own = own.withColumn("hits", F.when(some, count(_starts(list(INSULTS)))).otherwise(0.0))
    own = own.withColumn("more", count(_starts(lexicon)) if lexicon else F.lit(0.0))
    second = "|".join(SECOND)
    close = f"(?<![\\p{{L}}])(?:{second})(?![\\p{{L}}])[^\\n]{{0,40}}?{_starts(list(INSULTS) + lexicon)}"
    letters = F.greatest(F.col("n"), F.lit(1.0))
    share = lambda c: F.length(F.regexp_replace("own", c, "")).cast("double") / letters
    return own.select(
        *keep,
        (F.col("hits") / F.col("words")).alias("seed"),
        (F.col("more") / F.col("words")).alias("learned"),
        (F.col("hits") + F.col("more")).alias("any_hit"),
        (F.when(F.col("hits") + F.col("more") > 0, count(close)).otherwise(0.0) / F.col("words")).alias("near"),
        F.when(F.col("own") == F.col("low"), 0.0).otherwise(1 - share("\\p{Lu}+")).alias("capitals"),
        (1 - share("[^\\p{L}\\p{N}\\s]+")).alias("punctuation"),
        ((F.col("n") - F.length(F.replace("own", F.lit("!"), F.lit("")))) / letters).alias("exclamation"),
        (F.when(_has_odd("own"), count("\\p{L}[@$!*0-9]+\\p{L}")).otherwise(0.0) / F.col("words")).alias("obfuscated"),
        (F.col("n") / F.col("words")).alias("mean_word"),
        F.log1p("n").alias("log_length"),
    )


def _has_odd(text: str) -> Column:
    some = F.contains(text, F.lit("@"))
    for c in "$!*0123456789":
        some = some | F.contains(text, F.lit(c))
    return some


def held_out() -> Column:
    return F.coalesce(crc32_of("doc_id") % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """doc_id, text, toxic, fold of the labelled rows that train: a bounded sample, dealt by a broadcast of its ids."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("fold", crc32_of("doc_id") % 4).filter("fold <> 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")


def _occurrences(rows: DataFrame, *keep: str) -> DataFrame:
    """start, copy, toxic, n and the columns to keep: how often each text holds each word start of 4 to 8 letters; exact copies of a text count once."""
    texts = rows.filter("text is not null").groupBy(F.xxhash64("text").alias("copy")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"), *[F.min(c).alias(c) for c in keep])
    starts = F.flatten(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0)), lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(8))), lambda n: F.substr(w, F.lit(1), n))))
    return texts.select("copy", "toxic", *keep, F.explode(starts).alias("start")).groupBy("start", "copy", *keep).agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))


def _pure(per: DataFrame, p: Params, purity: float) -> list:
    """start, yes, in_toxic, n of the starts that enough toxic texts hold and that hardly stand in any other."""
    counted = per.groupBy("start").agg(F.sum("toxic").alias("yes"), F.sum(F.col("n") * F.col("toxic")).alias("in_toxic"), F.sum("n").alias("n"))
    return counted.filter((F.col("yes") >= p.support) & (F.col("in_toxic") >= purity * F.col("n"))).orderBy(F.desc("yes"), "start").limit(8 * p.lexicon).collect()


def _picked(good: list, p: Params) -> list[str]:
    """The starts that most texts hold, none of them the beginning of another."""
    out: list[str] = []
    for r in sorted(good, key=lambda r: (len(r["start"]), -r["yes"], r["start"])):
        if not any(r["start"].startswith(x) for x in out):
            out.append(r["start"])
    rank = {r["start"]: r["yes"] for r in good}
    return sorted(sorted(out, key=lambda x: (-rank[x], x))[: p.lexicon])


def learned_lexicon(rows: DataFrame, p: Params) -> list[str]:
    """Word starts of 4 to 8 letters that enough toxic texts hold and that hardly stand in any other, by occurrences."""
    return _picked(_pure(_occurrences(rows), p, p.purity), p)


def chosen_purity(rows: DataFrame, p: Params) -> float:
    """The purity whose lexicon and trees, learned from one fold of rows (text, toxic, fold 0 or 1), foretell the other fold best.

    Both ways, by the logarithmic loss, over at most p.tuning rows by the order of a hash; of equal ones the highest. p.purity if a
    fold lacks one of the classes.
    """
    some, path = written(rows.select("text", "toxic", "fold").orderBy(F.xxhash64("text"), "text").limit(p.tuning).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tuning")
    per, starts = written(_occurrences(some, "fold"), "starts")
    loss, known = dict.fromkeys(p.purities, 0.0), {}
    for here in (0, 1):
        good = _pure(per.filter(F.col("fold") == here), p, min(p.purities))
        for purity in p.purities:
            words = tuple(_picked([r for r in good if r["in_toxic"] >= purity * r["n"]], p))
            if (here, words) not in known:
                got = features(some, list(words), "toxic", "fold").toPandas()  # at most p.tuning rows of numbers
                x, y, own = got[list(FEATURES)].to_numpy(float), got["toxic"].to_numpy(float), got["fold"].to_numpy() == here
                if not (0 < y[own].sum() < own.sum() and 0 < y[~own].sum() < (~own).sum()):
                    discard(rows.sparkSession, path, starts)
                    return p.purity
                margin = predict(x[~own], *grow(x[own], y[own], p))
                known[here, words] = float(np.logaddexp(0, np.where(y[~own] > 0, -margin, margin)).mean())
            loss[purity] += known[here, words]
    discard(rows.sparkSession, path, starts)
    return min(p.purities, key=lambda x: (loss[x], -x))


def grow(x: np.ndarray, y: np.ndarray, p: Params) -> tuple[float, list[tuple]]:
    """Boosted trees for the logistic loss, by histograms of up to 64 bins a feature. A tree is (feature, cut, left, right) or a value."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    f = np.full(len(y), base)
    trees = []

    def node(rows: np.ndarray, depth: int, g: np.ndarray, h: np.ndarray):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best, where = 1e-6, None
        if depth and len(rows) >= 8:
            for k, c in enumerate(cuts):
                if len(c):
                    sg = np.cumsum(np.bincount(bins[rows, k], g[rows], len(c) + 1))[:-1]
                    sh = np.cumsum(np.bincount(bins[rows, k], h[rows], len(c) + 1))[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, where = gain[i], (k, i)
        if where is None:
            v = p.rate * total_g / (total_h + 1)
            f[rows] += v
            return float(v)
        k, i = where
        left = bins[rows, k] <= i
        return (k, float(cuts[k][i]), node(rows[left], depth - 1, g, h), node(rows[~left], depth - 1, g, h))

    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-f))
        trees.append(node(np.arange(len(y)), p.depth, y - q, np.maximum(q * (1 - q), 1e-6)))
    return base, trees


def predict(x: np.ndarray, base: float, trees: list[tuple]) -> np.ndarray:
    def value(tree, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(tree, float):
            out[rows] += tree
            return
        k, cut, left, right = tree
        go = x[rows, k] <= cut
        value(left, rows[go], out)
        value(right, rows[~go], out)

    out = np.full(len(x), base)
    for t in trees:
        value(t, np.arange(len(x)), out)
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Pool adjacent violators; knots (mean margin, share) to draw lines between, rising strictly in the margin."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, m2 = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2] + m2]
    knots = [(m / n, (v + 0.02) / (n + 0.2)) for v, n, m in pools]  # a little towards the middle
    out = [(-20.0, min(0.001, knots[0][1])), *knots, (20.0, max(0.999, knots[-1][1]))]
    kept = [out[0]]
    for a, b in out[1:]:
        if a > kept[-1][0] + 1e-9:
            kept.append((a, max(b, kept[-1][1])))
    return kept


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows, path = written(training_rows(docs, labels, p), "sample")  # at most p.sample rows: documents are scanned once for them
    own = rows.filter("fold < 2")
    words = learned_lexicon(own, replace(p, purity=chosen_purity(own, p)))
    got = features(rows, words, "toxic", "fold").toPandas()  # at most p.sample rows of numbers
    discard(docs.sparkSession, path)
    x, y, fold = got[list(FEATURES)].to_numpy(float), got["toxic"].to_numpy(float), got["fold"].to_numpy()
    own = fold < 2
    if not len(y) or not 0 < y[own].sum() < own.sum():
        share = float(y.mean()) if len(y) else 0.0
        return Model([], 0.0, [], [(-20.0, share), (20.0, share)])
    base, trees = grow(x[own], y[own], p)
    rest = ~own if 0 < y[~own].sum() < (~own).sum() else np.ones(len(y), bool)
    return Model(words, base, trees, isotonic(predict(x[rest], base, trees), y[rest]))


def _scored(docs: DataFrame, m: Model, *keep: str) -> DataFrame:
    """The columns to keep, and score.

    Trees and calibration run in an Arrow step over the features. As expressions a filter on the score would be pushed below
    the features and repeat those at each node of each tree.
    """
    bounded_batches(docs.sparkSession)
    own = features(docs, m.lexicon, *keep)
    schema = own.select(*keep).withColumn("score", F.lit(0.0)).schema
    at, share = zip(*m.knots, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1) if len(b) else np.zeros((0, len(FEATURES)))
            score = np.interp(np.clip(predict(x, m.base, m.trees), -19.9, 19.9), at, share)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score, pa.float64())], [*keep, "score"])

    return own.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    own = _scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), train(docs, labels, p), "doc_id")
    return own.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, unchanged, that are not predicted toxic. A row travels as one struct, so its columns may have any name."""
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "text")
    return _scored(own, train(docs, labels, p), "row").filter(F.col("score") < p.threshold).select("row.*")
