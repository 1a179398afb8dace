"""Hard negatives and the divergence audit against SQL over whole small tables, and against brute force on awkward rows."""

import collections
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("gridloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import divergence, hard_negatives  # noqa: E402

SF = "/root/testdata/sf0.01"
rows_of = lambda df: sorted(map(tuple, df.collect()))


def by_sql(sql, table, columns):
    c = duckdb.connect()
    c.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    return sorted(c.sql(sql).select(*columns).fetchall())


# --- hard negatives


def mined(rows, each=100):
    """Brute force over (vec_id, label, vector) rows; Python's integers."""
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for i, label, v in own:
        if i % each:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in own if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(n, t) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def shifted(df):
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def test_hard_negatives_by_sql(spark):
    got = hard_negatives.mine(shifted(spark.read.parquet(f"{SF}/embeddings.parquet")))
    want = by_sql(hard_negatives.SQL, "embeddings", got.columns)
    assert rows_of(got) == want and len(want) > 50


def test_hard_negatives_in_clusters(spark, monkeypatch):
    """Vectors around few centres, ties and copies, small blocks and chunks: brackets exclude rows and nothing is lost."""
    for k, v in (("BLOCK", 4), ("CHUNK", 64), ("STRIP", 3)):
        monkeypatch.setattr(hard_negatives, k, v)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(int(i), int(rng.integers(0, 3)), (centres[i % 6] + rng.normal(size=8) * 0.1).round(1).tolist()) for i in range(900)]
    rows += [(i + 900, 1, rows[5][2]) for i in range(200)]
    got = hard_negatives.mine(shifted(vectors(spark, rows).withColumn("score", F.lit("clash"))))
    assert rows_of(got) == mined(rows)


def test_brackets_hold_and_exclude(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(8, 16)) * 2000)[rng.integers(0, 8, 600)] + rng.normal(size=(600, 16)) * 20
    x = x.astype(np.int64)
    space = hard_negatives.Space(int((x * x).sum(axis=1).max()), 16, x[:100])
    anchors = hard_negatives.Anchors(space, np.arange(5), np.zeros(5), x[:5])
    to = space.distances(x)
    low, high = anchors.brackets(np.arange(5), to, to)
    true = x[:5] @ x.T
    assert (low <= true).all() and (true <= high).all()
    best = np.sort(true, axis=1)[:, -20][:, None]
    assert (high < best).mean() > 0.5


def test_hard_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.9, 0.4]), (3, 2, [0.8, 0.4]), (4, 2, [0.8, 0.4]), (4, 2, [0.8, 0.4]), (5, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (6, 2, None), (8, 2, [None, 1.0])]
    rows += [(9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (11, 2, []), (12, 2, [0.95]), (13, 1, [-1.0, 0.0]), (7, 9, [0.9, 0.4]), (100, 3, [1.0, 1.0]), (200, 3, [0.0, 0.0, 0.0]), (300, 5, [2.0])]
    pad = lambda v: v if v is None else v + [0.0] * (3 - len(v))
    assert rows_of(hard_negatives.mine(shifted(vectors(spark, rows)))) == mined([(i, c, pad(v)) for i, c, v in rows])
    assert rows_of(hard_negatives.mine(vectors(spark, []))) == rows_of(hard_negatives.mine(vectors(spark, [(1, 1, [1.0])]))) == []
    assert rows_of(hard_negatives.mine(vectors(spark, [(100, 1, []), (1, 1, []), (2, 2, [])]))) == [(100, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="62 bits"):
        hard_negatives.mine(vectors(spark, [(100, 1, [1e20])]))
    wide = [(k, k % 2, [2e5 + k, 1e5 - 3 * k]) for k in range(1, 300)]  # beyond 2^52: integers, not floats
    assert rows_of(hard_negatives.mine(shifted(vectors(spark, wide)))) == mined([(i, c, np.float32(v)) for i, c, v in wide])


# --- divergence


def test_divergence_by_sql(spark):
    got = divergence.audit(spark.read.parquet(f"{SF}/documents.parquet"))
    want = by_sql(divergence.SQL, "documents", got.columns)
    assert rows_of(got) == want and len(want) > 1000


def audited(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in own for t in set(d[2]))
        kept = [t for t in held if held[t] >= least]
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole = sum(count.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in count.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in count.items() if o != s]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("clash"), "n": F.lit(1)})


def test_divergence_against_brute_force(spark):
    """Few documents for a term, many buckets and ties, one wave after the other."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "ñandú", "😀", "ÄB"]
    say = lambda s: " ".join(words[min(int(x) + 20 * s, len(words) - 1)] for x in rng.zipf(1.3, 60) if x < 5000)
    rows = [(f"l{k % 2}", f"s{k % 5}", say(k % 5)) for k in range(200)] + [("l0", None, "A-b_c1d"), (None, None, None), (None, "s1", "x X x"), ("l1", "s9", "")]
    rows += [("l0", "s0", "hot " * 3000)] * 4 + [("l2", "only", "one two")] * 3
    for least, top in ((3, 10), (1, 4), (10**6, 10)):
        assert rows_of(divergence.audit(table(spark, rows), least, top)) == audited(rows, least, top)
    assert rows_of(divergence.audit(table(spark, []))) == []


def test_terms_stop_early(spark):
    """Buckets whose bound is below the k-th value are never evaluated, equal bounds are."""
    rows = [("l", "a", "big " * 400 + "mid " * 60)] * 3 + [("l", s, " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)} " * (1 + k % 29) for k in range(400))) for s in "abc"]
    docs = table(spark, rows)
    posts = divergence.bucketed(divergence.postings(docs, 1)).groupBy("source").agg(F.count_distinct("bucket").alias("n")).collect()
    assert max(r["n"] for r in posts) > divergence.FIRST_WAVE
    assert rows_of(divergence.audit(docs, 1, 2)) == audited(rows, 1, 2)
