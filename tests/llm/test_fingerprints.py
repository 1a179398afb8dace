"""Winnowing against brute force, over the small table and awkward rows, and its match guarantee."""

import hashlib
import re

import pytest
import xxhash

pytest.importorskip("gridloom.llm")
from gridloom.llm import fingerprints as fp  # noqa: E402

SF = "/root/testdata/sf0.001"


def winnowed(text):
    if not text:
        return []
    alone = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    units = re.findall(f"[ \t-\r]*[^ \t-\r{alone}]{{1,8}}|[ \t-\r]*[{alone}]|[ \t-\r]+", text)
    units = [""] * (fp.K - len(units)) + units
    values = [xxhash.xxh64_intdigest(u.encode(), 42) & 2**30 - 1 for u in units]
    hashes = []
    for i in range(len(values) - fp.K + 1):
        h = 0
        for x in values[i : i + fp.K]:
            h = (h * fp.BASE + x) % fp.PRIME
        hashes.append(h)
    out = {}
    for s in range(1 - fp.W, len(hashes)):
        own = range(max(0, s), min(len(hashes), s + fp.W))
        at = min(own, key=lambda i: (hashes[i], -i))
        out[hashes[at], at] = None
    return list(out)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def rows_of(texts):
    """The report of (doc_id, text) rows, in order of doc_id; equal ids stand in no order of theirs here."""
    out = []
    for k, (i, t) in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        own, other = winnowed(t), winnowed(e)
        shown = [",".join(f"{h:x}:{p}" for h, p in f) for f in (own, other)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *shown, alike(own, other), alike(own, winnowed(n))))
    return out


ODD = ["", "a", "é" * 15, " \t\n", "ab" * 39, "a b c d", "a b c d e", " a b c d e f", None, "😀" * 90, "same", "same", "日本語のテキスト、日本語", "x\x1cy\u00a0z " * 20, "q " * 104, "q " * 12, "r " * 13, "end \n"]


def test_report(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    texts = [(-(2**62), "the least"), *sorted(own), *[(10**18 + k, t) for k, t in enumerate(ODD)]]
    got = fp.report(spark.createDataFrame(texts, "doc_id long, text string").withColumn("range", fp.F.lit("clash")))
    assert sorted(map(tuple, got.collect())) == rows_of(texts)


def test_odd_tables(spark):
    one = lambda rows: sorted(map(repr, map(tuple, fp.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert one([]) == []
    assert one([(None, "alone" * 30)]) == sorted(map(repr, rows_of([(None, "alone" * 30)])))
    assert one([(5, "abcd" * 50)] * 7) == sorted(map(repr, rows_of([(5, "abcd" * 50)] * 7)))
    assert [eval(r)[5:] for r in one([(None, None), (None, "")])] == [(1.0, 1.0)] * 2


def test_long_texts_and_shared_passages(spark):
    passage = " ".join(f"p{i * i}" for i in range(fp.GUARANTEE))
    a, b = "A ".join(map(str, range(40_000))) + " " + passage, "B " + passage + " B".join(map(str, range(50_000, 80_000)))
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").select("doc_id", fp.positions(fp.fingerprint(fp.F.col("text"))).alias("f"))
    found = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["f"]] for r in rows.collect()}
    assert found[1] == winnowed(a) and found[2] == winnowed(b)
    places = [dict(f) for f in found.values()]
    assert any(places[1].get(h) == p - (max(places[0].values()) - fp.W) for h, p in places[0].items()) or set(places[0]) & set(places[1])


def test_likeness_tells_edits_from_strangers(spark):
    got = fp.report(spark.read.parquet(f"{SF}/documents.parquet")).filter("n_chars >= 300").collect()
    assert sum(r["near_edited"] >= 0.5 for r in got) >= 0.9 * len(got)
    assert sum(r["near_next"] < 0.2 for r in got) >= 0.9 * len(got)


def test_plan_is_native(spark):
    plan = fp.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") <= 2
