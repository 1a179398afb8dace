"""Operators that deal large groups out: places and sums, placeholders, quotes without a source, histories by reference, hashes in blocks."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import items as item_functions
from gridloom.functions.contract import RATING
from gridloom.operators import grid, privacy, quotes, themes, validate
from gridloom.operators.ordered import running
from gridloom.plans import chat
from gridloom.shared import discard, listed, shared_dir, work_path
from gridloom.sources import scans

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

SF = "/root/testdata/sf0.001"
rows_of = lambda df: sorted(map(repr, map(tuple, df.collect())))


def test_running(spark):
    """A group with most rows, a null group, groups of one: a window's places and sums; the large group lies in many tasks."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 20 + ["b", None, f"g{i}"]), f"t{i:05}", rng.randrange(-9, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t string, v long")
    w = Window.partitionBy("g").orderBy("t")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = running(df, ["g"], ["t"], {"s": F.col("v")})
    assert rows_of(got) == rows_of(want) and rows_of(running(df, ["g"], ["t"])) == rows_of(want.drop("s"))
    whole = df.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")).cast("long"))
    assert rows_of(running(df, [], ["t"])) == rows_of(whole)
    assert rows_of(running(df.limit(0), ["g"], ["t"], {"s": F.col("v")})) == []


def test_placeholders_of_one_scope(spark):
    """One scope with all identifiers: numbers by first appearance, and no task with more than its share."""
    n = 200_000
    found = spark.range(n).select(F.lit(None).cast("string").alias("scope"), F.lit("secret").alias("label"), F.concat(F.lit("S"), F.col("id") * 7919 % n).alias("original"), (F.col("id") * 31 % n).alias("seq"), F.lit(0).alias("start"))
    got = privacy.placeholders(found)
    assert got.withColumn("k", F.regexp_extract("placeholder", "SECRET_([0-9]+)", 1).cast("long")).agg(F.count_distinct("k"), F.min("k"), F.max("k")).first() == (n, 1, n)
    first = found.select(F.lower("original").alias("norm"), "seq").join(got, "norm")
    assert first.filter(F.col("placeholder") != F.concat(F.lit("[SECRET_"), F.col("seq") + 1, F.lit("]"))).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in privacy.placeholders(found).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n


def test_detector_runs_once(spark, tmp_path):
    def found(text):
        with open(tmp_path / f"{random.getrandbits(64):x}", "w"):
            pass
        return [("secret", 0, text.index(" "))]

    texts = spark.createDataFrame([(i, None, i, f"t{i} x") for i in range(20)], "key int, scope string, seq int, text string")
    got = privacy.masked(texts, privacy.Deidentifier(load=lambda: found)).collect()
    assert {r["text"] for r in got} == {f"[SECRET_{i}] x" for i in range(1, 21)} and len(os.listdir(tmp_path)) == 20


def test_nested_masking_is_by_batches(spark):
    values = spark.createDataFrame([(1, '{"input": "a@b.org", "id": "a@b.org"}'), (2, None), (3, '"see c@d.org"')], "n int, value string")
    out = privacy.mask_nested(values, "n", "value")[0]
    assert {r["n"]: r["value"] for r in out.collect()} == {1: '{"input": "[PRIVATE_EMAIL_1]", "id": "a@b.org"}', 2: None, 3: '"see [PRIVATE_EMAIL_2]"'}
    assert "BatchEvalPython" not in out._jdf.queryExecution().toString()


def test_quotes_without_a_source(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    texts += [(-1, "hi"), (-2, ""), (-3, None), (-4, "é😀 ünïcödé 😀"), (-4, "twice"), (-5, "a.b*c\nd" * 40), (-6, "x" * 300)]
    rng = random.Random(5)
    asked = ["", None, "h", "hi", "😀", "ünïcödé 😀", ".", "*c\nda", "x" * 31, "x" * 300, "x" * 301, "no text has this one, or so we hope", "zqzqzq"]
    for i, t in texts:
        if t and len(t) > 20:
            k = rng.randrange(len(t) - 10)
            asked.append(t[k : k + rng.choice([2, 5, 12, 30, 31, 47, 200])])
    asked += asked[-3:]
    q = spark.createDataFrame(list(enumerate(asked)), "quote_id int, quote string")
    got = quotes.holders(q, spark.createDataFrame(texts, "doc_id long, text string").withColumn("quote", F.lit("clash")), "doc_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted({(i, d) for i, a in enumerate(asked) if a for d, t in texts if t and a in t})
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert quotes.holders(q.limit(0), spark.createDataFrame(texts, "key long, text string")).count() == quotes.holders(q, spark.createDataFrame([], "key long, text string")).count() == 0


def test_grams_of_bytes(spark):
    """Kept runs: the least hash of each window, none across two texts, each once; a text of 3 MB is one row, and copies are found as often as they stand there."""
    rng = random.Random(8)
    some = [bytes(rng.choices(b"ab cd", k=n)).decode() for n in (0, 1, 3, 4, 11, 12, 31, 40, 200)]
    for _, gram, window in quotes.LEVELS:
        want = set()
        for i, t in enumerate(some):
            h = quotes._least(np.frombuffer(t.encode(), np.uint8), gram, 1).view(np.int64) if len(t) >= gram else []
            want |= {(i, int(np.array(h[k : k + window]).view(np.uint64).min().view(np.int64))) for k in range(len(h) - window + 1)}
        got = quotes.kept_grams(spark.createDataFrame(list(enumerate(some)), "key int, text string").coalesce(1), "key", "text", gram, window).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    texts = spark.createDataFrame([(1, long), (2, "short one"), (3, long), (3, "short one")], "key int, text string")
    asked = spark.createDataFrame([(1, long[2_000_000:2_000_100]), (1, "ort o"), (2, "ort o")], "quote_id int, quote string")
    assert sorted(map(tuple, quotes.holders(asked, texts).collect())) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]


def test_quotes_without_shuffles_of_texts_or_rows(spark, monkeypatch):
    """Rows are made where a quote is found, in as many passes as there are blocks of quotes, and work tables go; quotes that differ past their first and last bytes, runs of equal bytes and a null id keep their rows."""
    rng = random.Random(11)
    start, end = "".join(rng.choices("ab é", k=quotes.HEAD)), "".join(rng.choices("cd", k=40))
    near = [start + "".join(rng.choices("xyz", k=30)) + end for _ in range(6)]
    texts = [(k, f"{a} | {b}") for k, (a, b) in enumerate(zip(near, near[1:], strict=False))] + [(20, "x" * 400), (21, "x" * 50), (22, "One text. And one more"), (23, "One text. And one more"), (24, "é"), (None, "é One"), (26, "")]
    asked = [*near, start, end, start + end, *("x" * k for k in (1, 2, 3, 4, 11, 12, 30, 31, 50, 51, 299, 300, 400, 401)), *["One"] * 9, "One text", "é", "And one more", "\u00e9 ", "", None]
    rows = [(k or None, a) for k, a in enumerate(asked)]
    want = sorted([(k, t) for k, a in rows if a for t, own in texts if a in own], key=str)
    before = listed(spark, f"{shared_dir(spark)}/gridloom")
    q, held = spark.createDataFrame(rows, "quote_id int, quote string"), spark.createDataFrame(texts, "key long, text string")
    for size in (quotes.BLOCK, 4):
        monkeypatch.setattr(quotes, "BLOCK", size)
        got = quotes.holders(q, held)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert "Exchange" not in got._jdf.queryExecution().toString()
    assert listed(spark, f"{shared_dir(spark)}/gridloom") == before
    # the same in slices of one place and of an id's rows, by parts of one text
    monkeypatch.setattr(quotes, "SLICE", 1)
    monkeypatch.setattr(quotes, "PART", 1)
    home = work_path(spark, "quotes")
    blocks = [quotes._Block(t) for t in quotes._blocks(q, home)]
    discard(spark, home)
    assert len(blocks) > 3
    keys, own = pa.array([k for k, _ in texts], pa.int64()), pa.array([t.encode() for _, t in texts])
    assert sorted((tuple(r.values()) for b in blocks for batch in b.rows(keys, own, ["quote_id", "key"]) for r in batch.to_pylist()), key=str) == want


def test_history_refs(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    long = spark.range(20_000).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("word "), 40).alias("text"))
    both = turns.select("conv_id", F.col("turn").cast("int"), "role", "text").unionByName(long)
    refs = themes.history_refs(both)
    got = {(r["conv_id"], r["turn"]): (r["sent"], r["digest"]) for r in refs.collect()}
    assert len(got) == both.count() and got[-1, 19_999][0] == 20_000
    for conv in {r["conv_id"] for r in turns.collect()}:
        total = 0
        for k, r in enumerate(turns.filter(F.col("conv_id") == conv).orderBy("turn").collect(), 1):
            total += int(hashlib.md5(f"{r['turn']}\x1f{r['role'] or ''}\x1f{r['text'] or ''}".encode()).hexdigest()[:15], 16)
            assert got[conv, r["turn"]] == (k, total % 2**60)
    sent = themes.history_of(both, spark.createDataFrame([(-1, 4), (-1, 2)], "conv_id long, turn int"))
    assert sorted((r["sent_with"], r["turn"]) for r in sent.collect()) == [(2, 0), (2, 1), (2, 2), *[(4, k) for k in range(5)]]


def test_hash_of_a_large_file(spark, tmp_path):
    """A file of over 2 GiB, of which no reader holds more than a block."""
    size = (2 << 30) + 12_345
    with open(tmp_path / "a b.txt", "wb") as f:
        f.truncate(size)
    (tmp_path / "ü.txt").write_bytes(b"\xff\x00abc")
    want = hashlib.sha256()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    want.update(bytes(size & (1 << 20) - 1))
    got = {os.path.basename(r["path"]): r["sha256"] for r in scans.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"a b.txt": want.hexdigest(), "ü.txt": hashlib.sha256(b"\xff\x00abc").hexdigest()}
    assert scans.file_hashes(spark, str(tmp_path / "ü.txt")).collect()[0]["path"] == str(tmp_path / "ü.txt")


def test_no_caps(spark):
    """A scale of 100 labels, more scales than a driver would take, more blank names, a mismatch of many ids."""
    long = " | ".join(f"{k} = L{k}" for k in range(100))
    items = spark.createDataFrame([("a", "p", 0.0, 99.0, long)], "item_id string, item_prompt string, min_value double, max_value double, scoring_values string")
    c = [F.col(x) for x in ("item_id", "item_prompt", "min_value", "max_value", "scoring_values")]
    r = items.select(item_functions.item_error(*c).alias("e"), item_functions.scoring_guide(c[4]).alias("g")).first()
    assert r["e"] is None and r["g"] == "\n".join(f"{k} = L{k}" for k in range(100))
    many = spark.range(150_000).select(F.concat(F.lit("i"), "id").alias("item_id"), F.concat(F.lit("Yes | N"), "id").alias("scoring_values"))
    made = grid.item_formats(many, RATING)
    assert made.filter(F.contains("output_format", F.concat(F.lit('"N'), F.substr("item_id", F.lit(2)), F.lit('"')))).count() == 150_000
    blank = spark.range(150_000).select(F.format_string("%06d", "id").alias("filename"), F.lit(" ").alias("text"))
    issues = chat.inventory(blank, items).first()["issues"]
    assert len(issues[0].split(", ")) == 150_000
    wanted = spark.range(5000).select(F.format_string("c%05d", "id").alias("candidate_id"))
    held = spark.createDataFrame([("t", ["c00000", "x"])], "theme_id string, candidate_ids array<string>")
    with pytest.raises(validate.MembershipError, match=re.escape("'c01000'] and 3999 more, extra=['x']")) as e:
        validate.check_membership(wanted, held)
    assert e.value.rows.count() == 5000
