import pytest
from pyspark.sql import functions as F

from gridloom.functions.text import Template, categories, duration, py_g, py_round, scale, strip
from gridloom.operators import attempts, privacy, themes, validate
from gridloom.sources import scans, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, strip(F.lit(" \t a b\n"))) == "a b"
    assert one(spark, py_g(F.lit(42.0))) == "42"
    assert one(spark, py_round(2)(F.lit(2.675))) == 2.67
    assert one(spark, duration(F.lit(3725))) == "1:02:05"
    assert [tuple(r) for r in one(spark, scale(F.lit("0 = Low | 1 = High")))] == [(0.0, "Low"), (1.0, "High")]
    assert one(spark, categories(F.lit("Yes | No"))) == ["Yes", "No"]


def test_template(spark):
    t = Template("{{x}} {a}", ["a"])
    assert one(spark, t.render(a=F.lit("{a}"))) == "{x} {a}"
    for bad in ("{b}", "{a!r}", "none"):
        with pytest.raises(ValueError):
            Template(bad, ["a"])


def test_themes(spark):
    m = spark.createDataFrame([("t1", "d1", 5), ("t1", "d2", 3), ("t2", "d3", 5)], "theme_id string, source_id string, importance int")
    assert [(r["theme_id"], r["salience"], r["rank"]) for r in themes.scored(m, 4).orderBy("rank").collect()] == [("t1", 59.0, 1), ("t2", 47.5, 2)]


def test_cost(spark):
    assert one(spark, attempts.token_cost(F.lit(10), F.lit(2), F.lit(1), 1, 0.5, 2)) == pytest.approx(0.000011)


def test_placeholders_by_scope(spark):
    rows = [("T1", "p", "Alice", 1, 0), ("T2", "p", "Bob", 2, 0), ("T1", "p", "Bob", 3, 0), ("T1", "p", "alice", 4, 0)]
    got = privacy.placeholders(spark.createDataFrame(rows, "scope string, label string, original string, seq int, start int"))
    assert {(r["scope"], r["norm"]): r["placeholder"] for r in got.collect()} == {("T1", "alice"): "[P_1]", ("T1", "bob"): "[P_2]", ("T2", "bob"): "[P_1]"}


def test_quotes(spark):
    q = spark.createDataFrame([(1, ""), (1, "b c"), (2, "x"), (9, "x")], "k int, quote string")
    s = spark.createDataFrame([(1, "a b c"), (2, "y")], "k int, text string")
    assert {(r["k"], r["quote"]): r["verified"] for r in validate.quotes(q, s, "k").collect()} == {(1, ""): False, (1, "b c"): True, (2, "x"): False, (9, "x"): False}


def test_sources(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "b.txt").write_text(" two \n")
    (d / "a.txt").write_text("one")
    assert [(r["transcript_id"], r["text"]) for r in scans.text_folder(spark, str(d)).orderBy("filename").collect()] == [("a", "one"), ("b", "two")]
    (d / "c.txt").write_text("\n")
    with pytest.raises(ValueError):
        scans.text_folder(spark, str(d))
    (tmp_path / "i.csv").write_text("﻿item_id,prompt,min_value,max_value\nx,\"say \"\"hi\"\"\",0,10\n")
    r = scans.item_bank(spark, str(tmp_path / "i.csv")).first()
    assert (r["item_id"], r["prompt"], r["min_value"], r["scoring_values"]) == ("x", 'say "hi"', 0.0, "")
    (tmp_path / "l.jsonl").write_text('{"job_id": "a"}\n\n{"job_id": "b"}\n')
    assert [(r["seq"], r["job_id"]) for r in scans.attempt_log(spark, str(tmp_path / "l.jsonl")).select("seq", "job_id").collect()] == [(1, "a"), (3, "b")]
    (tmp_path / "l.jsonl").write_text('{"job_id": "a"}\nnot json\n')
    with pytest.raises(ValueError, match="line 2"):
        scans.attempt_log(spark, str(tmp_path / "l.jsonl"))


def test_write_once(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, str(tmp_path / "plan"))
    sinks.write_once(df, str(tmp_path / "plan"))
    with pytest.raises(ValueError):
        sinks.write_once(spark.range(4), str(tmp_path / "plan"))
