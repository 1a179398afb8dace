"""The log as a data source: numbers, splits, commits, pruning."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources import log_source
from gridloom.sources.log_source import LogReader, LogWriter


@pytest.fixture
def log(spark, tmp_path):
    log_source.use(spark)
    return str(tmp_path / "log")


def records(spark, low, high, run="a/b ü"):
    own = spark.range(low, high, 1, 3).select(F.lit(run).alias("run"), F.concat(F.lit("j"), F.col("id") % 7).alias("job_id"), F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("status"), F.concat(F.lit('{"n": '), "id", F.lit(', "é": "\\t"}')).alias("line"))
    return own


def save(df, path):
    df.write.format("gridloom_log").mode("append").save(path)


def test_numbers_over_commits_and_splits(spark, log, monkeypatch):
    monkeypatch.setattr(log_source, "MARK", 10)  # on the driver: the tasks write with their own
    assert spark.read.format("gridloom_log").load(log).count() == 0
    save(records(spark, 0, 100), log)
    save(records(spark, 100, 130, "r2"), log)
    save(records(spark, 0, 0), log)
    save(records(spark, 130, 131), log)
    got = spark.read.format("gridloom_log").load(log).collect()
    assert sorted((r["seq"], json.loads(r["line"])["n"], r["job_id"]) for r in got) == [(n + 1, n, f"j{n % 7}") for n in range(131)]
    assert {r["run"] for r in got} == {"a/b ü", "r2"} and json.loads(got[0]["line"])["é"] == "\t"


def test_splits_of_one_file(spark, log, monkeypatch):
    """Written with small marks: as many parts as marks, each line in one of them with its number."""
    monkeypatch.setattr(log_source, "MARK", 7)
    writer = LogWriter(log)
    rows = [{"run": "r", "job_id": f"j{k}", "status": None if k == 3 else "failed", "line": "x" * (k % 4)} for k in range(40)]
    writer.commit([writer.write(iter(rows)), None])
    parts = LogReader(log).partitions()
    assert len(parts) == 6
    read = [r for p in reversed(parts) for b in LogReader(log).read(p) for r in b.to_pylist()]
    assert sorted((r["seq"], r["job_id"], r["status"], r["line"]) for r in read) == [(k + 1, x["job_id"], x["status"], x["line"]) for k, x in enumerate(rows)]
    with pytest.raises(ValueError, match="line break"):
        writer.write(iter([{"run": "r", "job_id": "j", "status": "s", "line": "a\nb"}]))


def test_files_of_other_runs_and_statuses_are_not_opened(spark, log):
    save(records(spark, 0, 30, "r1"), log)
    save(records(spark, 30, 60, "r2"), log)
    save(records(spark, 60, 90, "r3").filter("status = 'completed'"), log)
    for f in os.listdir(f"{log}/run=r2"):
        if f.endswith(".jsonl"):
            os.truncate(f"{log}/run=r2/{f}", 1)
    read = spark.read.format("gridloom_log").load(log)
    assert sorted(r["seq"] for r in read.filter("run = 'r1' and status = 'failed'").collect()) == [1, 6, 11, 16, 21, 26]
    assert read.filter("run in ('r1', 'r3') and job_id = 'j1'").count() == sum(n % 7 == 1 and (n < 30 or n >= 60 and n % 5 > 0) for n in range(90))
    for f in os.listdir(f"{log}/run=r3"):
        os.truncate(f"{log}/run=r3/{f}", 1) if f.endswith(".jsonl") else None
    assert read.filter("run = 'r1'").count() == 30
    reader = LogReader(log)
    assert list(reader.pushFilters([log_source.EqualTo(("status",), "failed")])) == [log_source.EqualTo(("status",), "failed")]
    assert {p.run for p in reader.partitions()} == {"r1", "r2"}


def test_nothing_of_a_failed_write(spark, log):
    save(records(spark, 0, 9), log)
    bad = records(spark, 9, 60).withColumn("line", F.when(F.col("job_id") == "j3", F.lit("a\nb")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="line break"):
        save(bad, log)
    assert spark.read.format("gridloom_log").load(log).count() == 9
    with pytest.raises(Exception, match="append"):
        records(spark, 0, 1).write.format("gridloom_log").mode("overwrite").save(log)
    with pytest.raises(Exception, match="lack status"):
        save(records(spark, 0, 1).drop("status"), log)
