"""Runs that are lost on the way, the kept snapshot of the log, progress as attempts come."""

import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridloom.functions.contract import RATING
from gridloom.functions.text import blank
from gridloom.operators import attempts, grid
from gridloom.operators.attempts import Pricing
from gridloom.plans import run
from gridloom.plans.run import RECORD, read_log, run_jobs
from gridloom.sources import snapshot
from gridloom.streaming.progress import live_progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

PRICE = Pricing("m", 1.0, 0.5, 2.0, "2026-01-01")


def jobs_of(spark, n, prompt="p"):
    meta = F.from_json(F.lit("{}"), run.METADATA)
    own = spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("j"), "id").alias("job_id"), F.concat(F.lit(prompt), "id").alias("prompt"))
    own = own.withColumns({"instructions": F.lit(None).cast("string"), "model": F.lit("m"), "max_output_tokens": F.lit(5), "output_format": F.lit(None).cast("string"), "metadata": meta})
    return grid.prepared(own, "m", RATING)


def counting(folder):
    """A responder that leaves a file for each call."""

    def respond(request):
        with open(os.path.join(folder, f"{request['prompt']}-{random.getrandbits(64):x}"), "w"):
            pass
        return {"output_text": '{"rating": 5}', "usage": {"input_tokens": 10, "output_tokens": 1, "total_tokens": 11}}

    return respond


def calls(folder):
    return sorted(f.split("-")[0] for f in os.listdir(folder))


@pytest.mark.parametrize("after", [True, False])
def test_lost_driver(spark, tmp_path, monkeypatch, after):
    """The driver is lost in the second batch: after its append nothing is called twice, before it that batch alone."""
    log, seen = str(tmp_path / "log"), tmp_path / "calls"
    seen.mkdir()
    whole, number = run.append_batch, iter(range(99))

    def lost(records, path, name):
        k = next(number)
        if k == 1 and not after:
            records.write.format("noop").mode("overwrite").save()  # the calls are made
            raise KeyError("lost")
        done = whole(records, path, name)
        if k == 1:
            raise KeyError("lost")
        return done

    monkeypatch.setattr(run, "append_batch", lost)
    with pytest.raises(Exception, match="lost"):
        run_jobs(jobs_of(spark, 10), log, counting(seen), pricing=PRICE, contract=RATING, batch=4, workers=2)
    monkeypatch.setattr(run, "append_batch", whole)
    said = []
    rows = run_jobs(jobs_of(spark, 10), log, counting(seen), pricing=PRICE, contract=RATING, batch=4, workers=2, report=said.append).orderBy("ordinal").collect()
    assert [(r["job_id"], r["seq"], r["attempt"], r["status"]) for r in rows] == [(f"j{i}", i + 1, 1, "completed") for i in range(10)]
    assert read_log(spark, log).count() == 10 and len({r["batch"] for r in rows}) >= 3
    made = calls(seen)
    assert sorted(set(made)) == sorted(f"p{i}" for i in range(10)) and len(made) - 10 == (0 if after else len(made) - len(set(made))) <= 4
    assert said and all(x.startswith("elapsed 0:0") and "ETA" in x and "cost ~$0.0" in x for x in said) and "ETA 0:00" in said[-1]
    assert not os.path.exists(f"{log}.run")


def test_waves(spark, tmp_path, monkeypatch):
    """Batches that are quickly answered are called and written together, each under its own name; what a lost driver had called in a wave isn't called again."""
    log, seen = str(tmp_path / "log"), tmp_path / "calls"
    seen.mkdir()
    whole, waves = run.append_batch, []

    def lost(records, path, names):
        waves.append(names)
        if len(waves) == 3:
            records.write.format("noop").mode("overwrite").save()  # the calls are made
            raise KeyError("lost")
        return whole(records, path, names)

    monkeypatch.setattr(run, "append_batch", lost)
    with pytest.raises(Exception, match="lost"):
        run_jobs(jobs_of(spark, 40), log, counting(seen), pricing=PRICE, contract=RATING, batch=2, workers=2)
    rows = run_jobs(jobs_of(spark, 40), log, counting(seen), pricing=PRICE, contract=RATING, batch=2, workers=2).orderBy("ordinal").collect()
    assert [(r["job_id"], r["seq"], r["attempt"], r["status"]) for r in rows] == [(f"j{i}", i + 1, 1, "completed") for i in range(40)]
    assert calls(seen) == sorted(f"p{i}" for i in range(40))
    names = {r["batch"] for r in rows}
    assert len(names) >= 20 > len(waves) and len(waves[2]) > 1 and names == {f for f in os.listdir(log) if not f.startswith(".")}


def test_other_jobs_after_a_lost_driver(spark, tmp_path, monkeypatch):
    """A plan of other jobs isn't taken up: what the log holds counts, and changed requests still stop the run."""
    log, seen = str(tmp_path / "log"), tmp_path / "calls"
    seen.mkdir()
    whole = run.append_batch
    monkeypatch.setattr(run, "append_batch", lambda *a: whole(*a) and 1 / 0)
    with pytest.raises(Exception, match="division"):
        run_jobs(jobs_of(spark, 4), log, counting(seen), contract=RATING, batch=2)
    monkeypatch.setattr(run, "append_batch", whole)
    with pytest.raises(ValueError, match="changed since this run was created"):
        run_jobs(jobs_of(spark, 4, "q"), log, counting(seen), contract=RATING)
    rows = run_jobs(jobs_of(spark, 6), log, counting(seen), contract=RATING).collect()
    # files of equal age come in any order: what was appended first may be the plan's second half, and the next plan counts on from there
    assert sorted(r["seq"] for r in rows) in ([1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 7, 8]) and calls(seen) == [f"p{i}" for i in range(6)]


SCHEMA = "seq bigint, job_id string, status string, value string, batch string"


def test_snapshot_after_any_appends(spark, tmp_path):
    """Appends and compactions in any order: the snapshot gives what the whole log does, and opens no batch that it has taken in."""
    rng, log = random.Random(4), str(tmp_path / "log")
    kept = snapshot.Snapshot(spark, log, SCHEMA, buckets=4)
    rows_of = lambda df: sorted(map(repr, map(tuple, df.select("job_id", "ord", "attempts", "seq", "status", "value").collect())))
    assert rows_of(kept.latest()) == []
    kept.compact()
    at, every = 0, []
    for k in range(7):
        name = snapshot.batch_name(at, k)
        rows = [(at + i + 1, f"j{rng.randrange(12)}", rng.choice(["completed", "failed"]), None if rng.random() < 0.2 else "é\"\n", name) for i in range(rng.randrange(1, 9))]
        df = spark.createDataFrame(rows, SCHEMA)
        assert snapshot.append_batch(df, log, name) and not snapshot.append_batch(df, log, name)
        at, every = at + len(rows), every + rows
        want = rows_of(attempts.state(spark.createDataFrame(every, SCHEMA)))
        assert rows_of(kept.latest()) == want == rows_of(snapshot.Snapshot(spark, log, SCHEMA).latest())
        if k in (1, 2, 4):
            kept.compact()
            assert rows_of(kept.latest()) == want and kept.tail().count() == 0
            for top, _, files in os.walk(log):
                for f in files:
                    if f.endswith(".txt"):
                        with open(os.path.join(top, f), "w") as out:
                            out.write("not json, and never read")
                    elif f.endswith(".crc"):
                        os.remove(os.path.join(top, f))
    spark.sql(f"drop table {kept._kept()['table']}")  # another session doesn't know the table
    assert rows_of(kept.latest()) == want
    plan = kept.latest()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "FullOuter" in plan


def test_half_a_batch_is_nothing(spark, tmp_path):
    log = tmp_path / "log"
    (log / ".batch-000000000000000-000000000").mkdir(parents=True)
    (log / ".batch-000000000000000-000000000" / "part-0.txt").write_text(json.dumps({"seq": 1, "job_id": "j"}) + "\n{")
    assert read_log(spark, str(log)).count() == 0
    rows = spark.createDataFrame([(1, "j", "failed", None, "b")], SCHEMA)
    assert snapshot.append_batch(rows, str(log), "batch-000000000000000-000000000") and snapshot.records(spark, str(log), SCHEMA).count() == 1


def test_progress_comes_with_the_attempts(spark, tmp_path):
    """Attempts out of order: the lines of a window over the finished run, each as soon as the watermark has passed it."""
    rng = random.Random(1)
    schema = "run string, seq long, elapsed double, cost double, pending long"
    rows = [(f"r{s % 3}", s, s / 4, None if s % 7 == 0 else (s % 64) / 1024, 60) for s in range(400)]
    ends = [(f"r{k}", None, 100.0, None, sum(r[0] == f"r{k}" for r in rows)) for k in range(3)]  # they come before the last attempts do
    arrived = sorted(rows + ends, key=lambda r: r[2] + rng.random() * 15 - 10 * (r[1] is None))
    files = [arrived[k : k + 80] for k in range(0, len(arrived), 80)]
    for k, part in enumerate(files):
        path = tmp_path / "in" / f"{k}"
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(path))
        for f in path.iterdir():
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    batches = {}

    def keep(df, number):
        batches[number] = [tuple(r) for r in df.collect()]

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = live_progress(source, "20 seconds").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = attempts.progress(spark.createDataFrame(rows, schema), F.col("pending"))
    columns = ["run", "seq", "elapsed", "cost", "remaining", "eta", "cost_so_far", "projected_cost"]
    assert sorted(map(repr, (r for b in batches.values() for r in b))) == sorted(repr(tuple(r)) for r in want.select(*columns).collect())
    early = [r for k in sorted(batches)[:4] for r in batches[k]]
    assert len(early) > 100


@pytest.mark.parametrize("lose", [False, True])
def test_wide_waves(spark, tmp_path, monkeypatch, lose):
    """A wave of many batches for each worker is called by the workers alone, each job once; its records are those of narrow waves, made without a shuffle of the texts."""
    log, seen = str(tmp_path / "log"), tmp_path / "calls"
    seen.mkdir()

    def respond(request):
        with open(os.path.join(seen, f"{request['prompt']}-{random.getrandbits(64):x}-{os.getpid()}"), "w"):
            pass
        n = int(request["prompt"][1:])
        if n % 9 == 4:
            raise KeyError("no \"answer\"\n")
        return {"output_text": '{"rating": "é"}' if n % 7 else "x", "id": f"r{n}", "usage": {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1} if n % 5 else None}

    whole, wide = run.append_batch, []

    def append(records, path, names):
        if len(names) >= run.EACH * 2:
            wide.append(records._jdf.queryExecution().executedPlan().toString())
            if lose and len(wide) == 1:
                raise KeyError("lost")
        return whole(records, path, names)

    monkeypatch.setattr(run, "append_batch", append)
    start = lambda: run_jobs(jobs_of(spark, 120), log, respond, pricing=PRICE, contract=RATING, batch=2, workers=2)
    if lose:
        with pytest.raises(Exception, match="lost"):
            start()
    own = [c for c in run._names(RECORD) if c not in ("seq", "batch", "recorded_at", "duration_seconds")]
    rows = start().select("ordinal", *own).orderBy("ordinal").collect()
    monkeypatch.setattr(run, "EACH", 10**9)
    seen.rename(tmp_path / "calls-wide")
    seen.mkdir()
    other = run_jobs(jobs_of(spark, 120), f"{log}-narrow", respond, pricing=PRICE, contract=RATING, batch=2, workers=2).select("ordinal", *own).orderBy("ordinal").collect()
    assert rows == other and {r["status"] for r in rows} == {"completed", "failed", "validation_failed"}
    made = os.listdir(tmp_path / "calls-wide")
    assert wide and not any("Exchange hashpartitioning(number" in p for p in wide)
    assert sorted(f.split("-")[0] for f in made) == sorted(f"p{i}" for i in range(120))
    assert not os.path.exists(f"{log}.run")


def test_first_run_moves_texts_once(spark, tmp_path):
    """Without a log jobs aren't joined with it, and what a compaction has just taken in isn't joined with an empty tail."""
    log = str(tmp_path / "log")
    assert "Join" not in attempts.pending_of(jobs_of(spark, 4), snapshot.Snapshot(spark, log, RECORD).latest())._jdf.queryExecution().optimizedPlan().toString()
    rows = run_jobs(jobs_of(spark, 4), log, lambda request: '{"rating": 5}', contract=RATING)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and rows.count() == 4


def test_blank_is_an_empty_strip(spark):
    """blank() reads a text up to its first other character, and says what Python's strip() does."""
    every = ["", " ", "\n", "a", " a", "a\n", "\x1c\x1f\x85\u2003\u3000", "\u200b", "\x1b", "\n\nx\n\n", "\U0001f600"]
    rows = spark.createDataFrame([(x,) for x in [*every, None]], "x string").select("x", blank(F.col("x")).alias("blank")).collect()
    assert [r["blank"] for r in rows] == [not (x or "").strip() for x in [*every, None]]
