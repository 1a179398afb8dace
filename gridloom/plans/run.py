"""A resumable run: jobs through a responder, each answer checked, priced and appended to the log.

What is pending is fixed once, as files of at most `batch` jobs beside the log (`<log>.run`): a file is a batch, and no batch reads what
another one needs. Batches are called in waves: of one at first, then of as many as fit WAVE_S seconds, so that the fixed cost of
a Spark job is shared by batches that are quickly answered, while slow calls are appended batch by batch. A batch becomes visible in the
log by its name alone, at once and with the name in each record; the names there say which are done. Workers save a batch's answers
beside the log as they have called their part of it, so what a lost driver or task makes a run call again is the unsaved part:
at most about a batch, however wide the wave. A wave of many batches for each worker is called first, and its records are made of the saved
answers by all cores: only calls are bound to the workers. The same jobs run again go on where the plan stands; other jobs are planned anew from the log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gridloom.errors import ResponseError
from gridloom.functions.contract import Contract
from gridloom.functions.text import utc_now
from gridloom.operators import attempts
from gridloom.operators.attempts import Pricing
from gridloom.operators.grid import duplicate_ids, job_error, saved_request
from gridloom.operators.validate import validated
from gridloom.shared import discard, exists, listed, store_of, work_path, written
from gridloom.sources.sinks import read_small, write_text
from gridloom.sources.snapshot import Snapshot, append_batch, batch_name, records

USAGE = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint>"
ERROR = "struct<type:string,message:string,request_id:string,phase:string>"
REQUEST = "struct<model:string,instructions:string,input:string,max_output_tokens:int,output_format:string>"
METADATA = "struct<transcript_id:string,transcript_file:string,item_id:string,min_value:double,max_value:double,scoring_values:string,allowed_values:array<string>>"
#: What a call gives; what a record of the log holds.
ANSWER = f"status string, duration_seconds double, model string, output_text string, response_id string, usage {USAGE}, response string, error {ERROR}"
RECORD = (
    f"seq bigint, job_id string, request_hash string, attempt int, status string, recorded_at string, duration_seconds double, metadata {METADATA}, request {REQUEST}, model string, "
    f"output_text string, response_id string, usage {USAGE}, response string, error {ERROR}, contract_id string, validation_status string, parsed_output string, estimated_cost_usd double, "
    "batch string"
)
#: Seconds that a wave of batches should take, and how many times wider than the last one it may be.
WAVE_S, WIDER = 20.0, 4
#: A wave of so many batches for each worker is dealt out by whole batches.
EACH = 4
#: What a responder is given of a job.
ASKED = ["model", "instructions", "prompt", "max_output_tokens", "output_format"]
#: Request -> response. A response is a text, or a dict of status, output_text, model, id, usage, incomplete_reason and response.
Responder = Callable[[dict[str, Any]], Any]


def answer(request: dict[str, Any], responder: Responder) -> dict[str, Any]:
    """One call as the fields of ANSWER; whatever goes wrong becomes a failed answer."""
    began = time.perf_counter()
    out: dict[str, Any] = {"status": "completed", "model": request["model"], "output_text": None, "response_id": None, "usage": None, "response": None, "error": None}
    try:
        said = responder(request)
        said = {"output_text": said} if isinstance(said, str) else dict(said)
        if said.get("status", "completed") != "completed":
            raise ResponseError(said.get("status"), said.get("incomplete_reason"), said.get("id"), said.get("response"))
        out |= {"output_text": said["output_text"], "model": said.get("model") or request["model"], "response_id": said.get("id"), "usage": usage_of(said.get("usage")), "response": said.get("response")}
    except Exception as e:  # a call never stops the run
        error = {"type": type(e).__name__, "message": str(e), "request_id": getattr(e, "request_id", None), "phase": None}
        out |= {"status": "failed", "error": error, "response_id": getattr(e, "response_id", None), "response": getattr(e, "response", None)}
    return out | {"duration_seconds": round(time.perf_counter() - began, 6)}


def usage_of(raw: dict[str, Any] | None) -> dict[str, Any] | None:
    """The five token counts of a response's nested usage; None where it has none."""
    if not raw:
        return None
    deep = lambda a, b: (raw.get(a) or {}).get(b)
    return {
        "input_tokens": raw.get("input_tokens"),
        "cached_input_tokens": raw.get("cached_input_tokens", deep("input_tokens_details", "cached_tokens")),
        "output_tokens": raw.get("output_tokens"),
        "reasoning_tokens": raw.get("reasoning_tokens", deep("output_tokens_details", "reasoning_tokens")),
        "total_tokens": raw.get("total_tokens"),
    }


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a run so far; none where there is no log yet."""
    return records(spark, path, RECORD)


def _keys(jobs: DataFrame) -> DataFrame:
    """What checks and the result need of jobs, which stays when their prompts are gone."""
    return written(jobs.select("job_id", "ordinal", "request_hash", "model", "error"), "job-keys")


def check_run(keys: DataFrame, known: DataFrame, pricing: Pricing | None, contract: Contract | None) -> int:
    """Raise what must stop a run before its first call; else the number of pending jobs. known: what attempts.state() or a snapshot knows of each job."""
    foreign = ~F.col("model").eqNullSafe(F.lit(pricing.model)) if pricing else F.lit(False)
    r = keys.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("job_id", "error"))).alias("wrong"), F.count("*").alias("n"), F.count_distinct("job_id").alias("ids"), F.count_if(foreign).alias("foreign")).first()
    if r["wrong"]:
        raise ValueError(f"job {r['wrong']['job_id']!r}: {r['wrong']['error']}")
    if r["ids"] < r["n"]:
        raise ValueError(f"job {duplicate_ids(keys, 'job_id').agg(F.min('job_id')).first()[0]!r}: job_id values must be unique")
    if r["foreign"]:
        other = [m[0] for m in attempts.foreign_models(keys, pricing.model).orderBy("model").limit(20).collect()]
        raise ValueError(f"pricing is for {pricing.model!r}, but jobs use {other!r}")
    old = known.select("job_id", "status", F.col("request_hash").alias("_old"), "contract_id", "validation_status")
    loose = attempts.without_contract(contract.contract_id) if contract else F.lit(False)
    r = keys.select("job_id", "request_hash").join(old, "job_id", "left").agg(
        F.min(F.when(F.col("request_hash") != F.col("_old"), F.col("job_id"))).alias("changed"), F.min(F.when(loose, F.col("job_id"))).alias("loose"), F.count_if(~F.col("status").eqNullSafe(F.lit("completed"))).alias("pending")
    ).first()
    if r["changed"] is not None:
        raise ValueError(f"job {r['changed']!r} changed since this run was created; use a new output path or a new job_id")
    if r["loose"] is not None:
        raise ValueError(f"job {r['loose']!r} was completed without validation by contract {contract.contract_id!r}; use a new output path")
    return r["pending"]


def run_jobs(
    jobs: DataFrame, log_path: str, responder: Responder, *, pricing: Pricing | None = None, contract: Contract | None = None, workers: int = 1, batch: int = 1000, report: Callable[[str], None] | None = None
) -> DataFrame:
    """Run the jobs that the log hasn't completed; gives each job's current record, in job order when sorted by ordinal.

    jobs: ordinal, job_id, prompt, instructions, model, max_output_tokens, output_format, metadata, request_hash. Batches of at
    most `batch` jobs are called on `workers` tasks, checked against the contract, priced and appended in job order, a wave of them after
    the other; what a lost driver or a failed wave repeats is at most about one batch's calls, which a responder that keeps its
    answers by request makes harmless. seq follows the ordinal over all jobs of a plan. report gets a line after each wave: time,
    time left, cost and projected cost.
    """
    if isinstance(workers, bool) or not isinstance(workers, int) or workers < 1:
        raise ValueError("workers must be a positive integer")
    spark = jobs.sparkSession
    jobs, log_path = jobs.withColumn("error", job_error()), log_path.rstrip("/")
    work = work_path(spark, "jobs")
    jobs.write.parquet(work)  # prompts and hashes are made once
    jobs = spark.read.schema(jobs.schema).parquet(work)
    keys = _keys(jobs)
    snapshot, state_path = Snapshot(spark, log_path, RECORD), f"{log_path}.run"
    plan = _plan(jobs, keys, snapshot, state_path, pricing, contract, batch)
    discard(spark, work)
    if plan["total"]:
        _call_all(spark, plan, state_path, log_path, responder, pricing, contract, workers, report)
    discard(spark, state_path)
    snapshot.compact()
    now = attempts.current_of(keys, snapshot.latest())
    # older records may lack a cost
    return attempts.priced(now, pricing) if pricing else now


def _plan(jobs: DataFrame, keys: DataFrame, snapshot: Snapshot, state_path: str, pricing: Pricing | None, contract: Contract | None, batch: int) -> dict[str, Any]:
    """The plan of an interrupted run of the same jobs, else a new one: start (records before it), total, and the files of todo and batches."""
    spark = jobs.sparkSession
    same = keys.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("job_id", "request_hash", "ordinal")).alias("x")).first()
    if not same["n"]:
        raise ValueError("jobs must contain at least one job")
    digest = [same["n"], same["x"], contract and contract.contract_id, pricing and pricing.as_dict(), "waves"]
    if exists(spark, f"{state_path}/plan.json"):
        plan = json.loads(read_small(spark, f"{state_path}/plan.json"))
        if plan["jobs"] == json.loads(json.dumps(digest)):
            return plan
    discard(spark, state_path)
    known = snapshot.latest()
    total = check_run(keys, known, pricing, contract)
    plan = {"jobs": digest, "start": known.agg(F.max("seq")).first()[0] or 0, "total": total}
    if total:
        todo = attempts.pending_of(jobs.drop("error"), known).withColumn("attempt", F.col("attempt").cast("int"))
        # places are kept as rows are written; what stands in the files before comes from the files' sizes
        todo = todo.repartitionByRange(-(-total // batch), "ordinal").sortWithinPartitions("ordinal").withColumn("_at", F.monotonically_increasing_id())
        todo.write.option("maxRecordsPerFile", batch).parquet(f"{state_path}/todo")
        sizes = spark.read.parquet(f"{state_path}/todo").groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.count("*").alias("rows"), F.min("_at").alias("_first"))
        files = Window.partitionBy(F.lit(0)).orderBy("_first")  # a row for each batch
        before = F.coalesce(F.sum("rows").over(files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes.select("_file", (F.row_number().over(files) - 1).alias("_batch"), (before + 1 - F.col("_first")).alias("_shift")).write.parquet(f"{state_path}/batches")
        done = known.filter("status = 'completed'").join(keys.select("job_id"), "job_id", "left_semi").agg(F.count("estimated_cost_usd"), F.sum("estimated_cost_usd")).first()
        plan |= {"known": done[0], "cost": done[1] or 0.0}
    write_text(spark, f"{state_path}/plan.json", json.dumps(plan))
    return plan


def _call_all(spark: SparkSession, plan: dict, state_path: str, log_path: str, responder: Responder, pricing: Pricing | None, contract: Contract | None, workers: int, report: Callable[[str], None] | None) -> None:
    """Call what is planned, a wave of batches after the other."""
    began, start = time.monotonic(), plan["start"]
    shown = {"attempted": 0, "left": plan["total"], "known": plan["known"], "cost": plan["cost"]}
    if report:  # what an interrupted run has appended
        old = records(spark, log_path, RECORD, batch_name(start, 0)[:-9]).agg(F.count("*"), F.count("estimated_cost_usd"), F.sum("estimated_cost_usd")).first()
        shown |= {"left": shown["left"] - old[0], "known": shown["known"] + old[1], "cost": shown["cost"] + (old[2] or 0.0)}

    saved: str | None = f"{state_path}/answers"
    try:
        store_of(saved)
    except pa.ArrowException:  # a store that tasks can't write to: nothing is saved, so a wave is one batch
        saved = None
    batches, there = spark.read.parquet(f"{state_path}/batches"), set(listed(spark, log_path))
    left = [r for r in batches.select("_file", "_batch").orderBy("_batch").collect() if batch_name(start, r["_batch"]) not in there]
    schema = spark.read.parquet(f"{state_path}/todo").schema if left else None
    at, wide = 0, 1
    while at < len(left):
        since, wave = time.monotonic(), left[at : at + wide]
        own = spark.read.schema(schema).parquet(*[f"{state_path}/todo/{r['_file']}" for r in wave]).withColumn("_file", F.col("_metadata.file_name"))
        own = own.join(F.broadcast(batches), "_file").withColumns({"number": F.col("_at") + F.col("_shift"), "batch": F.format_string("batch-%015d-%09d", F.lit(start), "_batch")})
        if saved and len(wave) >= EACH * workers:
            call_saved(own.coalesce(workers), responder, saved)
            made = answered(own, saved)
        else:
            made = called(own.repartition(workers, "number").sortWithinPartitions("number"), responder, saved)
        made = made.withColumn("seq", F.col("number") + start)
        made = validated(made, contract) if contract else made.withColumns({c: F.lit(None).cast("string") for c in ("contract_id", "validation_status", "parsed_output")})
        made = attempts.priced(made.withColumn("estimated_cost_usd", F.lit(None).cast("double")), pricing).select(*_names(RECORD))
        seen = Observation()
        made = made.observe(seen, F.count("*").alias("n"), F.count("estimated_cost_usd").alias("known"), F.sum("estimated_cost_usd").alias("cost"))
        names = [batch_name(start, r["_batch"]) for r in wave]
        append_batch(made, log_path, names)
        discard(spark, *[f"{state_path}/todo/{r['_file']}" for r in wave], *[f"{saved}/{n}" for n in names if saved])
        if report:
            new = seen.get
            shown.update(attempted=shown["attempted"] + new["n"], left=max(shown["left"] - new["n"], 0), known=shown["known"] + new["known"], cost=shown["cost"] + (new["cost"] or 0.0))
            report(_line(spark, time.monotonic() - began, **shown))
        if saved and at:  # the first wave's time is that of starting
            wide = max(1, min(WIDER * wide, int(wide * WAVE_S / (time.monotonic() - since))))
        at += len(wave)
    discard(spark, *[f"{log_path}/{n}" for n in listed(spark, log_path) if n.startswith(".batch-")])  # what lost drivers left of waves


def _line(spark: SparkSession, elapsed: float, attempted: int, left: int, known: int, cost: float) -> str:
    eta = elapsed / attempted * left if attempted else 0.0
    so_far = cost if known else None
    ahead = cost + cost / known * left if known else None
    value = lambda v: F.lit(v).cast("double")
    return spark.range(1).select(attempts.progress_line(value(elapsed), value(eta), value(so_far), value(ahead))).first()[0]


def called(jobs: DataFrame, responder: Responder, saved: str | None = None) -> DataFrame:
    """The records of one attempt at each job (number, batch, attempt and the columns of run_jobs). Nothing is shuffled behind the calls.

    saved: the folder of answers by batch. Jobs come with those of a batch side by side; what is saved isn't called again.
    """
    rest = ["batch", "job_id", "request_hash", "attempt", "_meta"]
    names = ["number", *rest, *[f"sent_{k}" for k in ASKED], *_names(ANSWER)]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{**row, **{f"sent_{k}": v for k, v in request.items()}, **said} for row, request, said in _said(b, responder, saved)], columns=names)

    sent = "sent_model string, sent_instructions string, sent_prompt string, sent_max_output_tokens int, sent_output_format string"
    own = jobs.withColumn("_meta", F.to_json("metadata", {"ignoreNullFields": "false"})).select("number", *rest, *ASKED)
    made = own.mapInPandas(call, f"number bigint, batch string, job_id string, request_hash string, attempt int, _meta string, {sent}, {ANSWER}")
    return made.withColumns({"request": saved_request("sent_"), "recorded_at": utc_now(), "metadata": F.from_json("_meta", METADATA)}).drop("_meta")


def _said(b: pd.DataFrame, responder: Responder, saved: str | None) -> Iterator[tuple[dict, dict, dict]]:
    """(row, request, answer) of each job; the new answers of a batch are saved when it has been called."""
    for batch, part in groupby(b.to_dict("records"), lambda row: row["batch"]):
        known = saved_answers(f"{saved}/{batch}") if saved else {}
        new, out = [], []
        for row in part:
            request = {k: None if row[k] is None or row[k] != row[k] else row[k] for k in ASKED}
            said = known.get(row["number"])
            if said is None:
                said = answer(request, responder)
                new.append((row["number"], said))
            out.append((row, request, said))
        if saved and new:
            save_answers(f"{saved}/{batch}", new)
        yield from out


def call_saved(jobs: DataFrame, responder: Responder, saved: str) -> None:
    """Call the jobs, as called() does, for their saved answers alone."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(1 for _ in _said(b, responder, saved))]})

    jobs.select("number", "batch", *ASKED).mapInPandas(call, "n bigint").write.format("noop").mode("overwrite").save()


def answered(jobs: DataFrame, saved: str) -> DataFrame:
    """What called() gives, from the saved answers of all jobs. Requests stay where they are; only numbers go to Python."""
    fields = _names(ANSWER)

    @F.pandas_udf(ANSWER)
    def answers(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        at, known = None, {}
        for numbers, names in parts:
            rows = []
            for number, name in zip(numbers, names, strict=True):
                if name != at:
                    at, known = name, saved_answers(f"{saved}/{name}")
                rows.append(known[number])
            yield pd.DataFrame(rows, columns=fields)

    own = jobs.withColumns({f"sent_{k}": F.col(k) for k in ASKED}).drop(*ASKED).withColumn("_said", answers.asNondeterministic()("number", "batch"))
    return own.withColumns({**{c: F.col(f"_said.{c}") for c in fields}, "request": saved_request("sent_"), "recorded_at": utc_now()}).drop("_said")


def save_answers(folder: str, said: list[tuple[int, dict[str, Any]]]) -> None:
    """Answers by job number as a file of their own, which gets its name when it is complete."""
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)
    name = f"{inner}/{uuid.uuid4().hex}"
    with store.open_output_stream(f"{name}.new") as f:
        f.write(json.dumps(said).encode())
    store.move(f"{name}.new", f"{name}.json")


def saved_answers(folder: str) -> dict[int, dict[str, Any]]:
    store, inner = store_of(folder)
    out: dict[int, dict[str, Any]] = {}
    for found in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if found.path.endswith(".json"):
            with store.open_input_stream(found.path) as f:
                out.update(json.loads(f.read()))
    return out


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names
