"""Runs, batches, masking, audits and workflows on small inputs with known results."""

import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridloom.errors import ConfigurationError, ResponseError
from gridloom.functions import items as item_functions
from gridloom.functions.contract import CITED_RATING, DIARY_THEMES, RATING, Contract, Field
from gridloom.functions.text import Template, after, canonical_json, dollars, json_kind, normalized, rstrip
from gridloom.operators import attempts, grid, privacy, themes, validate
from gridloom.operators.attempts import Pricing
from gridloom.plans import batch, chat, workflow
from gridloom.plans.run import read_log, run_jobs
from gridloom.sources import report, scans, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

ITEMS = [("dep", "Rate mood.", 0.0, 100.0, ""), ("mood", "Which?", None, None, "Bad | Good"), ("anx", "Often?", 0.0, 3.0, "0 = Never | 1 = Some | 3 = Daily"), ("sup", "Help?", None, None, "Yes | No")]
PRICE = Pricing("m", 1.0, 0.5, 2.0, "2026-01-01")


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, item_prompt string, min_value double, max_value double, scoring_values string")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def column(df, name, key):
    return {r[key]: r[name] for r in df.collect()}


def test_more_scalars(spark):
    assert one(spark, normalized(F.lit(" Straße  X "))) == "strasse x"
    assert one(spark, after(F.lit("a\nT:\nb\nT:\nc"), "\nT:\n")) == "b\nT:\nc" and one(spark, after(F.lit("a"), "x")) is None
    assert one(spark, rstrip(F.lit(" a \x1c\n"))) == " a"
    assert one(spark, canonical_json(F.lit('{"b": 0.5, "a": [1.0, null, "é"], "c": 1E-5}'))) == '{"a":[1.0,null,"é"],"b":0.5,"c":1e-05}'
    assert [one(spark, dollars(F.lit(v))) for v in (0.00123, 0.5, 2.675)] == ["$0.0012", "$0.50", "$2.67"]
    kinds = [one(spark, json_kind(F.parse_json(F.lit(j)))) for j in ('"a"', "1", "1.5", "true", "null", "[]", "{}")]
    assert kinds == ["text", "number", "number", "flag", "null", "list", "object"]


def test_item_texts(spark, items):
    c = [F.col(x) for x in ("min_value", "max_value", "scoring_values")]
    got = {r["item_id"]: r for r in items.select("item_id", item_functions.response_requirements(*c).alias("r"), item_functions.allowed_values(c[2]).alias("a")).collect()}
    assert got["dep"]["r"] == "Numeric range: 0 to 100.\nAny number in the allowed range." and got["dep"]["a"] == []
    assert got["mood"]["r"] == "Return exactly one of these text responses:\n- Bad\n- Good" and got["mood"]["a"] == ["Bad", "Good"]
    assert got["anx"]["r"] == "Numeric range: 0 to 3.\n0 = Never\n1 = Some\n3 = Daily" and got["anx"]["a"] == ["0.0", "1.0", "3.0"]
    rating = lambda s: json.loads(item_functions.output_format(RATING.output_format, s))["schema"]["properties"]["rating"]
    assert rating("Yes | No") == {"anyOf": [{"type": "string", "enum": ["Yes", "No"]}, {"type": "null"}], "title": "Rating"}
    assert rating("0 = a | 2 = b")["anyOf"][0] == {"type": "integer", "enum": [0, 2]} and rating("0 = a | .5 = b")["anyOf"][0] == {"type": "number", "enum": [0.0, 0.5]} and rating("")["anyOf"][0] == {"type": "number"}


def test_item_errors(spark):
    rows = [
        ("a", "p", 0.0, 1.0, "", None), (" ", "p", 0.0, 1.0, "", "item_id must be a non-empty string"), ("a", "", 0.0, 1.0, "", "item prompt must be a non-empty string"),
        ("a", "p", 0.0, None, "", "item min_value and max_value must both be set or both be blank"), ("a", "p", 1.0, 1.0, "", "item min_value must be less than max_value"),
        ("a", "p", 0.0, 1.0, "0 = x | y", "scoring_values cannot mix numeric labels and text responses"), ("a", "p", 0.0, 1.0, "0 = | 1 = y", 'scoring_values must use "number = label | number = label"'),
        ("a", "p", 0.0, 1.0, "z = x | 1 = y", "scoring values must be numbers"), ("a", "p", 0.0, 1.0, "1 = x | 0 = y", "scoring values must be unique and increasing"),
        ("a", "p", None, None, "Yes | Yes", "text scoring values must be unique"), ("a", "p", None, None, "Yes | ", "text scoring values must be non-empty"), ("a", "p", None, None, "0 = x | 1 = y", "numeric scoring_values require min_value and max_value"),
        ("a", "p", 0.0, 2.0, "0 = x | 1 = y", "scoring_values must start at min_value and end at max_value"), ("a", "p", 0.0, 1.0, "Yes | No", "text scoring_values require blank min_value and max_value"),
        ("a", "p", None, None, "", "items without numeric bounds must define text scoring_values"), ("a", "p", float("inf"), 1.0, "", "item min_value must be finite"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, item_id string, prompt string, low double, high double, s string, want string")
    for r in df.withColumn("got", item_functions.item_error(*map(F.col, ("item_id", "prompt", "low", "high", "s")))).collect():
        assert r["got"] == r["want"], r


def test_contract(spark):
    c = Contract("rating", "1", {"score": Field(("number",)), "note": Field(("text", "null"))})
    texts = ['{"score": 3, "note": null}', "", "not json", '{"score": 3, "note": "x", "more": 1}', '{"score": "3", "note": null}', '{"score": 3}', '{"score": true, "note": "x"}', "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = column(df.select("i", c.error(F.col("t")).alias("e")), "e", "i")
    assert got == {0: None, 1: "Invalid JSON", 2: "Invalid JSON", 3: "more: Extra inputs are not permitted", 4: "score: Input should be number", 5: "note: Field required", 6: "score: Input should be number", 7: "Input should be an object"}
    assert RATING.contract_id == "rating@1" and RATING.output_format["name"] == "rating_v1" and RATING.output_format["strict"]
    bad = '{"themes": [{"label": "a", "description": "b", "quote": "c", "importance": 7}]}'
    assert one(spark, DIARY_THEMES.error(F.lit(bad))) == "themes.importance: Input should be less than or equal to 5"
    two = '{"rating": 1, "justifications": [{"explanation": "e", "citations": []}]}'
    assert one(spark, CITED_RATING.error(F.lit(two))) == "justifications.citations: List should have at least 1 item"


def test_request_hash_is_that_of_canonical_json(spark, items):
    texts = spark.createDataFrame([("T1", "one \"é\"\\ \x0b\x1f\t end", "T1.txt"), ("T2", "two", "T2.txt")], "transcript_id string, text string, filename string")
    t = Template("Item: {item}\n{response_requirements}\nTranscript:\n{transcript}", ["item", "response_requirements", "transcript"])
    jobs = grid.grid(texts, items, t, "m", instructions="Do.", max_output_tokens=100, contract=RATING)
    rows = jobs.collect()
    assert len(rows) == 8 and {r["job_id"] for r in rows} >= {"transcript-T1__item-dep", "transcript-T2__item-sup"}
    for r in rows:
        meta = r["metadata"].asDict()
        if "=" in meta["scoring_values"]:
            meta["allowed_values"] = [float(x) for x in meta["allowed_values"]]
        request = {"model": r["model"], "instructions": r["instructions"], "input": r["prompt"], "max_output_tokens": 100, "output_format": json.loads(r["output_format"]), "metadata": meta}
        assert r["request_hash"] == hashlib.sha256(json.dumps(request, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    more = grid.grid(texts, items, t, "m", instructions="Do more.", max_output_tokens=100, contract=RATING)
    assert not {r["request_hash"] for r in rows} & {r["request_hash"] for r in more.collect()}


def test_job_errors(spark):
    rows = [("a", "p", "m", 5, None), ("a", "p", "m", 5, None), (" ", "p", None, None, None), ("c", " ", None, None, None), ("d", "p", " ", None, None), ("e", "p", None, 0, None), ("f", "p", None, None, "{")]
    got = grid.job_errors(spark.createDataFrame(rows, "job_id string, prompt string, model string, max_output_tokens int, output_format string"))
    assert {(r["job_id"], r["error"].split()[0]) for r in got.collect()} == {("a", "job_id"), (" ", "job_id"), ("c", "prompt"), ("d", "model"), ("e", "max_output_tokens"), ("f", "metadata")}


def jobs_of(spark, prompts, model="m"):
    rows = [(i, f"j{i}", p) for i, p in enumerate(prompts)]
    own = spark.createDataFrame(rows, "ordinal int, job_id string, prompt string")
    meta = F.struct(F.lit("T").alias("transcript_id"), F.lit("T.txt").alias("transcript_file"), F.lit("I").alias("item_id"), F.lit(0.0).alias("min_value"), F.lit(100.0).alias("max_value"), F.lit("").alias("scoring_values"), F.expr("cast(array() as array<string>)").alias("allowed_values"))
    own = own.withColumns({"instructions": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "max_output_tokens": F.lit(None).cast("int"), "output_format": F.lit(None).cast("string"), "metadata": meta})
    return grid.prepared(own, model)


def responder(request):
    p = request["prompt"]
    if p == "boom":
        raise RuntimeError("no")
    if p == "cut":
        return {"status": "incomplete", "incomplete_reason": "max_output_tokens", "id": "r9"}
    if p == "bad":
        return {"output_text": "not json", "usage": {"input_tokens": 10, "input_tokens_details": {"cached_tokens": 2}, "output_tokens": 1, "total_tokens": 11}}
    return {"output_text": json.dumps({"rating": len(p)}), "model": "m-1", "id": f"r-{p}", "usage": {"input_tokens": 10, "input_tokens_details": {"cached_tokens": 2}, "output_tokens": 1, "total_tokens": 11}}


def test_run_resumes(spark, tmp_path):
    log = str(tmp_path / "raw.jsonl")
    jobs = jobs_of(spark, ["aa", "boom", "bad", "cut", "é" * 3])
    rows = run_jobs(jobs, log, responder, pricing=PRICE, contract=RATING, workers=2, batch=2).orderBy("ordinal").collect()
    assert [(r["seq"], r["status"], r["attempt"], r["validation_status"]) for r in rows] == [(1, "completed", 1, "passed"), (2, "failed", 1, "not_run"), (3, "validation_failed", 1, "failed"), (4, "failed", 1, "not_run"), (5, "completed", 1, "passed")]
    assert rows[0]["estimated_cost_usd"] == rows[2]["estimated_cost_usd"] == 0.000011 and rows[1]["estimated_cost_usd"] is None
    assert (rows[1]["error"]["type"], rows[1]["error"]["message"], rows[2]["error"]["phase"], rows[2]["output_text"]) == ("RuntimeError", "no", "validation", "not json")
    assert "incomplete" in rows[3]["error"]["message"] and rows[3]["response_id"] == "r9" and rows[3]["usage"] is None
    assert (rows[0]["model"], rows[1]["model"], rows[0]["request"]["input"], rows[0]["metadata"]["item_id"]) == ("m-1", "m", "aa", "I")
    again = run_jobs(jobs, log, lambda r: json.dumps({"rating": 1}), pricing=PRICE, contract=RATING).orderBy("ordinal").collect()
    assert [(r["seq"], r["status"], r["attempt"]) for r in again] == [(1, "completed", 1), (6, "completed", 2), (7, "completed", 2), (8, "completed", 2), (5, "completed", 1)]
    calls = run_jobs(jobs, log, responder, pricing=PRICE, contract=RATING).count()
    assert calls == 5 and read_log(spark, log).count() == 8
    with pytest.raises(ValueError, match="changed since"):
        run_jobs(jobs_of(spark, ["other"]), log, responder)
    with pytest.raises(ValueError, match="without validation by contract 'rating@2'"):
        run_jobs(jobs, log, responder, contract=Contract("rating", "2"))
    with pytest.raises(ValueError, match="pricing is for 'x'"):
        run_jobs(jobs, log, responder, pricing=Pricing("x", 1, 1, 1, "d"))
    with pytest.raises(ValueError, match="unique"):
        run_jobs(jobs.union(jobs), log, responder)
    assert {(r["job_id"], r["outcome"], r["value"]) for r in batch.check_results(spark, log).collect()} == {("j0", "parsed", "2"), ("j1", "parsed", "1"), ("j2", "parsed", "1"), ("j3", "parsed", "1"), ("j4", "parsed", "3")}


def test_rating_batch(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DEFAULT_MODEL", "m")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "T1.txt").write_text("Ann <ann@x.org> is well.\n")
    (tmp_path / "t" / "T2.txt").write_text("Bob is not.")
    (tmp_path / "items.csv").write_text('item_id,prompt,min_value,max_value,scoring_values\ndep,"Rate, please.",0,100,\nsup,Help?,,,Yes | No\n')
    (tmp_path / "prices.csv").write_text("model,service_tier,input_per_million,cached_input_per_million,output_per_million,as_of,source_url\nm,standard,1,0.5,2,2026-01-01,http://x\n")
    (tmp_path / "prompt.txt").write_text("{item}\n{response_requirements}\nTranscript:\n{transcript}")
    (tmp_path / "do.txt").write_text("Do.\n")
    defaults = {"transcripts": str(tmp_path / "t"), "items": str(tmp_path / "items.csv"), "pricing_file": str(tmp_path / "prices.csv"), "instructions": str(tmp_path / "do.txt")}

    def say(request):
        assert "ann@x.org" not in request["prompt"] and request["output_format"]
        return {"output_text": json.dumps({"rating": "Yes" if "Yes" in request["prompt"] else 117 if "Bob" in request["prompt"] else 42}), "usage": {"input_tokens": 10, "output_tokens": 1, "total_tokens": 11}}

    call = lambda *more: batch.rating_batch(spark, say, prompt=str(tmp_path / "prompt.txt"), runs=str(tmp_path / "runs"), max_output_tokens=100, defaults=defaults, argv=["--run-name", "r1", *more], deidentifier=privacy.Deidentifier(labels=("private_email",)))
    assert call("--dry-run") == 0 and "No API calls made." in capsys.readouterr().out and not (tmp_path / "runs").exists()
    assert call() == 1  # one rating breaks its range
    home = tmp_path / "runs" / "r1"
    rows = spark.read.csv(str(home / "results.csv"), header=True).collect()
    assert rows[0].asDict().keys() == dict.fromkeys(sinks.RESULT_COLUMNS).keys() and [(r["job_id"], r["rating"], r["parse_status"], r["parse_error"]) for r in rows] == [
        ("transcript-T1__item-dep", "42", "parsed", None), ("transcript-T1__item-sup", "Yes", "parsed", None), ("transcript-T2__item-dep", None, "parse_failed", "rating must be between 0 and 100"), ("transcript-T2__item-sup", "Yes", "parsed", None)
    ]
    summary = json.loads((home / "summary.json").read_text())
    assert summary["parsing"] == {"parsed": 3, "not_scored": 0, "parse_failed": 1, "not_parsed": 0, "parse_rate": 0.75} and summary["tokens"]["input_tokens"] == 40 and summary["estimated_cost_usd"] == 0.000048
    assert "ann@x.org" in spark.read.text(str(home / "jobs.jsonl")).filter("value like '%T1__item-dep%'").first()[0]  # the plan is unmasked
    manifest = json.loads((home / "manifest.json").read_text())
    assert manifest["expected_jobs"] == 4 and manifest["run_name"] == "r1" and manifest["sources"]["items"]["sha256"] == hashlib.sha256((tmp_path / "items.csv").read_bytes()).hexdigest() and len(manifest["sources"]["transcripts"]["files"]) == 2
    assert call() == 1 and read_log(spark, str(home / "raw_results.jsonl")).count() == 4
    (tmp_path / "do.txt").write_text("Do otherwise.\n")
    with pytest.raises(ValueError, match="does not match"):
        call()
    for bad in (["--run-name", "../x"], [], ["--run-name", "a", "--workers", "0"]):
        with pytest.raises(SystemExit):
            batch.parse_args(bad, defaults)


def test_summary_counts(spark):
    usage = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint>"
    rows = [("completed", "parsed", (1, None, 2, None, 3), 0.1, 1.0, "b"), ("validation_failed", "not_parsed", None, None, None, "a"), ("failed", "not_parsed", None, None, 0.5, None)]
    got = attempts.summary(spark.createDataFrame(rows, f"status string, parse_status string, usage {usage}, estimated_cost_usd double, duration_seconds double, model string")).first()
    assert (got["total"], got["parse_rate"], got["input_tokens"], got["cached_input_tokens"], got["models"], got["request_runtime_seconds"]) == (3, 0.5, 1, 0, ["a", "b"], 1.5)
    empty = attempts.summary(spark.createDataFrame([], f"status string, parse_status string, usage {usage}, estimated_cost_usd double, duration_seconds double, model string")).first()
    assert (empty["total"], empty["parse_rate"], empty["estimated_cost_usd"]) == (0, None, 0.0)


def test_progress(spark):
    rows = [("r", 1, 2.0, 0.02), ("r", 2, 6.0, None), ("r", 3, 9.0, 0.04)]
    got = attempts.progress(spark.createDataFrame(rows, "run string, seq int, elapsed double, cost double"), F.lit(4)).orderBy("seq").collect()
    assert [(r["remaining"], r["eta"], r["cost_so_far"]) for r in got] == [(3, 6.0, 0.02), (2, 6.0, 0.02), (1, 3.0, 0.06)]
    assert got[2]["projected_cost"] == pytest.approx(0.09) and got[0]["line"] == "elapsed 0:02 | ETA 0:06 | cost ~$0.02 | est. total ~$0.08"


def test_prices():
    for bad in ({"model": " "}, {"as_of": ""}, {"output_per_million": -1}, {"input_per_million": float("nan")}, {"cached_input_per_million": True}):
        with pytest.raises(ValueError):
            Pricing(**({"model": "m", "input_per_million": 1, "cached_input_per_million": 1, "output_per_million": 1, "as_of": "d"} | bad))
    assert PRICE.as_dict()["currency"] == "USD"



def everyone(text):
    import re

    return [("private_person", *m.span()) for m in re.finditer("Alice Smith|Alice|Bob", text)] + [("private_email", *m.span()) for m in re.finditer(r"alice@example\.com", text)]


def test_masking(spark):
    d = privacy.Deidentifier(load=lambda: everyone)
    got = privacy.mask_text(spark, "Alice Smith emailed alice@example.com. Alice Smith followed up.", d)
    assert got["text"] == "[PRIVATE_PERSON_1] emailed [PRIVATE_EMAIL_1]. [PRIVATE_PERSON_1] followed up." and [m["label"] for m in got["matches"]] == ["private_person", "private_email", "private_person"]
    rows = [(1, "T1", 1, "Alice"), (2, "T2", 2, "Bob"), (3, "T1", 3, "Bob"), (4, "T1", 4, "so Alice"), (5, None, 5, "Bob"), (6, None, 6, ""), (7, "T1", 7, None)]
    texts = spark.createDataFrame(rows, "key int, scope string, seq int, text string")
    assert column(privacy.masked(texts, d), "text", "key") == {1: "[PRIVATE_PERSON_1]", 2: "[PRIVATE_PERSON_1]", 3: "[PRIVATE_PERSON_2]", 4: "so [PRIVATE_PERSON_1]", 5: "[PRIVATE_PERSON_1]", 6: "", 7: None}
    subset = privacy.Deidentifier(labels=("private_email",), load=lambda: everyone)
    assert privacy.mask_text(spark, "Alice: alice@example.com", subset)["text"] == "Alice: [PRIVATE_EMAIL_1]"
    with pytest.raises(RuntimeError, match="overlapping"):
        privacy.mask_text(spark, "abcdefghij", privacy.Deidentifier(load=lambda: lambda t: [("secret", 0, 5), ("secret", 3, 8)]))
    for bad in ({"labels": ()}, {"labels": ("x",)}, {"device": "tpu"}):
        with pytest.raises(ValueError):
            privacy.Deidentifier(**bad)
    long = "x" * 700 + "Bob" + "é" * 600 + "Alice" + "y" * 10
    assert privacy.mask_text(spark, long, d)["text"] == long.replace("Bob", "[PRIVATE_PERSON_1]").replace("Alice", "[PRIVATE_PERSON_2]")


def test_summaries_and_preview(spark):
    d = privacy.Deidentifier(load=lambda: everyone, warning="model is old")
    rows = [(1, None, 1, "Alice and Bob"), (2, None, 2, "nobody"), (3, None, 3, "Bob alice@example.com")]
    found = privacy.masked(spark.createDataFrame(rows, "key int, scope string, seq int, text string"), d)
    total = privacy.combined(privacy.summarised(found).withColumn("seq", F.col("key"))).first()
    assert (total["text_count"], total["identifier_count"], total["counts_by_label"], total["warnings"]) == (3, 4, {"private_email": 1, "private_person": 3}, ["model is old"]) and total["labels_applied"] == list(privacy.LABELS)
    parts = privacy.summarised(found).withColumn("seq", F.col("key")).withColumn("half", F.col("key") % 2)
    halves = privacy.combined(parts, "half").withColumn("seq", F.col("half"))
    assert privacy.combined(halves).first() == total
    assert json.loads(privacy.payload(privacy.combined(privacy.summarised(found).withColumn("seq", F.col("key")))).first()["payload"])["counts_by_label"] == {"private_email": 1, "private_person": 3}
    shown = {r["key"]: r["p"] for r in found.select("key", privacy.preview(F.col("text"), F.col("matches"), F.col("warning"), False).alias("p")).collect()}
    assert shown[1] == "[PRIVATE_PERSON_1] and [PRIVATE_PERSON_2]\n\nDetected identifiers:\n- private_person: [hidden] -> [PRIVATE_PERSON_1]\n- private_person: [hidden] -> [PRIVATE_PERSON_2]\n\nWarning: model is old"
    assert "- none" in shown[2]


def test_masked_columns_and_nested(spark):
    d = privacy.Deidentifier(load=lambda: everyone)
    rows = spark.createDataFrame([(1, "p1", "Alice met Bob", 3), (2, "p2", None, 4), (3, "p3", "Bob", 5)], "n int, participant_id string, note string, score int")
    out, summary = privacy.mask_columns(rows, ["note"], "n", d)
    assert column(out, "note", "n") == {1: "[PRIVATE_PERSON_1] met [PRIVATE_PERSON_2]", 2: None, 3: "[PRIVATE_PERSON_2]"} and column(summary, "identifier_count", "n") == {1: 2, 3: 1}
    with pytest.raises(ValueError):
        privacy.mask_columns(rows, ["nope"], "n", d)
    with pytest.raises(TypeError):
        privacy.mask_columns(rows, ["score"], "n", d)
    value = [{"role": "user", "content": [{"type": "input_text", "text": "Alice"}], "id": "Alice"}, {"type": "function_call_output", "call_id": "Bob", "output": {"x": ["Bob", 1]}}, {"type": "other", "output": "Bob"}]
    new, total = privacy.mask_nested(spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps("Bob"))], "n int, v string"), "n", "v", d)
    got = {k: json.loads(v) for k, v in column(new, "v", "n").items()}
    assert got[1] == [{"role": "user", "content": [{"type": "input_text", "text": "[PRIVATE_PERSON_1]"}], "id": "Alice"}, {"type": "function_call_output", "call_id": "Bob", "output": {"x": ["[PRIVATE_PERSON_2]", 1]}}, {"type": "other", "output": "Bob"}]
    assert got[2] == "[PRIVATE_PERSON_2]" and total.first()["identifier_count"] == 3
    jobs = jobs_of(spark, ["Alice and Bob", "Bob"]).withColumn("instructions", F.lit("Ask Bob"))
    hidden, per_job = batch.mask_jobs(jobs, d, "transcript_id")
    assert [(r["prompt"], r["instructions"]) for r in hidden.orderBy("ordinal").collect()] == [("[PRIVATE_PERSON_1] and [PRIVATE_PERSON_2]", "Ask [PRIVATE_PERSON_2]"), ("[PRIVATE_PERSON_2]", "Ask [PRIVATE_PERSON_2]")] and column(per_job, "identifier_count", "job_id") == {"j0": 3, "j1": 2}


def test_rating_rules(spark):
    rows = [
        ("completed", 42.0, None, 0.0, 100.0, [], [], False), ("completed", 101.0, None, 0.0, 100.0, [], [], False), ("completed", None, None, 0.0, 100.0, [], [], True), ("completed", float("nan"), None, 0.0, 100.0, [], [], False),
        ("completed", 2.5, None, 0.0, 3.0, [0.0, 1.0, 2.0, 3.0], [], False), ("completed", 2.0, None, 0.0, 3.0, [0.0, 1.0, 2.0, 3.0], [], False), ("completed", None, "Yes", None, None, [], ["Yes", "No"], False),
        ("completed", None, "Maybe", None, None, [], ["Yes", "No"], False), ("completed", 1.0, None, None, None, [], ["Yes", "No"], False), ("completed", None, None, 0.0, 1.0, [], [], False), ("failed", 1.0, None, 0.0, 1.0, [], [], False), ("completed", None, "x", 0.0, 1.0, [], [], False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status string, n double, t string, lo double, hi double, ns array<double>, ts array<string>, odd boolean")
    got = [tuple(r["x"]) for r in df.select("i", validate.rating_outcome(*map(F.col, ("status", "n", "t", "lo", "hi", "ns", "ts", "odd"))).alias("x")).orderBy("i").collect()]
    assert got == [
        ("42", "parsed", ""), (None, "parse_failed", "rating must be between 0 and 100"), (None, "parse_failed", "rating must be a number, text, or null"), (None, "parse_failed", "rating must be finite"),
        (None, "parse_failed", "rating must be one of: 0, 1, 2, 3"), ("2", "parsed", ""), ("Yes", "parsed", ""), (None, "parse_failed", "rating must be one of: Yes, No"), (None, "parse_failed", "rating must be one of: Yes, No"),
        (None, "not_scored", ""), (None, "not_parsed", ""), (None, "parse_failed", "rating must be a number or null"),
    ]


def test_citations(spark, tmp_path):
    meta = {"transcript_id": "T1", "transcript_file": "T1.txt", "item_id": "I"}
    sent = "Item\nTranscript:\nI sleep badly.\nTranscript:\nno end \n"
    cited = lambda q, r=3: json.dumps({"rating": r, "justifications": [{"explanation": "says so", "citations": [{"text": q}]}]})
    rows = [
        ("ok", "completed", cited("sleep badly"), sent), ("wrong", "completed", cited("sleep well"), sent), ("empty", "completed", cited(""), sent), ("null", "completed", cited("sleep", None), sent),
        ("bare", "completed", '{"rating": 3, "justifications": []}', sent), ("failed", "failed", None, sent), ("unparsed", "completed", None, sent), ("unmarked", "completed", cited("x"), "no marker"),
        ("blank", "completed", '{"rating": 3, "justifications": [{"explanation": " ", "citations": []}]}', sent), ("scored_null", "completed", '{"rating": null, "justifications": []}', sent),
    ]
    df = spark.createDataFrame([(j, s, p, (i,), tuple(meta.values())) for j, s, p, i in rows], "job_id string, status string, parsed_output string, request struct<input:string>, metadata struct<transcript_id:string,transcript_file:string,item_id:string>")
    audited = validate.citation_audit(df)
    got = {r["job_id"]: (r["citation_validation"], r["errors"]) for r in audited.collect()}
    quote = "citation 1.1 is not an exact quote from the transcript sent to the model"
    assert got == {
        "ok": ("passed", []), "wrong": ("failed", [quote]), "empty": ("failed", [quote]), "null": ("failed", ["a null rating must have no justifications"]), "bare": ("failed", ["a scored rating must have at least one justification"]),
        "failed": ("not_run", []), "unparsed": ("failed", ["completed record has no parsed output"]), "unmarked": ("failed", ["saved request does not contain a Transcript section"]),
        "blank": ("failed", ["justification 1 has no explanation", "justification 1 has no citations"]), "scored_null": ("passed", []),
    }
    jobs, citations = validate.citation_exports(audited)
    assert column(jobs, "citation_count", "job_id")["ok"] == 1 and {r["job_id"]: r["quote_verified"] for r in citations.collect()} == {"ok": True, "wrong": False, "empty": False, "null": True}


def test_workflow(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    for i, text in enumerate(["I slept badly.", "I walked far.", "I slept and walked."]):
        (d / f"2026-06-0{i + 1}.txt").write_text(text)
    (tmp_path / "p").mkdir()
    for name, text in (("extract", "{diary_id} {date}\n{diary}"), ("synthesize", "{candidates}"), ("audit", "{theme}\n{diaries}")):
        (tmp_path / "p" / f"{name}.txt").write_text(text)

    def say(request):
        p = request["prompt"]
        if p.startswith("2026"):
            return json.dumps({"themes": [{"label": w, "description": "<b>", "quote": w, "importance": 4} for w in ("slept", "walked") if w in p]})
        if p.startswith("["):
            ids = {w: [c["candidate_id"] for c in json.loads(p) if c["label"] == w] for w in ("slept", "walked")}
            return json.dumps({"themes": [{"title": w, "description": "a < b", "candidate_ids": v} for w, v in ids.items()]})
        day = "2026-06-01" if '"slept"' in p else "2026-06-02"
        return json.dumps({"explanation": "seen & heard", "quotes": [{"diary_id": day, "date": day, "text": "I "}], "uncertainty": "low"})

    scores = workflow.run(spark, scans.diaries(spark, str(d)), str(tmp_path / "p"), str(tmp_path / "run"), say, "m", 2).collect()
    assert [(r["theme_id"], r["source_count"], r["mean_importance"], r["salience"], r["rank"]) for r in scores] == [("theme_01", 2, 4.0, 70.7, 1), ("theme_02", 2, 4.0, 70.7, 2)]
    page = (tmp_path / "run" / "report.html").read_text()
    assert "seen &amp; heard" in page and "a &lt; b" in page and "<strong>4</strong> candidate mentions" in page
    assert [t["theme_id"] for t in json.loads((tmp_path / "run" / "themes.json").read_text())] == ["theme_01", "theme_02"]
    with pytest.raises(RuntimeError, match="theme extraction failed for extract-2026-06-01"):
        workflow.extract(scans.diaries(spark, str(d)), Template("{diary_id} {date} {diary}", ["diary_id", "date", "diary"]), str(tmp_path / "r2"), lambda r: 1 / 0, "m")
    with pytest.raises(ValueError, match="not found in 2026-06-01"):
        workflow.extract(scans.diaries(spark, str(d)), Template("{diary_id} {date} {diary}", ["diary_id", "date", "diary"]), str(tmp_path / "r3"), lambda r: json.dumps({"themes": [{"label": "x", "description": "", "quote": "nowhere", "importance": 1}]}), "m")


def test_membership(spark):
    found = spark.createDataFrame([("c1",), ("c2",)], "candidate_id string")
    check = lambda *m: validate.check_membership(found, spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(m)], "theme_id string, candidate_ids array<string>"))
    check(["c1"], ["c2"])
    for match, bad in (("at least one", (["c1", "c2"], [])), ("more than once", (["c1"], ["c1", "c2"])), (r"missing=\['c2'\], extra=\['c9'\]", (["c1", "c9"],))):
        with pytest.raises(ValueError, match=match):
            check(*bad)


def test_ranks_by_range(spark):
    rows = [(f"t{i:03}", float(i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "theme_id string, salience double")
    want = {t: k + 1 for k, (t, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert column(themes.ranked(df), "rank", "theme_id") == want


def test_report_without_audit(spark):
    t = spark.createDataFrame([("theme_01", "A", "d")], "theme_id string, title string, description string")
    s = spark.createDataFrame([("theme_01", 1, 1, 3.0, 40.0, 1)], "theme_id string, source_count int, candidate_count int, mean_importance double, salience double, rank int")
    a = spark.createDataFrame([], "theme_id string, explanation string, quotes array<struct<text:string,date:string>>")
    assert report.NO_AUDIT in report.cards(t, s, a).first()["card"]


def test_chat(spark):
    sent = []

    def service(request):
        sent.append(request)
        if "fail" in request["input"][-1]["content"]:
            return {"status": "incomplete", "incomplete_reason": "x"}
        return {"output": [{"role": "assistant", "content": "ok"}], "output_text": "ok", "usage": {"input_tokens": 1}}

    c = chat.StatelessConversation(service, model="m", instructions="Be short. Bob", spark=spark, deidentifier=privacy.Deidentifier(load=lambda: everyone))
    assert c.send("I am Alice")["text"] == "ok" and sent[0]["instructions"] == "Be short. [PRIVATE_PERSON_1]" and sent[0]["input"][0]["content"] == "I am [PRIVATE_PERSON_2]"
    with pytest.raises(ResponseError):
        c.send("fail")
    c.send("Alice again")
    assert [x["content"] for x in sent[2]["input"]] == ["I am [PRIVATE_PERSON_2]", "ok", "[PRIVATE_PERSON_2] again"]
    with pytest.raises(ValueError):
        c.send(" ")
    said = iter([{"output": [{"type": "function_call", "name": "f", "call_id": "1", "arguments": '{"x": 2}'}]}, {"output": [], "output_text": "done"}])
    assert chat.tool_loop(lambda r: next(said), "go", {"f": lambda x: str(x * 2)}, [], "m") == "done"
    with pytest.raises(ValueError, match="Unknown tool"):
        chat.tool_loop(lambda r: {"output": [{"type": "function_call", "name": "g", "call_id": "1"}]}, "go", {}, [], "m")
    with pytest.raises(RuntimeError, match="exceeded 8 rounds"):
        chat.tool_loop(lambda r: {"output": [{"type": "function_call", "name": "f", "call_id": "1"}]}, "go", {"f": lambda: ""}, [], "m")


def test_study(spark, tmp_path):
    (tmp_path / "transcripts").mkdir()
    for i, t in enumerate(["a", "b", "c", " "]):
        (tmp_path / "transcripts" / f"p{i}.txt").write_text(t)
    (tmp_path / "items.csv").write_text("item_id,prompt,min_value,max_value\na,p,0,4\nb,q,0,4\n")
    assert json.loads(chat.inspect_study(spark, str(tmp_path))) == {"transcripts_found": 4, "usable_transcripts": 3, "items": 2, "possible_jobs": 6, "ready": False, "issues": ["Blank transcripts: p3.txt"]}
    assert [(r["path"], r["characters"]) for r in scans.study_files(spark, str(tmp_path)).collect()][:2] == [("items.csv", 51), ("transcripts/p0.txt", 1)]
    assert scans.read_study_file("transcripts/p0.txt", str(tmp_path)) == "a"
    (tmp_path / "x.bin").write_text("")
    (tmp_path / "long.md").write_text("x" * 20_001)
    for path, match in (("../x", "inside"), ("nope.txt", "not found"), ("x.bin", "Unsupported"), ("long.md", "too large")):
        with pytest.raises(ValueError, match=match):
            scans.read_study_file(path, str(tmp_path))


def test_scans_say_where(spark, tmp_path, monkeypatch):
    p = tmp_path / "i.csv"
    for text, match in (("item_id,prompt\n", "missing columns: max_value, min_value"), ("item_id,prompt,min_value,max_value\na,p,0,1\n,p,0,1\n", ":3 has a blank item_id"), ("item_id,prompt,min_value,max_value\na,p,x,1\n", ":2: could not convert"), ("item_id,prompt,min_value,max_value\na,p,1,0\n", ":2: item min_value must be less"), ("item_id,prompt,min_value,max_value\na,p,0,1\na,q,0,1\n", "unique"), ("item_id,prompt,min_value,max_value\n", "no data rows")):
        p.write_text(text)
        with pytest.raises(ValueError, match=match):
            scans.item_bank(spark, str(p))
    log = tmp_path / "log.jsonl"
    assert scans.attempt_log(spark, str(log)).count() == 0
    log.write_text("\n".join(json.dumps({"job_id": f"j{i % 3}", "n": i}) for i in range(2000)) + "\n\n")
    assert scans.attempt_log(spark, str(log)).agg(F.max("seq"), F.count("*")).first() == (2000, 2000)
    assert {(r["job_id"], r["ord"], str(r["n"])) for r in scans.latest_lines(spark, str(log)).select("job_id", "ord", F.variant_get("record", "$.n", "int").alias("n")).collect()} == {("j0", 1, "1998"), ("j1", 2, "1999"), ("j2", 3, "1997")}
    with pytest.raises(ValueError, match="no diary files"):
        scans.diaries(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="could not read"):
        scans.item_bank(spark, str(tmp_path / "none.csv"))
    from gridloom import config

    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("DEFAULT_MODEL", raising=False)
    with pytest.raises(ConfigurationError):
        config.default_model()
    (tmp_path / ".env").write_text("# x\nexport DEFAULT_MODEL='m1'\nTIMEOUT=abc\nRETRIES=2\n")
    assert config.default_model() == "m1" and config.whole_number("RETRIES") == 2 and config.positive_number("NONE") is None
    with pytest.raises(ConfigurationError, match="TIMEOUT must be a positive number"):
        config.positive_number("TIMEOUT")


def test_summaries_of_unknown_jobs(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    assert column(attempts.with_summaries(jobs, spark.createDataFrame([("a", 2)], "job_id string, n int")), "n", "job_id") == {"a": 2, "b": None}
    with pytest.raises(ValueError, match="unknown job_id values: z"):
        attempts.with_summaries(jobs, spark.createDataFrame([("z", 2)], "job_id string, n int"))


def test_study_agent(spark, tmp_path):
    (tmp_path / "a.txt").write_text("seven")
    turns = iter([("list_study_files", {}), ("read_study_file", {"path": "a.txt"})])

    def service(request):
        call = next(turns, None)
        if call:
            return {"output": [{"type": "function_call", "name": call[0], "call_id": call[0], "arguments": json.dumps(call[1])}]}
        return {"output": [], "output_text": " / ".join(x["output"] for x in request["input"] if x.get("type") == "function_call_output")}

    assert chat.study_agent(spark, service, str(tmp_path), "What is in it?", "m") == '[{"path": "a.txt", "characters": 5}] / seven'


def test_masked_file_and_time(spark, tmp_path):
    from datetime import datetime

    from gridloom.functions.text import utc_now

    (tmp_path / "a.txt").write_text("Bob is here")
    raw, result = privacy.mask_file(spark, str(tmp_path / "a.txt"), privacy.Deidentifier(load=lambda: everyone))
    assert raw == b"[PRIVATE_PERSON_1] is here" and len(result["matches"]) == 1
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="UTF-8"):
        privacy.mask_file(spark, str(tmp_path / "b.txt"))
    said = datetime.fromisoformat(one(spark, utc_now()))
    assert said.utcoffset().total_seconds() == 0 and abs(said.timestamp() - datetime.now().timestamp()) < 600


def test_pattern_detector():
    found = privacy.pattern_detector('see https://x.org/a?b=1 or a@b.org, +1 (555) 010-9999, token = "abcdef12345", 4111111111111111 on 2020-01-31')
    assert [label for label, _, _ in found] == ["private_url", "private_email", "private_phone", "secret", "account_number", "private_date"]
