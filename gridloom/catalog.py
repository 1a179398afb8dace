"""Named queries over the driver's tables, and the DuckDB SQL that checks them.

documents stand for texts, events for the attempt log, lineitem for calls with token counts, conversations for histories.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import items as item_texts
from gridloom.functions import text as texts
from gridloom.functions.contract import RATING
from gridloom.functions.text import Template, categories, duration, html_escape, scale, strip
from gridloom.operators import attempts, grid, privacy, quotes, themes, validate
from gridloom.operators.ordered import running
from gridloom.plans import batch, chat, workflow
from gridloom.plans.run import METADATA, run_jobs
from gridloom.shared import work_path
from gridloom.sources import log_source, report, scans, sinks, snapshot
from gridloom.streaming.progress import live_progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ITEMS = (("dep_01", "How low?", 0.0, 100.0, ""), ("mood_01", "Which mood?", None, None, "Negative | Neutral | Positive"), ("anx_01", "How anxious?", 0.0, 3.0, "0 = Not at all | 1 = Several days | 3 = Nearly every day"), ("support_01", "Support?", None, None, "Yes | No"))
_ITEMS_SQL = "(values " + ", ".join(f"({k + 1}, '{i}', '{p}', {'null' if a is None else a}::double, {'null' if b is None else b}::double, '{s}')" for k, (i, p, a, b, s) in enumerate(ITEMS)) + ") items(ordinal, item_id, item_prompt, min_value, max_value, scoring_values)"
_LOG_SQL = """(select event_id as seq, 'job-' || user_id as job_id, case event_type when 'purchase' then 'completed' when 'view' then 'completed' when 'error' then 'failed' else 'validation_failed' end as status,
 'm' || (user_id % 3) as model, cast(floor(value) as bigint) as tokens, value, sha256(user_id || '-' || (event_id % 50)) as request_hash, (event_id % 7)::double / 4 as duration_seconds,
 case when event_id % 3 = 0 then null else 'rating@' || (event_id % 2) end as contract_id, case when event_id % 5 = 0 then 'failed' else 'passed' end as validation_status,
 json_extract(props, '$.k')::bigint as k from events)"""
_TEXTS_SQL = "(select doc_id as transcript_id, text, doc_id || '.txt' as filename from documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share, for queries that write files and read them back."""
    return work_path(spark, name)


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(ITEMS)], "ordinal int, item_id string, item_prompt string, min_value double, max_value double, scoring_values string")


#: An item bank of as many items as there are parts: a range, two texts, a numeric scale, yes or no.
_BANK_SQL = """(select p_partkey::int + 1 as ordinal, 'i' || p_partkey as item_id, p_name as item_prompt, case when p_partkey % 2 = 0 then 0::double end as min_value,
 case p_partkey % 4 when 0 then p_size::double when 2 then p_size + 1.5 end as max_value,
 case p_partkey % 4 when 0 then '' when 1 then p_brand || ' | ' || p_type when 2 then '0 = Low | ' || (p_size + 1.5)::double || ' = ' || p_name else 'Yes | No' end as scoring_values from part) items"""


def _bank(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    scale = F.when(key == 0, "").when(key == 1, F.concat("p_brand", F.lit(" | "), "p_type")).when(key == 2, F.concat(F.lit("0 = Low | "), F.col("p_size") + F.lit(1.5), F.lit(" = "), "p_name")).otherwise("Yes | No")
    most = F.when(key == 0, F.col("p_size").cast("double")).when(key == 2, F.col("p_size") + F.lit(1.5))
    return _t(spark, d, "part").select((F.col("p_partkey") + 1).cast("int").alias("ordinal"), F.concat(F.lit("i"), "p_partkey").alias("item_id"), F.col("p_name").alias("item_prompt"), F.when(key % 2 == 0, 0.0).alias("min_value"), most.alias("max_value"), scale.alias("scoring_values"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "view"), "completed").when(F.col("event_type") == "error", "failed").otherwise("validation_failed")
    user, event = F.col("user_id"), F.col("event_id")
    return _t(spark, d, "events").select(
        event.alias("seq"), F.concat(F.lit("job-"), user).alias("job_id"), kind.alias("status"), F.concat(F.lit("m"), user % 3).alias("model"),
        F.floor("value").alias("tokens"), "value", F.sha2(F.concat(user, F.lit("-"), event % 50), 256).alias("request_hash"), ((event % 7) / 4).alias("duration_seconds"),
        F.when(event % 3 != 0, F.concat(F.lit("rating@"), event % 2)).alias("contract_id"), F.when(event % 5 == 0, "failed").otherwise("passed").alias("validation_status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("transcript_id"), "text", F.concat("doc_id", F.lit(".txt")).alias("filename"))


@query("select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as n from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def sc1_strip_and_blank_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", strip(F.col("text")).alias("text")).filter("text <> ''").withColumn("n", F.length("text").cast("bigint"))


@query(f"select transcript_id, item_id, 'transcript-' || transcript_id || '__item-' || item_id as job_id, sha256('Item: ' || item_prompt || chr(10) || 'Transcript:' || chr(10) || text) as prompt_sha from {_TEXTS_SQL} t cross join {_ITEMS_SQL}")
def jo1_request_grid(spark, d):
    t = Template("Item: {item}\nTranscript:\n{transcript}", ["item", "transcript"])
    return grid.grid(_texts(spark, d), _items(spark), t, "m0").select("transcript_id", "item_id", "job_id", F.sha2("prompt", 256).alias("prompt_sha"))


@query(f"select item_id, try_cast(trim(split_part(part, '=', 1)) as double) as value, trim(split_part(part, '=', 2)) as label from (select item_id, unnest(string_split(scoring_values, '|')) as part from {_BANK_SQL} where contains(scoring_values, '='))")
def pr3_scale_parse(spark, d):
    return _bank(spark, d).filter(F.contains("scoring_values", F.lit("="))).select("item_id", F.explode(scale(F.col("scoring_values"))).alias("x")).select("item_id", "x.value", "x.label")


@query(f"select item_id, case when contains(scoring_values, '=') or trim(scoring_values) = '' then 0 else len(string_split(scoring_values, '|')) end::bigint as n from {_BANK_SQL}")
def pr4_categories(spark, d):
    return _bank(spark, d).select("item_id", F.size(categories(F.col("scoring_values"))).cast("bigint").alias("n"))


@query(f"select job_id, max(seq) as seq, arg_max(status, seq) as status, arg_max(value, seq) as value, min(seq) as ord from {_LOG_SQL} group by job_id")
def ag1_latest_attempt(spark, d):
    return attempts.latest(_log(spark, d)).select("job_id", "seq", "status", "value", "ord")


@query(f"select job_id, count(*) as attempts from {_LOG_SQL} group by job_id")
def ag2_attempt_counts(spark, d):
    return attempts.attempt_counts(_log(spark, d))


_JOBS_SQL = "(select 'job-' || c_custkey as job_id, sha256(c_custkey || '-7') as request_hash from customer)"


def _jobs(spark, d):
    return _t(spark, d, "customer").select(F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.sha2(F.concat("c_custkey", F.lit("-7")), 256).alias("request_hash"))


@query(f"with log as {_LOG_SQL}, l as (select job_id, arg_max(status, seq) as status, count(*) as n from log group by job_id) select j.job_id, coalesce(n, 0) + 1 as attempt from {_JOBS_SQL} j left join l using (job_id) where status is distinct from 'completed'")
def fi1_pending_jobs(spark, d):
    return attempts.pending(_jobs(spark, d), _log(spark, d)).select("job_id", F.col("attempt").cast("bigint").alias("attempt"))


@query(f"with log as {_LOG_SQL}, l as (select job_id, arg_max(request_hash, seq) as old from log group by job_id) select j.job_id from {_JOBS_SQL} j join l using (job_id) where request_hash <> old")
def fi2_changed_requests(spark, d):
    return attempts.changed_requests(_jobs(spark, d), _log(spark, d))


_COST = "(greatest(l_quantity - coalesce(nullif(l_tax * 100, 0), 0), 0) * 0.75 + coalesce(nullif(l_tax * 100, 0), 0) * 0.075 + l_linenumber * 4.5) / 1e6"


def _calls(spark, d):
    return _t(spark, d, "lineitem").withColumn("cost", attempts.token_cost(F.col("l_quantity"), F.expr("nullif(l_tax * 100, 0)"), F.col("l_linenumber"), 0.75, 0.075, 4.5))


@query(f"select l_orderkey, l_linenumber, round({_COST}, 10) as cost from lineitem")
def fn14_token_cost(spark, d):
    return _calls(spark, d).select("l_orderkey", "l_linenumber", F.round("cost", 10).alias("cost"))


@query("select conv_id, turn, count(*) over w as sent, sha256(string_agg(role || ':' || text, chr(10)) over w) as history_sha from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def wi5_conversation_replay(spark, d):
    own = themes.histories(_t(spark, d, "conversations"))
    text = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return own.select("conv_id", "turn", F.size("history").cast("bigint").alias("sent"), F.sha2(text, 256).alias("history_sha"))


_SPANS = "(select source as scope, 'private_email' as label, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) as original, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), 1) as pos, doc_id as seq from documents)"


def _spans(spark, d):
    hits = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("start", "original")
    return _t(spark, d, "documents").select(F.col("source").alias("scope"), F.lit("private_email").alias("label"), F.col("doc_id").alias("seq"), hits)


@query(f"select scope, label, lower(original) as norm, '[PRIVATE_EMAIL_' || row_number() over (partition by scope, label order by min(seq * 1000 + pos)) || ']' as placeholder from {_SPANS} group by scope, label, lower(original)")
def wi3_placeholders(spark, d):
    return privacy.placeholders(_spans(spark, d))


@query(f"select scope, 'private_email=' || count(*) as counts, count(*) as identifiers from {_SPANS} group by scope")
def ag8_label_counts(spark, d):
    return privacy.label_counts(_spans(spark, d))


@query("select page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as escaped_sha from pages")
def fn9_html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(html_escape(F.col("html")), 256).alias("escaped_sha"))


@query("select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad(((s % 3600) // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end as took from (select event_id, (event_id * 37) % 20000 as s from events)")
def fn18_duration(spark, d):
    return _t(spark, d, "events").select("event_id", duration(F.col("event_id") * 37 % 20000).alias("took"))


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def se2_duplicates(spark, d):
    return grid.duplicate_ids(_t(spark, d, "documents"), "text")


# --- scans and sinks: files are written and read back


def _study(spark: SparkSession, d: str, name: str) -> str:
    """A folder with a text file for each supplier, written by the tasks."""
    folder = _scratch(spark, name)
    own = _t(spark, d, "supplier").select(F.format_string("s%06d.txt", "s_suppkey").alias("name"), F.concat(F.lit(" "), "s_name", F.lit(" of "), "s_nationkey", F.lit("\n")).alias("text"))
    sinks.write_files(own, folder)
    return folder


_STUDY_SQL = "(select 's' || lpad(s_suppkey::varchar, 6, '0') as stem, s_name || ' of ' || s_nationkey as body from supplier)"


def _one_file(lines: DataFrame, path: str) -> str:
    """Lines (at, value) in order as one file in a folder."""
    lines.orderBy("at").coalesce(1).select("value").write.text(path)
    return path


@query(f"select stem as transcript_id, body as text, stem || '.txt' as filename from {_STUDY_SQL}")
def sc1_text_folder(spark, d):
    return scans.text_folder(spark, _study(spark, d, "sc1"))


_CSV = "\ufeffitem_id , prompt,min_value,max_value,scoring_values,more"


@query(f"select ordinal, item_id, item_prompt || ' \"x\", y' as prompt, min_value, max_value, scoring_values from {_BANK_SQL}")
def sc2_item_bank(spark, d):
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit(" "), "item_id", F.lit(' ,"'), "item_prompt", F.lit(' ""x"", y",'), cell("min_value"), F.lit(","), cell("max_value"), F.lit(","), "scoring_values", F.lit(",z"))
    lines = _bank(spark, d).select(F.col("ordinal").alias("at"), line.alias("value")).union(spark.range(1).select(F.lit(0), F.lit(_CSV)))
    return scans.item_bank(spark, _one_file(lines, _scratch(spark, "sc2")))


@query("select 'm' || s_suppkey as model, 'standard' as service_tier, s_nationkey::double / 4 as input_per_million, 0.5::double as cached_input_per_million, 2.0::double as output_per_million, '2026-01-01' as as_of, 'http://x' as source_url from supplier where s_suppkey = 7")
def sc3_pricing(spark, d):
    head = "model,service_tier,input_per_million,cached_input_per_million,output_per_million,as_of,source_url,notes"
    line = F.concat(F.lit("m"), "s_suppkey", F.lit(" ,"), "tier", F.lit(","), F.col("s_nationkey") / 4, F.lit(",0.5,2,2026-01-01,http://x,note"))
    own = _t(spark, d, "supplier").withColumn("tier", F.explode(F.array(F.lit("standard"), F.lit("batch"))))
    path = _one_file(own.select((F.col("s_suppkey") + 1).alias("at"), line.alias("value")).union(spark.range(1).select(F.lit(0), F.lit(head))), _scratch(spark, "sc3"))
    scans.pricing(spark, path, "m7")
    return scans.price_rows(spark, path, "m7")


def _lines(spark: SparkSession, d: str, name: str) -> str:
    path = _scratch(spark, name)
    _t(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.to_json(F.struct(F.concat(F.lit("job-"), "user_id").alias("job_id"), "event_id", "event_type")).alias("value")).write.text(path)
    return path


@query("select row_number() over (order by event_id) as seq, 'job-' || user_id as job_id, event_id from events")
def sc4_attempt_log(spark, d):
    return scans.attempt_log(spark, _lines(spark, d, "sc4")).select("seq", "job_id", F.variant_get("record", "$.event_id", "bigint").alias("event_id"))


@query("with l as (select row_number() over (order by event_id) as seq, * from events) select 'job-' || user_id as job_id, min(seq) as ord, arg_max(event_id, seq) as event_id, arg_max(event_type, seq) as event_type from l group by user_id")
def sc5_latest_lines(spark, d):
    return scans.latest_lines(spark, _lines(spark, d, "sc5")).select("job_id", "ord", F.variant_get("record", "$.event_id", "bigint").alias("event_id"), F.variant_get("record", "$.event_type", "string").alias("event_type"))


@query("select (select count(*) from events) + n as seq, 'o-' || o_custkey as job_id, o_orderkey from (select *, row_number() over (order by o_orderkey) as n from orders) where o_orderstatus = 'F'")
def sc4_log_source(spark, d):
    """The log as a data source: two runs in two commits, read by run and status, with the numbers that the lines have in the whole log."""
    log_source.use(spark)
    path = _scratch(spark, "log")
    events, orders = _t(spark, d, "events"), _t(spark, d, "orders")
    line = lambda *c: F.to_json(F.struct(*c)).alias("line")
    for rows, key in (
        (events.select(F.lit("events").alias("run"), F.concat(F.lit("e-"), "user_id").alias("job_id"), F.col("event_type").alias("status"), line("event_id"), "event_id"), "event_id"),
        (orders.select(F.lit("orders").alias("run"), F.concat(F.lit("o-"), "o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"), line("o_orderkey"), "o_orderkey"), "o_orderkey"),
    ):
        rows.repartitionByRange(key).sortWithinPartitions(key).select("run", "job_id", "status", "line").write.format("gridloom_log").mode("append").save(path)
    read = spark.read.format("gridloom_log").load(path).filter("run = 'orders' and status = 'F'")
    return read.select("seq", "job_id", F.get_json_object("line", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query(f"select stem as diary_id, stem as date, body as text from {_STUDY_SQL}")
def sc6_diaries(spark, d):
    return scans.diaries(spark, _study(spark, d, "sc6"))


@query(f"select stem || '.txt' as path, (length(body) + 2)::int as characters, row_number() over (order by stem)::int as place from {_STUDY_SQL}")
def sc7_study_files(spark, d):
    return running(scans.study_files(spark, _study(spark, d, "sc7")), [], ["path"]).select("path", "characters", F.col("n").cast("int").alias("place"))


@query(f"select stem || '.txt' as name, sha256(' ' || body || chr(10)) as sha256 from {_STUDY_SQL}")
def sc13_file_hashes(spark, d):
    return scans.file_hashes(spark, _study(spark, d, "sc13")).select(F.substring_index("path", "/", -1).alias("name"), "sha256")


@query("select c_custkey as id, c_name || ' é\"' as name, case when c_custkey % 2 = 0 then c_nationkey end as maybe from customer union all select s_suppkey, s_name || ' é\"', null from supplier")
def sk1_append_lines(spark, d):
    path = _scratch(spark, "sk1")
    own = lambda t, p, maybe: _t(spark, d, t).select(F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").alias("id"), F.concat(F.col(f"{p}_name"), F.lit(' é"')).alias("name"), maybe.alias("maybe"))
    sinks.append_lines(own("customer", "c", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))), path)
    sinks.append_lines(own("supplier", "s", F.lit(None).cast("int")), path)
    return spark.read.schema("id bigint, name string, maybe int").json(path)


@query("select '{\"input\":\"Ask ' || c_custkey || '\",\"instructions\":null,\"job_id\":\"job-' || c_custkey || '\",\"max_output_tokens\":5,\"metadata\":{\"segment\":\"' || c_mktsegment || '\"},\"model\":\"m\",\"output_format\":{\"type\":\"text\"}}' as value from customer")
def sk3_job_plan(spark, d):
    path = _scratch(spark, "sk3")
    for _ in range(2):  # the same plan again is no-op
        sinks.write_job_plan(_asks(spark, d).withColumn("output_format", F.lit('{"type": "text"}')), path)
    return spark.read.text(path)


def _asks(spark, d):
    own = _t(spark, d, "customer").select(F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.concat(F.lit("Ask "), "c_custkey").alias("prompt"), F.struct(F.col("c_mktsegment").alias("segment")).alias("metadata"))
    return own.withColumns({"model": F.lit("m"), "instructions": F.lit(None).cast("string"), "max_output_tokens": F.lit(5), "output_format": F.lit(None).cast("string")})


# --- items, requests


@query(f"select item_id, case when contains(scoring_values, '=') then list_transform(string_split(scoring_values, '|'), lambda x: trim(split_part(x, '=', 1))::double::varchar) when scoring_values = '' then [] else list_transform(string_split(scoring_values, '|'), lambda x: trim(x)) end::varchar[] as allowed from {_BANK_SQL}")
def pr5_allowed_values(spark, d):
    return _bank(spark, d).select("item_id", item_texts.allowed_values(F.col("scoring_values")).alias("allowed"))


_GUIDE = "case when scoring_values = '' then 'Any number in the allowed range.' when contains(scoring_values, '=') then array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: printf('%g', trim(split_part(x, '=', 1))::double) || ' = ' || trim(split_part(x, '=', 2))), chr(10)) else 'Return exactly one of these text responses:' || chr(10) || array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: '- ' || trim(x)), chr(10)) end"
_NEEDS = f"case when min_value is null then {_GUIDE} else 'Numeric range: ' || printf('%g', min_value) || ' to ' || printf('%g', max_value) || '.' || chr(10) || {_GUIDE} end"


@query(f"select item_id, {_GUIDE} as guide, {_NEEDS} as needs from {_BANK_SQL}")
def pr7_response_requirements(spark, d):
    c = [F.col(x) for x in ("min_value", "max_value", "scoring_values")]
    return _bank(spark, d).select("item_id", item_texts.scoring_guide(c[2]).alias("guide"), item_texts.response_requirements(*c).alias("needs"))


_WHOLE = "len(list_filter(string_split(scoring_values, '|'), lambda x: contains(split_part(x, '=', 1), '.'))) = 0"
_ENUM = "case when scoring_values = '' then '{\"type\":\"number\"}' when contains(scoring_values, '=') then '{\"enum\":[' || array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: case when " + _WHOLE + " then trim(split_part(x, '=', 1)) else trim(split_part(x, '=', 1))::double::varchar end), ',') || '],\"type\":\"' || case when " + _WHOLE + " then 'integer' else 'number' end || '\"}' else '{\"enum\":[' || array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: '\"' || trim(x) || '\"'), ',') || '],\"type\":\"string\"}' end"
_FORMAT = "'{\"name\":\"rating_v1\",\"schema\":{\"additionalProperties\":false,\"properties\":{\"rating\":{\"anyOf\":[' || " + _ENUM + " || ',{\"type\":\"null\"}],\"title\":\"Rating\"}},\"required\":[\"rating\"],\"title\":\"rating\",\"type\":\"object\"},\"strict\":true,\"type\":\"json_schema\"}'"


@query(f"select item_id, {_FORMAT} as format from {_BANK_SQL}")
def pr10_output_format(spark, d):
    return grid.item_formats(_bank(spark, d), RATING).select("item_id", texts.canonical_json("output_format").alias("format"))


_ALLOWED = "case when scoring_values = '' then '[]' when contains(scoring_values, '=') then '[' || array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: trim(split_part(x, '=', 1)) || '.0'), ',') || ']' else '[' || array_to_string(list_transform(string_split(scoring_values, '|'), lambda x: '\"' || trim(x) || '\"'), ',') || ']' end"
_NUMBER = lambda c: f"coalesce(printf('%.1f', {c}), 'null')"
_META = f"'{{\"allowed_values\":' || {_ALLOWED} || ',\"item_id\":\"' || item_id || '\",\"max_value\":' || {_NUMBER('max_value')} || ',\"min_value\":' || {_NUMBER('min_value')} || ',\"scoring_values\":\"' || scoring_values || '\",\"transcript_file\":\"' || filename || '\",\"transcript_id\":\"' || transcript_id || '\"}}'"


@query(f"select 'transcript-' || transcript_id || '__item-' || item_id as job_id, sha256('{{\"input\":' || to_json(item_prompt || chr(10) || {_NEEDS} || chr(10) || 'Transcript:' || chr(10) || text)::varchar || ',\"instructions\":\"Do.\",\"max_output_tokens\":100,\"metadata\":' || {_META} || ',\"model\":\"m0\",\"output_format\":' || {_FORMAT} || '}}') as request_hash from {_TEXTS_SQL} t cross join {_ITEMS_SQL}")
def pr12_request_hash(spark, d):
    t = Template("{item}\n{response_requirements}\nTranscript:\n{transcript}", ["item", "response_requirements", "transcript"])
    return grid.grid(_texts(spark, d), _items(spark), t, "m0", instructions="Do.", max_output_tokens=100, contract=RATING).select("job_id", "request_hash")


@query("select 'job-' || c_custkey as job_id, case when c_custkey % 3 = 0 then 'm1' else 'm0' end as model, sha256('{\"input\":\"Ask ' || c_custkey || '\",\"instructions\":null,\"max_output_tokens\":5,\"metadata\":{\"segment\":\"' || c_mktsegment || '\"},\"model\":\"' || case when c_custkey % 3 = 0 then 'm1' else 'm0' end || '\",\"output_format\":null}') as request_hash from customer")
def pr13_default_model(spark, d):
    own = _asks(spark, d).withColumn("model", F.when(F.expr("cast(substr(job_id, 5) as int) % 3 = 0"), "m1"))
    return grid.prepared(own, "m0").select("job_id", "model", "request_hash")


@query("select 'job-' || c_custkey as job_id, 'm' as model, null::varchar as instructions, 'Ask ' || c_custkey as input, 5 as max_output_tokens, null::varchar as output_format from customer")
def pr15_saved_request(spark, d):
    return _asks(spark, d).select("job_id", grid.saved_request().alias("r")).select("job_id", "r.*")


# --- guards and joins on the log


_JOBS2_SQL = "(select 'job-' || c_custkey as job_id, c_custkey as ordinal, 'm' || (c_custkey % 2) as model, case when c_custkey % 11 = 0 then ' ' else 'p' end as prompt, (c_custkey % 13)::int as cap from customer union all select 'job-1', 1, 'm1', 'p', 1)"


def _jobs2(spark, d):
    own = _t(spark, d, "customer").select(F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("m"), F.col("c_custkey") % 2).alias("model"), F.when(F.col("c_custkey") % 11 == 0, " ").otherwise("p").alias("prompt"), (F.col("c_custkey") % 13).cast("int").alias("max_output_tokens"))
    return own.union(spark.createDataFrame([("job-1", 1, "m1", "p", 1)], own.schema)).withColumn("output_format", F.lit(None).cast("string"))


@query(f"with log as {_LOG_SQL}, l as (select job_id, arg_max(status, seq) as status, max(seq) as last from log group by job_id) select j.job_id from {_JOBS_SQL} j join l using (job_id) join log on log.seq = l.last where l.status = 'completed' and (contract_id is distinct from 'rating@1' or validation_status is distinct from 'passed')")
def fi3_unvalidated(spark, d):
    return attempts.unvalidated(_jobs(spark, d), _log(spark, d), "rating@1")


@query(f"select distinct model from {_JOBS2_SQL} where model <> 'm1'")
def fi4_foreign_models(spark, d):
    return attempts.foreign_models(_jobs2(spark, d), "m1")


@query(f"select job_id, case when trim(prompt) = '' then 'prompt must be a non-empty string' else 'max_output_tokens must be a positive integer' end as error from {_JOBS2_SQL} where trim(prompt) = '' or cap <= 0 union all select job_id, 'job_id values must be unique' from {_JOBS2_SQL} group by job_id having count(*) > 1")
def fi11_job_errors(spark, d):
    return grid.job_errors(_jobs2(spark, d))


@query("select p_partkey as id, case when p_partkey % 7 = 0 then 'item_id must be a non-empty string' when p_size % 3 = 0 then 'item min_value and max_value must both be set or both be blank' when p_size >= 25 then 'item min_value must be less than max_value' when p_partkey % 5 = 0 then 'scoring_values cannot mix numeric labels and text responses' when p_partkey % 5 = 1 then 'scoring_values must start at min_value and end at max_value' when p_partkey % 5 = 2 then 'text scoring_values require blank min_value and max_value' end as error from part")
def fi12_item_errors(spark, d):
    own = _t(spark, d, "part").withColumn("scale", F.when(F.col("p_partkey") % 5 == 0, "1 = a | b").when(F.col("p_partkey") % 5 == 1, "-1 = a | 2 = b").when(F.col("p_partkey") % 5 == 2, "Yes | No").otherwise(""))
    wrong = item_texts.item_error(F.when(F.col("p_partkey") % 7 == 0, " ").otherwise("i"), F.lit("p"), F.col("p_size").cast("double"), F.when(F.col("p_size") % 3 != 0, 25.0), F.col("scale"))
    return own.select(F.col("p_partkey").alias("id"), wrong.alias("error"))


@query(f"with log as {_LOG_SQL} select j.ordinal, l.job_id, l.seq, l.status, l.ord from (select distinct job_id, ordinal from {_JOBS2_SQL}) j join (select job_id, max(seq) as seq, arg_max(status, seq) as status, min(seq) as ord from log group by job_id) l using (job_id)")
def jo4_current_records(spark, d):
    return attempts.current(_jobs2(spark, d).distinct(), _log(spark, d)).select("ordinal", "job_id", "seq", "status", "ord")


@query("select 'job-' || c_custkey as job_id, n from customer left join (select o_custkey as c_custkey, count(*) as n from orders group by 1) using (c_custkey)")
def jo6_with_summaries(spark, d):
    counts = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("job-"), "o_custkey").alias("job_id"), "n")
    return attempts.with_summaries(_jobs(spark, d).select("job_id"), counts)


# --- themes: a theme is fifty documents, its candidates each of them, their diaries the languages

_THEME = "'t' || (doc_id // 50)"
_SCORES = f"(select {_THEME} as theme_id, count(distinct lang) as source_count, count(*) as candidate_count, avg(1 + doc_id % 5) as mean_importance, 0.7::double * (100::double * count(distinct lang) / 4) + 0.3::double * (avg(1 + doc_id % 5) / 5 * 100) as salience from documents group by 1)"
_ROUNDED = f"(select theme_id, source_count, candidate_count, printf('%.2f', mean_importance)::double as mean_importance, printf('%.1f', salience)::double as salience from {_SCORES})"


def _themes(spark, d):
    return _t(spark, d, "documents").groupBy(F.concat(F.lit("t"), F.expr("doc_id div 50")).alias("theme_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("c"), "doc_id"))).alias("candidate_ids"))


def _found(spark, d):
    return _t(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), F.col("lang").alias("diary_id"), (1 + F.col("doc_id") % 5).alias("importance"))


@query(f"select {_THEME} as theme_id, 'c' || doc_id as candidate_id, lang as source_id, 1 + doc_id % 5 as importance from documents")
def jo8_members(spark, d):
    return themes.members(_themes(spark, d), _found(spark, d))


@query(f"select distinct lang as diary_id, {_THEME} as theme_id, upper(lang) as name from documents join (select distinct lang from documents) using (lang)")
def jo9_theme_sources(spark, d):
    langs = _t(spark, d, "documents").select(F.col("lang").alias("diary_id")).distinct().withColumn("name", F.upper("diary_id"))
    return themes.sources_of(_themes(spark, d), _found(spark, d), langs)


@query(f"select *, row_number() over (order by salience desc, theme_id)::int as rank from {_ROUNDED}")
def ag6_theme_scores(spark, d):
    return themes.scored(themes.members(_themes(spark, d), _found(spark, d)), 4)


@query(f"select theme_id, salience from {_ROUNDED} order by salience desc, theme_id limit 3")
def so2_top_themes(spark, d):
    return themes.top(themes.scored(themes.members(_themes(spark, d), _found(spark, d)), 4)).select("theme_id", "salience")


@query(f"select count(distinct {_THEME}) as themes, count(*) as mentions, (select count(*) from benchmark) as audits from documents")
def ag11_report_totals(spark, d):
    return themes.report_totals(themes.raw_scores(themes.members(_themes(spark, d), _found(spark, d)), 4), _t(spark, d, "benchmark"))


@query("select doc_id, number, element from (select doc_id, unnest(string_split(text, ' ')) as element, generate_subscripts(string_split(text, ' '), 1)::int as number from documents)")
def wi6_positions(spark, d):
    return themes.numbered(_t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words")), "words", "doc_id")


@query("select conv_id || '-c' || lpad((turn + 1)::varchar, 2, '0') as id from conversations")
def pr21_padded_ids(spark, d):
    return _t(spark, d, "conversations").select(texts.padded(F.col("conv_id").cast("string"), "-c", F.col("turn")).alias("id"))


@query(f"select rank, sha256('<article><p>' || printf('%02d', rank) || ' ' || theme_id || '</p><h2>' || upper(theme_id) || ' &amp;</h2><p>' || printf('%.1f', salience) || '</p><p>&lt;' || theme_id || '&gt;</p><p><strong>' || source_count || '</strong> diary days, <strong>' || candidate_count || '</strong> mentions, <strong>' || printf('%.1f', mean_importance) || '</strong> mean importance</p><h3>Evidence audit</h3><p>' || case when rank <= 3 then 'seen &#x27;&quot;</p><blockquote>q&lt;<cite>d</cite></blockquote>' else 'Evidence audit not requested for this theme.</p>' end || '</article>') as card from (select *, row_number() over (order by salience desc, theme_id)::int as rank from {_ROUNDED})")
def sk9_report_cards(spark, d):
    scores = themes.scored(themes.members(_themes(spark, d), _found(spark, d)), 4)
    named = _themes(spark, d).select("theme_id", F.concat(F.upper("theme_id"), F.lit(" &")).alias("title"), F.concat(F.lit("<"), "theme_id", F.lit(">")).alias("description"))
    audits = themes.top(scores).select("theme_id", F.lit("seen '\"").alias("explanation"), F.array(F.struct(F.lit("q<").alias("text"), F.lit("d").alias("date"))).alias("quotes"))
    return report.cards(named, scores, audits).select("rank", F.sha2("card", 256).alias("card"))


# --- costs, summary, progress


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"


@query(f"select l_orderkey, l_linenumber, round(sum({_COST}) over w, 12) as cost_so_far, round(avg({_COST}) over w, 12) as mean_cost from lineitem window w as (partition by l_orderkey order by {_ORDER} rows between unbounded preceding and current row)")
def wi4_running_cost(spark, d):
    own = attempts.running_cost(_calls(spark, d), "l_orderkey", *_ORDER.split(", ")[:1], "cost", *_ORDER.split(", ")[1:])
    return own.select("l_orderkey", "l_linenumber", F.round("cost_so_far", 12).alias("cost_so_far"), F.round("mean_cost", 12).alias("mean_cost"))


_PROGRESS = """with e as (select user_id as run, event_id as seq, event_id::double / 8 as elapsed, case when event_type <> 'error' then floor(value) / 1024 end as cost from events),
 w as (select *, row_number() over x as n, greatest(60 - row_number() over x, 0) as remaining, count(cost) over x as known, sum(cost) over x as total from e window x as (partition by run order by seq rows between unbounded preceding and current row))
 select run, seq, remaining::int as remaining, case when remaining > 0 then elapsed / n * remaining else 0 end as eta, case when known > 0 then total end as cost_so_far, case when known > 0 then total + total / known * remaining end as projected_cost from w"""


@query(_PROGRESS)
def ag12_progress(spark, d):
    own = _t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") / 8).alias("elapsed"), F.when(F.col("event_type") != "error", F.floor("value") / 1024).alias("cost"))
    return attempts.progress(own, F.lit(60)).select("run", "seq", "remaining", "eta", "cost_so_far", "projected_cost")


_RATED_SQL = f"(select *, case when status <> 'completed' then 'not_parsed' when k % 10 = 0 then 'not_scored' when value between 0 and 50 then 'parsed' else 'parse_failed' end as parse_status from {_LOG_SQL})"
_USAGE = "k * 10 as input_tokens, case when k % 2 = 0 then k end as cached_input_tokens, case when k % 7 > 0 then tokens end as output_tokens"


def _rated(spark, d):
    log = _log(spark, d).withColumn("usage", F.when(F.col("status") != "failed", F.struct((F.col("k") * 10).alias("input_tokens"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("cached_input_tokens"), F.when(F.col("k") % 7 > 0, F.col("tokens")).alias("output_tokens"), F.lit(None).cast("bigint").alias("reasoning_tokens"), (F.col("k") * 11).alias("total_tokens"))))
    out = validate.rating_outcome(F.col("status"), F.when(F.col("k") % 10 != 0, F.col("value")), F.lit(None).cast("string"), F.lit(0.0), F.lit(50.0), F.expr("cast(array() as array<double>)"), F.expr("cast(array() as array<string>)"))
    return log.withColumn("x", out).withColumns({c: F.col(f"x.{c}") for c in ("rating", "parse_status", "parse_error")}).withColumn("estimated_cost_usd", F.lit(None).cast("double"))


_EX6_COST = "(greatest(input_tokens - coalesce(cached_input_tokens, 0), 0) * 0.75 + coalesce(cached_input_tokens, 0) * 0.075 + output_tokens * 4.5) / 1e6"


@query(f"select seq, printf('%.10f', {_EX6_COST})::double as cost from (select *, {_USAGE} from {_LOG_SQL} where status <> 'failed') union all select seq, null from {_LOG_SQL} where status = 'failed'")
def ex6_priced_records(spark, d):
    return attempts.priced(_rated(spark, d), attempts.Pricing("m", 0.75, 0.075, 4.5, "2026-07-16")).select("seq", F.col("estimated_cost_usd").alias("cost"))


@query(f"select count(*) as total, count_if(status = 'completed') as completed, count_if(status = 'failed') as failed, count_if(status = 'validation_failed') as validation_failed, count_if(parse_status = 'parsed') as parsed, count_if(parse_status = 'not_scored') as not_scored, count_if(parse_status = 'parse_failed') as parse_failed, count_if(parse_status = 'not_parsed') as not_parsed, sum(case when status <> 'failed' then k * 10 else 0 end)::bigint as input_tokens, sum(case when status <> 'failed' and k % 2 = 0 then k else 0 end)::bigint as cached_input_tokens, sum(case when status <> 'failed' and k % 7 > 0 then tokens else 0 end)::bigint as output_tokens, 0::bigint as reasoning_tokens, sum(case when status <> 'failed' then k * 11 else 0 end)::bigint as total_tokens, 0::double as estimated_cost_usd, printf('%.6f', sum(duration_seconds))::double as request_runtime_seconds, list(distinct model order by model) as models, printf('%.6f', count_if(parse_status in ('parsed', 'not_scored'))::double / count_if(status in ('completed', 'validation_failed')))::double as parse_rate from {_RATED_SQL}")
def ag5_run_summary(spark, d):
    return attempts.summary(_rated(spark, d))


# --- validation


_GIVEN = "(select s_suppkey * 2 as id from supplier union select doc_id * 3 from documents)"


@query(f"select c_custkey as id, 'missing' as problem from customer where c_custkey not in (select id from {_GIVEN}) union all select id, 'extra' from {_GIVEN} where id not in (select c_custkey from customer)")
def jo13_coverage(spark, d):
    wanted = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    given = _t(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("id")).union(_t(spark, d, "documents").select((F.col("doc_id") * 3).alias("id")))
    return validate.coverage(wanted, given, "id")


@query("select d.doc_id, split_part(l.text, '.', 1) as quote, length(split_part(l.text, '.', 1)) > 0 and contains(d.text, split_part(l.text, '.', 1)) as verified from documents d join documents l on l.doc_id = d.doc_id + 1")
def jo11_quote_check(spark, d):
    docs = _t(spark, d, "documents")
    cited = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.substring_index("text", ".", 1).alias("quote"))
    return validate.quotes(cited.join(docs.select("doc_id"), "doc_id", "left_semi"), docs.select("doc_id", "text"), "doc_id")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = o_orderkey % 25)")
def jo12_unknown_references(spark, d):
    cited = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"))
    return validate.unknown_references(cited, _t(spark, d, "customer"), "c_custkey", "c_nationkey").select("o_orderkey", "o_custkey")


_VA3 = "case when event_type = 'error' then 'not_parsed' when event_type = 'signup' then 'not_scored' when event_type = 'click' then 'parse_failed' when not (value between 0 and 50) then 'parse_failed' else 'parsed' end"


@query(f"select event_id, case when {_VA3} = 'parsed' then printf('%g', value) end as rating, {_VA3} as parse_status, case when event_type in ('error', 'signup') then '' when event_type = 'click' then 'rating must be one of: Yes, No' when not (value between 0 and 50) then 'rating must be between 0 and 50' else '' end as parse_error from events")
def va3_rating_rules(spark, d):
    kind = F.col("event_type")
    out = validate.rating_outcome(
        F.when(kind == "error", "failed").otherwise("completed"), F.when(~kind.isin("signup", "click"), F.col("value")), F.when(kind == "click", "Maybe"), F.lit(0.0), F.lit(50.0),
        F.expr("cast(array() as array<double>)"), F.array(F.lit("Yes"), F.lit("No")),
    )
    return _t(spark, d, "events").select("event_id", out.alias("x")).select("event_id", "x.*")


_ANSWERS = "case event_type when 'view' then '{\"rating\": ' || (event_id % 120) || '}' when 'click' then '{\"rating\": \"Yes\"}' when 'purchase' then '{\"rating\": null, \"more\": 1}' when 'signup' then '{\"note\": 1}' else 'not json' end"


def _answers(spark, d):
    kind, n = F.col("event_type"), F.col("event_id")
    text = F.when(kind == "view", F.concat(F.lit('{"rating": '), n % 120, F.lit("}"))).when(kind == "click", '{"rating": "Yes"}').when(kind == "purchase", '{"rating": null, "more": 1}').when(kind == "signup", '{"note": 1}').otherwise("not json")
    meta = F.struct(F.lit(0.0).alias("min_value"), F.lit(100.0).alias("max_value"), F.array(F.lit("Yes"), F.lit("No")).alias("allowed_values"))
    error = F.lit(None).cast("struct<type:string,message:string,request_id:string,phase:string>")
    return _t(spark, d, "events").select(n.alias("event_id"), F.concat(F.lit("j"), n).alias("job_id"), F.when(n % 7 == 0, "failed").otherwise("completed").alias("status"), text.alias("output_text"), error.alias("error"), meta.alias("metadata"))


@query(f"select event_id, case when event_id % 7 = 0 then 'failed' when event_type in ('view', 'click') then 'completed' else 'validation_failed' end as status, case when event_id % 7 = 0 then 'not_run' when event_type in ('view', 'click') then 'passed' else 'failed' end as validation_status, 'rating@1' as contract_id, case when event_id % 7 = 0 then null when event_type = 'purchase' then 'more: Extra inputs are not permitted' when event_type = 'signup' then 'rating: Field required' when event_type = 'error' then 'Invalid JSON' end as message, case when event_id % 7 > 0 and event_type in ('view', 'click') then replace({_ANSWERS}, ': ', ':') end as parsed_output from events")
def va1_contract(spark, d):
    return validate.validated(_answers(spark, d), RATING).select("event_id", "status", "validation_status", "contract_id", F.col("error.message").alias("message"), "parsed_output")


@query("select 'j' || event_id as job_id, case when event_id % 7 = 0 then 'failed' when event_type = 'view' and event_id % 120 <= 100 then 'parse_failed' when event_type = 'view' then 'parse_failed' when event_type = 'click' then 'parsed' else 'validation_failed' end as outcome, case when event_id % 7 = 0 then null when event_type = 'view' then (event_id % 120)::varchar when event_type = 'click' then 'Yes' when event_type = 'purchase' then 'more: Extra inputs are not permitted' when event_type = 'signup' then 'rating: Field required' else 'Invalid JSON' end as value from events".replace("when event_type = 'view' and event_id % 120 <= 100 then 'parse_failed'", "when event_type = 'view' and event_id % 120 <= 100 then 'parsed'"))
def va4_result_classes(spark, d):
    own = _answers(spark, d).withColumn("parsed_output", F.lit(None).cast("string"))
    return validate.classified(own, RATING)


_CITED = "case when doc_id % 5 = 0 then '{\"rating\":1,\"justifications\":[]}' else '{\"rating\":1,\"justifications\":[{\"explanation\":\"' || case when doc_id % 5 = 1 then ' ' else 'e' end || '\",\"citations\":[{\"text\":' || to_json(quote)::varchar || '}]}]}' end"


def _citations(spark, d):
    docs = _t(spark, d, "documents").withColumn("quote", F.when(F.col("doc_id") % 3 == 0, "nowhere to be found").otherwise(F.substring_index(F.col("text"), ".", 1)))
    cited = F.when(F.col("doc_id") % 5 == 0, '{"rating":1,"justifications":[]}').otherwise(F.to_json(F.struct(F.lit(1).alias("rating"), F.array(F.struct(F.when(F.col("doc_id") % 5 == 1, " ").otherwise("e").alias("explanation"), F.array(F.struct(F.col("quote").alias("text"))).alias("citations"))).alias("justifications"))))
    sent = F.concat(F.lit("Item\nTranscript:\n"), F.col("text"), F.lit(" \n"))
    meta = F.struct(F.lit("T").alias("transcript_id"), F.lit("T.txt").alias("transcript_file"), F.lit("I").alias("item_id"))
    return docs.select(F.concat(F.lit("j"), "doc_id").alias("job_id"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("completed").alias("status"), cited.alias("parsed_output"), F.struct(sent.alias("input")).alias("request"), meta.alias("metadata"))


_QUOTE = "(select *, case when doc_id % 3 = 0 then 'nowhere to be found' else split_part(text, '.', 1) end as quote from documents)"
_OK = "(length(quote) > 0 and contains(text, quote))"


@query(f"select 'j' || doc_id as job_id, case when doc_id % 11 = 0 then 'not_run' when doc_id % 5 in (0, 1) or not {_OK} then 'failed' else 'passed' end as citation_validation, case when doc_id % 11 = 0 then '' when doc_id % 5 = 0 then 'a scored rating must have at least one justification' else concat_ws('; ', case when doc_id % 5 = 1 then 'justification 1 has no explanation' end, case when not {_OK} then 'citation 1.1 is not an exact quote from the transcript sent to the model' end) end as errors from {_QUOTE}")
def va5_citation_audit(spark, d):
    return validate.citation_audit(_citations(spark, d)).select("job_id", "citation_validation", F.array_join("errors", "; ").alias("errors"))


@query(f"select 'j' || doc_id as job_id, 'T' as transcript_id, 'T.txt' as transcript_file, 'I' as item_id, '1' as rating, 1 as justification_number, 1 as citation_number, case when doc_id % 5 = 1 then ' ' else 'e' end as explanation, quote, {_OK} as quote_verified from {_QUOTE} where doc_id % 5 > 0 and doc_id % 11 > 0")
def sk7_citation_rows(spark, d):
    done = validate.citation_audit(_citations(spark, d)).filter("status = 'completed'")
    return validate.citation_exports(done)[1]


@query("select doc_id, rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) as sent from documents where doc_id % 2 = 0 union all select doc_id, null from documents where doc_id % 2 = 1")
def va6_sent_transcript(spark, d):
    prompt = F.concat(F.lit("Item"), F.when(F.col("doc_id") % 2 == 0, "\nTranscript:\n").otherwise("\n"), F.col("text"))
    return _t(spark, d, "documents").select("doc_id", validate.sent_transcript(prompt).alias("sent"))


@query("select source, list_sort(list(distinct lang) filter (lang is not null)) = ['de', 'en', 'es', 'fr'] as every from documents group by source")
def se4_same_members(spark, d):
    own = _t(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return own.select("source", validate.same_members(F.col("langs"), F.array(*map(F.lit, ("de", "en", "es", "fr")))).alias("every"))


@query("select event_id, value from events where not value between 0 and 50")
def va10_out_of_range(spark, d):
    return validate.out_of_range(_t(spark, d, "events").select("event_id", "value"), "value", 0, 50)


# --- privacy

_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
_HITS = f"(select source as scope, doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) as original, generate_subscripts(regexp_extract_all(text, '{_MAIL}'), 1) as pos from documents)"
_NAMED = f"(select scope, lower(original) as norm, '[PRIVATE_EMAIL_' || row_number() over (partition by scope order by min(doc_id * 10000 + pos)) || ']' as replacement from {_HITS} group by scope, lower(original))"
_PARTS = f"(select doc_id, source as scope, unnest(string_split_regex(text, '{_MAIL}')) as part, generate_subscripts(string_split_regex(text, '{_MAIL}'), 1) as pos from documents)"
_MASKED = f"(select p.doc_id, string_agg(p.part || coalesce(n.replacement, ''), '' order by p.pos) as text, count(h.original) as hits from {_PARTS} p left join {_HITS} h on h.doc_id = p.doc_id and h.pos = p.pos left join {_NAMED} n on n.scope = h.scope and n.norm = lower(h.original) group by p.doc_id)"
MAILS = privacy.Deidentifier(labels=("private_email",), warning="patterns only")


def _masked(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("scope"), F.col("doc_id").alias("seq"), "text")
    return privacy.masked(docs, MAILS)


@query(f"select doc_id as key, sha256(text) as text_sha, hits::int as hits from {_MASKED}")
def de1_masked_texts(spark, d):
    return _masked(spark, d).select("key", F.sha2("text", 256).alias("text_sha"), F.size("matches").alias("hits"))


@query(f"select doc_id, sha256(text) as text_sha, lang from {_MASKED} join (select doc_id, lang from documents) using (doc_id)")
def de5_masked_columns(spark, d):
    return privacy.mask_columns(_t(spark, d, "documents"), ["text"], "doc_id", MAILS, "source")[0].select("doc_id", F.sha2("text", 256).alias("text_sha"), "lang")


@query(f"select 'transcript-' || doc_id || '__item-' || item_id as job_id, sha256('Item: ' || item_prompt || chr(10) || 'Transcript:' || chr(10) || text) as prompt_sha from (select p.doc_id, string_agg(p.part || coalesce(n.r, ''), '' order by p.pos) as text from {_PARTS} p left join (select doc_id, pos, '[PRIVATE_EMAIL_' || dense_rank() over (partition by doc_id order by first) || ']' as r from (select *, min(pos) over (partition by doc_id, lower(original)) as first from {_HITS})) n on n.doc_id = p.doc_id and n.pos = p.pos group by p.doc_id) cross join {_ITEMS_SQL}")
def de8_masked_grid(spark, d):
    t = Template("Item: {item}\nTranscript:\n{transcript}", ["item", "transcript"])
    hidden = batch.mask_transcripts(_texts(spark, d).withColumn("transcript_id", F.col("transcript_id").cast("string")), MAILS)[0]
    return grid.grid(hidden, _items(spark), t, "m0").select("job_id", F.sha2("prompt", 256).alias("prompt_sha"))


_LINES = f"(select scope, doc_id, string_agg('- private_email: [hidden] -> ' || replacement, chr(10) order by pos) as lines from {_HITS} join {_NAMED} n using (scope) where n.norm = lower(original) group by scope, doc_id)"


@query(f"select m.doc_id as key, sha256(m.text || chr(10) || chr(10) || 'Detected identifiers:' || chr(10) || coalesce(lines, '- none') || chr(10) || chr(10) || 'Warning: patterns only') as shown from {_MASKED} m left join {_LINES} l using (doc_id)")
def de9_preview(spark, d):
    return _masked(spark, d).select("key", F.sha2(privacy.preview(F.col("text"), F.col("matches"), F.col("warning"), False), 256).alias("shown"))


@query(f"select scope, '{{\"text_count\":' || count(*) || ',\"identifier_count\":' || sum(hits) || ',\"counts_by_label\":{{' || case when sum(hits) > 0 then '\"private_email\":' || sum(hits) else '' end || '}},\"warnings\":[\"patterns only\"],\"labels_applied\":[\"private_email\"]}}' as payload from {_MASKED} join (select doc_id, source as scope from documents) using (doc_id) group by scope")
def ag9_combined_summaries(spark, d):
    own = privacy.summarised(_masked(spark, d)).join(_t(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("scope")), "key")
    return privacy.payload(privacy.combined(own.withColumn("seq", F.col("key")), "scope"))


@query("select doc_id, list_filter([case when n % 3 = 0 then 'private_email' end, case when n % 2 = 0 then 'secret' end], lambda x: x is not null) as labels, (n % 2 = 0 and n < 9) or (n % 4 = 0 and n % 3 = 0) or (n % 4 = 0 and n % 3 > 0 and n < 99) as bad from (select doc_id, length(text) as n from documents where length(text) >= 6) union all select doc_id, [], false from documents where length(text) < 6")
def fi6_span_checks(spark, d):
    def found(text: str):
        n = len(text)
        if n < 6:
            return []
        at = [("private_email", 0, 6 if n % 4 == 0 else 3)] if n % 3 == 0 else []
        at += [("secret", 5, 9)] if n % 2 == 0 else []
        return [*at, ("private_url", 3, 4)] + ([("secret", 9, 99)] if n % 4 == 0 and n % 3 else [])

    dd = privacy.Deidentifier(labels=("private_email", "secret"), load=lambda: found)
    own = _t(spark, d, "documents").select("doc_id", "text", privacy.spans(F.col("text"), dd).alias("s"))
    return own.select("doc_id", F.array_distinct(F.transform("s", lambda x: x["label"])).alias("labels"), privacy.bad_spans(F.col("text"), F.col("s")).alias("bad"))


@query(f"select conv_id, turn, '{{\"role\":\"' || role || '\",\"id\":\"a@b.org\",\"content\":[{{\"type\":\"t\",\"text\":\"to [PRIVATE_EMAIL_1] ' || turn || '\"}}]}}' as value from conversations")
def de6_masked_nested(spark, d):
    value = F.to_json(F.struct("role", F.lit("a@b.org").alias("id"), F.array(F.struct(F.lit("t").alias("type"), F.concat(F.lit("to a@b.org "), "turn").alias("text"))).alias("content")))
    own = _t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("n"), value.alias("value"))
    hidden = privacy.mask_nested(own, "n", "value", MAILS)[0]
    return hidden.select("n.conv_id", "n.turn", F.to_json(F.from_json("value", "role string, id string, content array<struct<type:string,text:string>>")).alias("value"))


# --- scalars


@query("select doc_id, array_to_string(list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '[ \t\n\r]+'), lambda x: x <> ''), ' ') as norm from documents")
def fn2_normalized(spark, d):
    return _t(spark, d, "documents").select("doc_id", texts.normalized("text").alias("norm"))


@query("select doc_id, case when contains(text, '. ') then substr(text, instr(text, '. ') + 2) end as rest from documents")
def fn3_after(spark, d):
    return _t(spark, d, "documents").select("doc_id", texts.after(F.col("text"), ". ").alias("rest"))


@query("select event_id, printf('%g', value) as short, printf('%.2f', value)::double as rounded from events")
def fn7_short_numbers(spark, d):
    return _t(spark, d, "events").select("event_id", texts.py_g("value").alias("short"), texts.py_round(2)("value").alias("rounded"))


@query("select event_id, case when value / 4096 < 0.01 then printf('$%.4f', value / 4096) else printf('$%.2f', value / 4096) end as cost from events")
def fn18_dollars(spark, d):
    return _t(spark, d, "events").select("event_id", texts.dollars(F.col("value") / 4096).alias("cost"))


@query("select event_id, '{\"a\":{\"k\":' || json_extract(props, '$.k') || ',\"z\":null},\"b\":\"é' || event_type || '\"}' as canonical from events")
def fn20_canonical_json(spark, d):
    raw = F.concat(F.lit('{"b": "é'), "event_type", F.lit('", "a": {"z": null, "k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return _t(spark, d, "events").select("event_id", texts.canonical_json(raw).alias("canonical"))


@query("select event_id, case event_id % 7 when 0 then 'text' when 1 then 'number' when 2 then 'number' when 3 then 'flag' when 4 then 'null' when 5 then 'list' else 'object' end as kind from events")
def fn22_json_kinds(spark, d):
    """The kind of JSON made of an event's own values: its type, id, value, a comparison, what it lacks, a list, its properties."""
    said = lambda c: F.to_json(F.array(c))
    alone = lambda c: F.substr(said(c), F.lit(2), F.length(said(c)) - 2)
    kinds = (F.col("event_type"), F.col("event_id"), F.col("value"), F.col("value") > 50, F.lit(None).cast("int"), F.array("event_id", "user_id"))
    raw = F.col("props")
    for k, c in enumerate(kinds):
        raw = F.when(F.col("event_id") % 7 == k, F.coalesce(alone(c), F.lit("null"))).otherwise(raw)
    return _t(spark, d, "events").select("event_id", texts.json_kind(F.try_parse_json(raw)).alias("kind"))


# --- runs


def _respond(request: dict) -> dict:
    """The offline responder: rates by the length of the prompt, and fails, cuts short or garbles some answers."""
    n = len(request["prompt"])
    if n % 11 == 0:
        raise RuntimeError("no answer")
    if n % 13 == 0:
        return {"status": "incomplete", "incomplete_reason": "max_output_tokens"}
    return {"output_text": "not json" if n % 7 == 0 else '{"rating": %d}' % (n % 130), "usage": {"input_tokens": n, "output_tokens": 4, "total_tokens": n + 4}}


_RUN = "(select c_custkey as ordinal, 'job-' || c_custkey as job_id, length(repeat('x', (c_custkey % 40)::int) || c_custkey) as n from customer)"
_STATUS = "case when n % 11 = 0 or n % 13 = 0 then 'failed' when n % 7 = 0 then 'validation_failed' else 'completed' end"


@query(f"select ordinal, job_id, row_number() over (order by ordinal) as seq, 1 as attempt, {_STATUS} as status, case when n % 11 = 0 then 'RuntimeError' when n % 13 = 0 then 'ResponseError' when n % 7 = 0 then 'ValidationError' end as error_type, case when {_STATUS} = 'completed' then '{{\"rating\":' || (n % 130) || '}}' end as parsed_output, case when {_STATUS} <> 'failed' then printf('%.10f', (n * 1.0 + 8) / 1e6)::double end as cost from {_RUN}")
def ex3_run_jobs(spark, d):
    rows = run_jobs(_run_jobs(spark, d), _scratch(spark, "ex3"), _respond, pricing=attempts.Pricing("m", 1.0, 0.5, 2.0, "2026-01-01"), contract=RATING, workers=4, batch=100_000)
    return rows.select("ordinal", "job_id", "seq", "attempt", "status", F.col("error.type").alias("error_type"), "parsed_output", F.col("estimated_cost_usd").alias("cost"))


@query("select count(*) as transcripts_found, count_if(trim(text) <> '') as usable_transcripts, 4::bigint as items, count_if(trim(text) <> '') * 4 as possible_jobs, false as ready, ['Blank transcripts: b.txt']::varchar[] as issues from (select text from documents union all select ' ')")
def ag10_study_inventory(spark, d):
    docs = _t(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("filename"), "text").union(spark.createDataFrame([("b.txt", " ")], "filename string, text string"))
    return chat.inventory(docs, _items(spark))


_NUMBERS = "(length(text) % 120)"
_FITS = f"case when item_id = 'dep_01' then {_NUMBERS} <= 100 when item_id = 'anx_01' then {_NUMBERS} % 5 in (0, 1, 3) else {_NUMBERS} % 3 < 2 end"


def _answered(spark, d):
    """A completed record for every text with every item: an offline answer made of the text's length."""
    own = _texts(spark, d).crossJoin(F.broadcast(_items(spark)))
    n = F.length("text") % 120
    number = F.when(F.col("item_id") == "dep_01", n).otherwise(n % 5)
    said = F.when(n % 3 == 2, "Perhaps").otherwise(F.coalesce(F.get(F.split("scoring_values", "\\s*\\|\\s*"), n % 3), F.lit("Perhaps")))
    answer = F.when(F.col("min_value").isNull(), F.to_json(F.struct(said.alias("rating")))).otherwise(F.to_json(F.struct(number.alias("rating"))))
    usage = {"input_tokens": F.length("text").cast("bigint"), "cached_input_tokens": F.lit(None).cast("bigint"), "output_tokens": F.lit(4).cast("bigint"), "reasoning_tokens": F.lit(None).cast("bigint"), "total_tokens": (F.length("text") + 4).cast("bigint")}
    error = F.lit(None).cast("struct<type:string,message:string,request_id:string,phase:string>")
    return own.select(
        "item_id", grid.job_id(F.col("transcript_id"), F.col("item_id")).alias("job_id"), grid.metadata(F.col("transcript_id"), F.col("filename")).alias("metadata"), F.lit("completed").alias("status"), answer.alias("parsed_output"), answer.alias("output_text"),
        F.struct(*[c.alias(k) for k, c in usage.items()]).alias("usage"), F.lit(0.25).alias("estimated_cost_usd"), F.lit(0.5).alias("duration_seconds"), F.lit("m0").alias("model"), F.lit(None).cast("string").alias("response_id"), error.alias("error"),
    )


@query(f"select item_id, count(*) as total, count_if({_FITS}) as parsed, count_if(not {_FITS}) as parse_failed, 0::bigint as not_scored, printf('%.6f', count_if({_FITS})::double / count(*))::double as parse_rate, sum(length(text))::bigint as input_tokens, count(*) * 0.25::double as estimated_cost_usd from {_TEXTS_SQL} t cross join {_ITEMS_SQL} group by item_id")
def ex8_rating_batch(spark, d):
    """The flagship: every document with every item, an offline answer for each, the rules, a summary for each item."""
    rows = batch.rated(_answered(spark, d))
    return attempts.summary(rows, "item_id").select("item_id", "total", "parsed", "parse_failed", "not_scored", "parse_rate", "input_tokens", "estimated_cost_usd")


_SAID = f"case when item_id = 'dep_01' then printf('%g', {_NUMBERS}::double) when item_id = 'anx_01' then printf('%g', ({_NUMBERS} % 5)::double) else trim(string_split(scoring_values, '|')[({_NUMBERS} % 3)::int + 1]) end"


@query(f"select 'transcript-' || transcript_id || '__item-' || item_id as job_id, transcript_id::varchar as transcript_id, filename as transcript_file, item_id, min_value, max_value, 'm0' as model, 'completed' as status, case when {_FITS} then {_SAID} end as rating, case when {_FITS} then 'parsed' else 'parse_failed' end as parse_status, length(text)::bigint as input_tokens, 0.25::double as estimated_cost_usd from {_TEXTS_SQL} t cross join {_ITEMS_SQL}")
def sk5_result_rows(spark, d):
    """The flat results: written as the results file is, and read again."""
    path = _scratch(spark, "sk5")
    sinks.write_csv(sinks.results(batch.rated(_answered(spark, d))), path, one=False)
    kinds = {"min_value": "double", "max_value": "double", "input_tokens": "bigint", "estimated_cost_usd": "double"}
    rows = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in sinks.RESULT_COLUMNS)).csv(path, header=True, quote='"', escape='"', lineSep="\r\n")
    return rows.select("job_id", "transcript_id", "transcript_file", "item_id", "min_value", "max_value", "model", "status", "rating", "parse_status", "input_tokens", "estimated_cost_usd")


# --- runs that go on, the kept snapshot, progress as attempts come


def _respond_well(request: dict) -> dict:
    n = len(request["prompt"])
    return {"output_text": '{"rating": %d}' % (n % 130), "usage": {"input_tokens": n, "output_tokens": 4, "total_tokens": n + 4}}


def _run_jobs(spark, d):
    keys = _t(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # a small file is one task, its jobs are work for all
    own = keys.select(F.col("c_custkey").alias("ordinal"), F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.concat(F.expr("repeat('x', cast(c_custkey % 40 as int))"), "c_custkey").alias("prompt"))
    own = own.withColumns({"instructions": F.lit(None).cast("string"), "model": F.lit("m"), "max_output_tokens": F.lit(5), "output_format": F.lit(None).cast("string"), "metadata": F.from_json(F.lit("{}"), METADATA)})
    return grid.prepared(own, "m", RATING)


@query(f"with r as (select *, {_STATUS} as first from {_RUN}) select ordinal, job_id, case when first = 'completed' then row_number() over (order by ordinal) else (select count(*) from r) + row_number() over (partition by first = 'completed' order by ordinal) end as seq, case when first = 'completed' then 1 else 2 end as attempt, 'completed' as status, '{{\"rating\":' || (n % 130) || '}}' as parsed_output, printf('%.10f', (n * 1.0 + 8) / 1e6)::double as cost from r")
def ex3_resumed_run(spark, d):
    """A run with failures in several batches, and a second one that calls what isn't completed."""
    jobs, path, price = _run_jobs(spark, d), _scratch(spark, "ex3"), attempts.Pricing("m", 1.0, 0.5, 2.0, "2026-01-01")
    run_jobs(jobs, path, _respond, pricing=price, contract=RATING, workers=4, batch=600)
    rows = run_jobs(jobs, path, _respond_well, pricing=price, contract=RATING, workers=4, batch=600)
    return rows.select("ordinal", "job_id", "seq", "attempt", "status", "parsed_output", F.col("estimated_cost_usd").alias("cost"))


@query(f"select job_id, max(seq) as seq, arg_max(status, seq) as status, arg_max(value, seq) as value, min(seq) as ord, count(*) as attempts from {_LOG_SQL} group by job_id")
def ag1_kept_snapshot(spark, d):
    """The latest record of each job from the kept table and the batches behind it: the log comes in three batches, two of them compacted."""
    path, log = _scratch(spark, "ag1"), _log(spark, d).select("seq", "job_id", "status", "value")
    kept = snapshot.Snapshot(spark, path, "seq bigint, job_id string, status string, value double, batch string")
    size = log.count()
    for k in range(3):
        low, high = size * k // 3, size * (k + 1) // 3
        name = snapshot.batch_name(low, 0)
        snapshot.append_batch(log.filter((F.col("seq") >= low) & (F.col("seq") < high)).withColumn("batch", F.lit(name)), path, name)
        if k < 2:
            kept.compact()
    return kept.latest().select("job_id", "seq", "status", "value", "ord", "attempts")


@query(_PROGRESS)
def ex7_live_progress(spark, d):
    """ag12's lines from a stream of files, in whatever order they come."""
    path, out = _scratch(spark, "ex7"), _scratch(spark, "ex7-lines")
    own = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") / 8).alias("elapsed"), F.when(F.col("event_type") != "error", F.floor("value") / 1024).alias("cost"), F.lit(60).cast("bigint").alias("pending"))
    own.repartition(6).write.parquet(path)
    ends = own.groupBy("run").agg(F.lit(None).cast("bigint").alias("seq"), F.max("elapsed").alias("elapsed"), F.lit(None).cast("double").alias("cost"), F.count("*").alias("pending"))
    ends.write.mode("append").parquet(path)
    lines = live_progress(spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 4).parquet(path), "30 days")
    query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("run").cast("bigint").alias("run"), "seq", F.col("remaining").cast("int").alias("remaining"), "eta", "cost_so_far", "projected_cost")


@query("select conv_id, turn, count(*) over w as sent, (sum(h) over w % 1152921504606846976)::bigint as digest from (select *, ('0x' || substr(md5(turn || chr(31) || role || chr(31) || text), 1, 15))::bigint as h from conversations) window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def wi5_history_refs(spark, d):
    return themes.history_refs(_t(spark, d, "conversations"))


@query("select q.doc_id as quote_id, t.doc_id from (select doc_id, split_part(text, '.', 1) as quote from documents) q join documents t on contains(t.text, q.quote) where q.quote <> ''")
def va9_quotes_anywhere(spark, d):
    """The documents in which each document's first sentence stands, whichever they are."""
    docs = _t(spark, d, "documents")
    return quotes.holders(docs.select(F.col("doc_id").alias("quote_id"), F.substring_index("text", ".", 1).alias("quote")), docs.select("doc_id", "text"), "doc_id")


@query(f"select 'j' || p.doc_id as job_id, sha256(p.text) as prompt_sha, 'Reply to [PRIVATE_EMAIL_' || (coalesce(k, 0) + 1) || '], who is [PRIVATE_EMAIL_' || (coalesce(k, 0) + 1) || ']' as instructions, coalesce(hits, 0) + 2 as identifiers from (select p.doc_id, string_agg(p.part || coalesce(n.r, ''), '' order by p.pos) as text, max(n.k) as k, count(n.k) as hits from {_PARTS} p left join (select doc_id, pos, k, '[PRIVATE_EMAIL_' || k || ']' as r from (select *, dense_rank() over (partition by doc_id order by first) as k from (select *, min(pos) over (partition by doc_id, lower(original)) as first from {_HITS}))) n on n.doc_id = p.doc_id and n.pos = p.pos group by p.doc_id) p")
def de7_masked_jobs(spark, d):
    """Masking within a run: prompt, then instructions, each job a scope of its own."""
    meta = F.struct(F.concat(F.lit("T"), "doc_id").alias("transcript_id"))
    jobs = _t(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("j"), "doc_id").alias("job_id"), F.col("text").alias("prompt"), F.lit("Reply to Desk@rating.example, who is desk@rating.example").alias("instructions"), meta.alias("metadata"))
    out, summary = batch.mask_jobs(jobs, MAILS, "transcript_id")
    return out.join(summary, "job_id").select("job_id", F.sha2("prompt", 256).alias("prompt_sha"), "instructions", F.col("identifier_count").alias("identifiers"))


@query(f"select 'j' || doc_id as job_id, case when doc_id % 11 = 0 then 'failed' else 'completed' end as status, '1' as rating, case when doc_id % 11 = 0 then 'not_run' when doc_id % 5 in (0, 1) or not {_OK} then 'failed' else 'passed' end as citation_validation, case when doc_id % 5 = 0 then 0 else 1 end as justification_count, case when doc_id % 5 = 0 or doc_id % 11 = 0 then 0 else 1 end as citation_count, case when doc_id % 5 = 0 or doc_id % 11 = 0 then '[]' else json_array(quote)::varchar end as citations_json from {_QUOTE}")
def sk7_job_rows(spark, d):
    rows = validate.citation_exports(validate.citation_audit(_citations(spark, d)))[0]
    return rows.select("job_id", "status", "rating", "citation_validation", "justification_count", "citation_count", "citations_json")


# --- the diary workflow: every document is a diary


def _diaries(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("diary_id"), F.col("doc_id").cast("string").alias("date"), "text")


def _respond_themes(request: dict) -> dict:
    text = request["prompt"].split("|", 2)[2]
    return {"output_text": json.dumps({"themes": [{"label": f"L{len(text) % 7}", "description": "d", "quote": text[: 30 + 10 * k], "importance": 1 + (len(text) + k) % 5} for k in range(2)]})}


@query("select doc_id || '-c0' || (k + 1) as candidate_id, doc_id::varchar as diary_id, doc_id::varchar as date, 'L' || (length(text) % 7) as label, substr(text, 1, (30 + 10 * k)::int) as quote, (1 + (length(text) + k) % 5)::int as importance from documents, (select unnest([0, 1]) as k) x")
def ex16_extraction(spark, d):
    """Stage 1 over all diaries: a request for each, two themes an answer, each quote held against its diary."""
    out = workflow.extract(_diaries(spark, d), Template("{diary_id}|{date}|{diary}", ["diary_id", "date", "diary"]), _scratch(spark, "ex16"), _respond_themes, "m", workers=4)
    return out.select("candidate_id", "diary_id", "date", "label", "quote", "importance")


def _respond_audit(request: dict) -> dict:
    first = json.loads(request["prompt"].split("\n====\n")[1])[0]
    quote = {"diary_id": first["diary_id"], "date": first["date"], "text": first["text"][:12]}
    return {"output_text": json.dumps({"explanation": "seen", "quotes": [quote], "uncertainty": "none"})}


@query(f"with s as (select {_THEME} as theme_id, printf('%.1f', 0.7::double * (100::double * count(distinct doc_id) / (select count(*) from documents)) + 0.3::double * (avg(1 + doc_id % 5) / 5 * 100))::double as salience, min(doc_id::varchar) as diary_id from documents group by 1) select theme_id, 'seen' as explanation, diary_id, substr(text, 1, 12) as quote from (select * from s order by salience desc, theme_id limit 3) join (select doc_id::varchar as diary_id, text from documents) using (diary_id)")
def ex16_evidence(spark, d):
    """Stages 3 and 4: every theme scored, the best three audited with their diaries' texts."""
    home, diaries = _scratch(spark, "ex16"), _diaries(spark, d)
    found = _themes(spark, d).withColumns({"title": F.upper("theme_id"), "description": F.lit("d")})
    candidates = _t(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), F.col("doc_id").cast("string").alias("diary_id"), (1 + F.col("doc_id") % 5).alias("importance"))
    scores = workflow.score(found, candidates, diaries.count(), home)
    out = workflow.audit(found, scores, candidates, diaries, Template("{theme}\n====\n{diaries}", ["theme", "diaries"]), home, _respond_audit, "m")
    return out.select("theme_id", "explanation", F.get("quotes", F.lit(0))["diary_id"].alias("diary_id"), F.get("quotes", F.lit(0))["text"].alias("quote"))
