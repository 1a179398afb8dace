"""Checks of answers: contract, rating rules, citations, quotes, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.contract import Contract
from gridloom.functions.text import after, json_kind, py_g, rstrip

#: Stands between the prompt and the text that is rated.
TRANSCRIPT_MARKER = "\nTranscript:\n"


def validated(records: DataFrame, contract: Contract) -> DataFrame:
    """Records (status, output_text, error) checked against the contract before they are saved.

    contract_id, validation_status (passed, failed, not_run) and parsed_output (JSON) are added; a completed record whose text
    breaks the contract becomes validation_failed, keeps its text and says why in error.
    """
    done = F.col("status") == "completed"
    own = records.withColumn("_wrong", F.when(done, contract.error(F.coalesce("output_text", F.lit("")))))
    failed = F.struct(F.lit("ValidationError").alias("type"), F.col("_wrong").alias("message"), F.lit(None).cast("string").alias("request_id"), F.lit("validation").alias("phase"))
    bad = done & F.col("_wrong").isNotNull()
    own = own.withColumns(
        {
            "contract_id": F.lit(contract.contract_id),
            "validation_status": F.when(~done, "not_run").when(bad, "failed").otherwise("passed"),
            "parsed_output": F.when(done & ~bad, F.to_json(F.try_parse_json("output_text"))),
            "status": F.when(bad, "validation_failed").otherwise(F.col("status")),
            "error": F.when(bad, failed).otherwise(F.col("error")),
        }
    )
    return own.drop("_wrong")


def rating_outcome(status: Column, number: Column, text: Column, low: Column, high: Column, numbers: Column, texts: Column, other: Column | None = None) -> Column:
    """(rating, parse_status, parse_error) by the first rule that holds.

    number and text: the rating by its JSON type, both null if not scored; other: true for a rating of any other type (a flag,
    a list). The numbers in messages and the rating are written as %g.
    """
    row = lambda r, s, e: F.struct(r.cast("string").alias("rating"), F.lit(s).alias("parse_status"), e.alias("parse_error"))
    null = F.lit(None)
    fail = lambda e: row(null, "parse_failed", e)
    choices = lambda a: F.concat(F.lit("rating must be one of: "), F.array_join(a, ", "))
    span = F.concat(F.lit("rating must be between "), py_g(low.cast("double")), F.lit(" and "), py_g(high.cast("double")))
    odd = F.coalesce(other, F.lit(False)) if other is not None else F.lit(False)
    return (
        F.when(status != "completed", row(null, "not_parsed", F.lit("")))
        .when(odd, fail(F.lit("rating must be a number, text, or null")))
        .when(number.isNull() & text.isNull(), row(null, "not_scored", F.lit("")))
        .when(text.isNotNull() & (F.size(texts) <= 0), fail(F.lit("rating must be a number or null")))
        .when(text.isNotNull() & ~F.array_contains(texts, text), fail(choices(texts)))
        .when(text.isNotNull(), row(text, "parsed", F.lit("")))
        .when(F.isnan(number) | (F.abs(number) == float("inf")), fail(F.lit("rating must be finite")))
        .when(low.isNull() | high.isNull(), fail(choices(F.when(F.size(texts) > 0, texts).otherwise(_floats(numbers)))))
        .when(~number.between(low, high), fail(span))
        .when((F.size(numbers) > 0) & ~F.array_contains(numbers, number), fail(choices(_short(numbers))))
        .otherwise(row(py_g(number), "parsed", F.lit("")))
    )


def _floats(numbers: Column) -> Column:
    return F.transform(numbers, lambda v: F.when(v == F.floor(v), F.concat(F.floor(v).cast("string"), F.lit(".0"))).otherwise(v.cast("string")))


def _short(numbers: Column) -> Column:
    """Numbers without a fraction of zero, as %g writes those of up to six digits."""
    return F.transform(numbers, lambda v: F.when((v == F.floor(v)) & (F.abs(v) < 1e6), F.floor(v).cast("string")).otherwise(v.cast("string")))


def rating_of(parsed: Column) -> tuple[Column, Column, Column]:
    """(number, text, other) of the rating in a JSON answer, for rating_outcome()."""
    value = F.try_variant_get(F.try_parse_json(parsed), "$.rating", "variant")
    kind = F.coalesce(json_kind(value), F.lit("null"))
    return F.when(kind == "number", F.try_variant_get(value, "$", "double")), F.when(kind == "text", F.try_variant_get(value, "$", "string")), ~kind.isin("number", "text", "null")


def result_class(status: Column, error: Column, number: Column, text: Column, low: Column, high: Column, numbers: Column, texts: Column) -> Column:
    """(outcome, value) of a saved record: failed, validation_failed, not_scored, parse_failed or parsed; the value is the error's message or the rating itself, also one that breaks the rules."""
    row = lambda o, v: F.struct(F.lit(o).alias("outcome"), v.cast("string").alias("value"))
    value = F.coalesce(text, py_g(number))
    fits = F.when(text.isNotNull(), F.array_contains(texts, text)).otherwise(number.between(low, high) & ((F.size(numbers) <= 0) | F.array_contains(numbers, number)))
    return (
        F.when(status == "failed", row("failed", error))
        .when(status == "validation_failed", row("validation_failed", error))
        .when(number.isNull() & text.isNull(), row("not_scored", F.lit(None)))
        .when(F.coalesce(fits, F.lit(False)), row("parsed", value))
        .otherwise(row("parse_failed", value))
    )


def classified(records: DataFrame, contract: Contract) -> DataFrame:
    """job_id, outcome, value of the latest records. One without parsed_output is checked against the contract again, from its text; metadata is the struct of the grid."""
    text = F.when(F.col("parsed_output").isNull() & (F.col("status") == "completed"), F.col("output_text"))
    wrong = contract.error(F.coalesce(text, F.lit("")))
    stale = text.isNotNull() & wrong.isNotNull()
    own = records.withColumns({"_status": F.when(stale, "validation_failed").otherwise(F.col("status")), "_error": F.when(stale, wrong).otherwise(F.col("error.message")), "_json": F.coalesce("parsed_output", text)})
    number, said, _ = rating_of(F.col("_json"))
    numbers = F.filter(F.transform("metadata.allowed_values", lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    own = own.withColumn("x", result_class(F.col("_status"), F.col("_error"), number, said, F.col("metadata.min_value"), F.col("metadata.max_value"), numbers, F.col("metadata.allowed_values")))
    return own.select("job_id", "x.outcome", "x.value")


def sent_transcript(prompt: Column) -> Column:
    """The text that was sent: what stands behind the first marker, right-stripped; null without a marker."""
    return rstrip(after(prompt, TRANSCRIPT_MARKER))


CITED = "struct<rating:string,justifications:array<struct<explanation:string,citations:array<struct<text:string>>>>>"


def citation_audit(records: DataFrame) -> DataFrame:
    """records (job_id, status, parsed_output, request) with citation_validation, errors and citations.

    citations: an array of (justification_number, citation_number, explanation, quote, quote_verified). A quote is verified if
    it isn't empty and stands in the transcript that was sent. All in one row, without a join.
    """
    parsed = F.when(F.try_variant_get(F.try_parse_json("parsed_output"), "$", "map<string,variant>").isNotNull(), F.from_json("parsed_output", CITED))
    own = records.withColumn("_p", parsed).withColumn("_t", sent_transcript(F.col("request.input")))
    own = own.withColumn("_j", F.coalesce(F.col("_p.justifications"), F.expr("cast(array() as array<struct<explanation:string,citations:array<struct<text:string>>>>)")))

    def cited(j: Column, k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            quote = F.coalesce(c["text"], F.lit(""))
            verified = F.coalesce((F.length(quote) > 0) & F.contains(F.col("_t"), quote), F.lit(False))
            return F.struct((k + 1).alias("justification_number"), (i + 1).alias("citation_number"), F.coalesce(j["explanation"], F.lit("")).alias("explanation"), quote.alias("quote"), verified.alias("quote_verified"))

        return F.transform(F.coalesce(j["citations"], F.expr("cast(array() as array<struct<text:string>>)")), one)

    own = own.withColumn("citations", F.flatten(F.transform("_j", cited)))

    def errors_of(j: Column, k: Column) -> Column:
        say = lambda when, what: F.when(when, F.concat(F.lit("justification "), (k + 1).cast("string"), F.lit(what)))
        blank = F.coalesce(F.trim(j["explanation"]), F.lit("")) == ""
        unquoted = F.transform(
            F.filter("citations", lambda c: (c["justification_number"] == k + 1) & ~c["quote_verified"]),
            lambda c: F.concat(F.lit("citation "), c["justification_number"].cast("string"), F.lit("."), c["citation_number"].cast("string"), F.lit(" is not an exact quote from the transcript sent to the model")),
        )
        return F.concat(F.array(say(blank, " has no explanation"), say(F.coalesce(F.size(j["citations"]), F.lit(0)) <= 0, " has no citations")), unquoted)

    rating = F.col("_p.rating")
    whole = F.concat(
        F.array(
            F.when(rating.isNull() & (F.size("_j") > 0), "a null rating must have no justifications"),
            F.when(rating.isNotNull() & (F.size("_j") == 0), "a scored rating must have at least one justification"),
        ),
        F.flatten(F.transform("_j", errors_of)),
    )
    done, none = F.col("status") == "completed", F.expr("cast(array() as array<string>)")
    alone = (
        F.when(~done, none)
        .when(F.col("_p").isNull(), F.array(F.lit("completed record has no parsed output")))
        .when(F.col("request.input").isNull(), F.array(F.lit("record has no saved request input")))
        .when(F.col("_t").isNull(), F.array(F.lit("saved request does not contain a Transcript section")))
    )
    own = own.withColumn("errors", F.coalesce(alone, F.array_compact(whole)))
    own = own.withColumn("citations", F.when(alone.isNotNull(), F.slice("citations", 1, 0)).otherwise(F.col("citations")))
    return own.withColumn("citation_validation", F.when(~done, "not_run").when(F.size("errors") > 0, "failed").otherwise("passed")).drop("_t", "_j").withColumnRenamed("_p", "parsed")


def citation_exports(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each job and a row for each citation, from citation_audit()."""
    meta = [F.col(f"metadata.{c}").alias(c) for c in ("transcript_id", "transcript_file", "item_id")]
    rating = F.col("parsed.rating").alias("rating")
    jobs = audited.select(
        "job_id", *meta, "status", rating, "citation_validation", F.to_json("errors").alias("validation_errors"),
        F.coalesce(F.size("parsed.justifications"), F.lit(0)).alias("justification_count"), F.size("citations").alias("citation_count"),
        F.coalesce(F.to_json("parsed.justifications"), F.lit("[]")).alias("justifications_json"), F.to_json(F.transform("citations", lambda c: c["quote"])).alias("citations_json"),
    )
    return jobs, audited.select("job_id", *meta, rating, F.explode("citations").alias("c")).select("job_id", "transcript_id", "transcript_file", "item_id", "rating", "c.*")


def quotes(cited: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Each quote with verified: it isn't empty and stands in the source of its key; a missing source fails it."""
    own = cited.join(sources.select(key, F.col("text").alias("_source")), key, "left")
    return own.withColumn("verified", F.coalesce((F.length("quote") > 0) & F.contains("_source", F.col("quote")), F.lit(False))).drop("_source")


def unknown_references(cited: DataFrame, sources: DataFrame, *keys: str) -> DataFrame:
    """The rows of cited whose keys, taken together, no source has."""
    return cited.join(sources.select(*keys).distinct(), list(keys), "left_anti")


def coverage(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone: missing from given, or extra there."""
    missing = wanted.select(key).distinct().join(given.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = given.select(key).distinct().join(wanted.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def same_members(a: Column, b: Column) -> Column:
    """Two arrays hold the same set."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


#: Ids that a membership error names; its rows hold all.
SHOWN = 1000


class MembershipError(ValueError):
    """Candidates that no theme holds, or that none gave; rows: candidate_id and problem of all of them."""

    def __init__(self, message: str, rows: DataFrame):
        super().__init__(message)
        self.rows = rows


def check_membership(candidates: DataFrame, themes: DataFrame) -> None:
    """Every candidate_id of candidates stands in one theme's candidate_ids, and nothing else does; the first broken rule is raised."""
    if themes.filter(F.coalesce(F.size("candidate_ids"), F.lit(0)) <= 0).limit(1).count():
        raise ValueError("every theme must contain at least one candidate ID")
    assigned = themes.select(F.explode("candidate_ids").alias("candidate_id"))
    if assigned.groupBy("candidate_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a candidate theme was assigned more than once")
    wrong = coverage(candidates.select("candidate_id"), assigned, "candidate_id")
    counts = {r["problem"]: r["count"] for r in wrong.groupBy("problem").count().collect()}
    if counts:
        first = {p: [r[0] for r in wrong.filter(F.col("problem") == p).orderBy("candidate_id").limit(SHOWN).select("candidate_id").collect()] for p in ("missing", "extra")}
        said = ", ".join(f"{p}={first[p]}" + (f" and {counts[p] - SHOWN} more" if counts.get(p, 0) > SHOWN else "") for p in first)
        raise MembershipError(f"theme membership mismatch; {said}", wrong)


def check_stage(records: DataFrame, stage: str) -> DataFrame:
    """records, if all are completed; else the first failure is raised with its stage."""
    bad = records.filter("status <> 'completed'").orderBy("job_id").select("job_id", "error.message").limit(1).collect()
    if bad:
        raise RuntimeError(f"{stage} failed for {bad[0]['job_id']}: {bad[0]['message'] or 'unknown error'}")
    return records


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is no number from low to high; null is none."""
    return df.filter(F.isnan(F.col(column).cast("double")) | ~F.col(column).between(low, high))
