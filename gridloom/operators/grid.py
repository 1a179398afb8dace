"""The request grid: texts x items, prompts, ids, metadata and request hashes; what makes jobs invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.contract import Contract, schema_json
from gridloom.functions.items import allowed_numbers, allowed_values, output_format, response_requirements
from gridloom.functions.text import Template, blank, canonical, canonical_json, categories, strip

#: Items are written by hand; a bank of more than this many isn't sent to every executor.
MAX_ITEMS = 100_000


def job_id(transcript_id: Column, item_id: Column) -> Column:
    return F.concat(F.lit("transcript-"), transcript_id.cast("string"), F.lit("__item-"), item_id)


def metadata(transcript_id: Column, filename: Column) -> Column:
    """The seven fields that travel with a job; the item's columns must be there."""
    return F.struct(
        transcript_id.cast("string").alias("transcript_id"),
        filename.alias("transcript_file"),
        "item_id",
        "min_value",
        "max_value",
        "scoring_values",
        allowed_values(F.col("scoring_values")).alias("allowed_values"),
    )


def item_formats(items: DataFrame, contract: Contract) -> DataFrame:
    """items with output_format: the contract's schema narrowed to each item's choices."""
    own = contract.output_format
    output_format(own, "")  # a contract without a rating is an error before any task runs
    made = F.pandas_udf(lambda scales: scales.map(lambda s: output_format(own, s or "")), "string")
    return items.withColumn("output_format", made("scoring_values"))


def grid(
    texts: DataFrame, items: DataFrame, template: Template, model: str, *, instructions: str | None = None, max_output_tokens: int | None = None, contract: Contract | None = None
) -> DataFrame:
    """Every text (transcript_id, text and maybe filename) with every item, as jobs.

    job_id, transcript_id, item_id, prompt, instructions, model, max_output_tokens, output_format (JSON), metadata, request_hash.
    The template may use item, transcript and response_requirements. What hangs on the item alone is made once an item; the bank
    is broadcast while its size allows, and the texts never move.
    """
    bank = items.withColumn("_requirements", response_requirements(F.col("min_value"), F.col("max_value"), F.col("scoring_values")))
    bank = item_formats(bank, contract) if contract else bank.withColumn("output_format", F.lit(None).cast("string"))
    bank = bank.withColumn("_metadata_json", _item_json()).withColumn("_format_json", canonical_json("output_format"))
    if items.limit(MAX_ITEMS + 1).count() <= MAX_ITEMS:
        bank = F.broadcast(bank)
    values = {"item": F.col("item_prompt"), "transcript": F.col("text"), "response_requirements": F.col("_requirements")}
    file = F.col("filename") if "filename" in texts.columns else F.lit(None).cast("string")
    own = texts.crossJoin(bank).withColumn("job_id", job_id(F.col("transcript_id"), F.col("item_id")))
    own = own.withColumn("prompt", template.render(**{f: values[f] for f in template.fields})).withColumn("metadata", metadata(F.col("transcript_id"), file))
    own = own.withColumns({"model": F.lit(model), "instructions": F.lit(instructions).cast("string"), "max_output_tokens": F.lit(max_output_tokens).cast("int")})
    meta = F.concat(F.expr("substr(_metadata_json, 1, length(_metadata_json) - 1)"), F.lit(',"transcript_file":'), json_text(file), F.lit(',"transcript_id":'), json_text(F.col("transcript_id").cast("string")), F.lit("}"))
    own = own.withColumn("request_hash", request_hash(F.col("model"), F.col("instructions"), F.col("prompt"), F.col("max_output_tokens"), F.col("_format_json"), meta))
    return own.select("job_id", "transcript_id", "item_id", "prompt", "instructions", "model", "max_output_tokens", "output_format", "metadata", "request_hash")


def _item_json() -> Column:
    """The item's part of the metadata as canonical JSON; numeric choices are numbers."""
    numeric = F.size(categories(F.col("scoring_values"))) == 0
    fields = ["item_id", "max_value", "min_value", "scoring_values"]
    numbers = F.to_json(F.struct(allowed_numbers(F.col("scoring_values")).alias("allowed_values"), *fields), {"ignoreNullFields": "false"})
    texts = F.to_json(F.struct(allowed_values(F.col("scoring_values")).alias("allowed_values"), *fields), {"ignoreNullFields": "false"})
    return canonical_json(F.when(numeric, numbers).otherwise(texts))


def json_text(c: Column) -> Column:
    """A text as a JSON string, null as null; control characters as Python writes them, in lower-case hexadecimal."""
    out = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    out = F.substr(out, F.lit(6), F.length(out) - 6)
    low = out
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        low = F.regexp_replace(low, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u00{code}", f"$1\\\\u00{code.lower()}")
    return F.when(F.contains(out, F.lit("\\u00")), low).otherwise(out)


def request_json(model: Column, instructions: Column, prompt: Column, most: Column, format_json: Column, metadata_json: Column) -> Column:
    """The request as compact JSON with sorted keys, nulls kept. format_json and metadata_json are canonical JSON already."""
    null = F.lit("null")
    return F.concat(
        F.lit('{"input":'), json_text(prompt), F.lit(',"instructions":'), json_text(instructions), F.lit(',"max_output_tokens":'), F.coalesce(most.cast("string"), null),
        F.lit(',"metadata":'), F.coalesce(metadata_json, F.lit("{}")), F.lit(',"model":'), json_text(model), F.lit(',"output_format":'), F.coalesce(format_json, null), F.lit("}"),
    )


def request_hash(model: Column, instructions: Column, prompt: Column, most: Column, format_json: Column, metadata_json: Column) -> Column:
    return F.sha2(request_json(model, instructions, prompt, most, format_json, metadata_json), 256)


def prepared(jobs: DataFrame, default_model: str | None, contract: Contract | None = None) -> DataFrame:
    """Jobs with model and output_format filled in and request_hash made of what will be sent. metadata may be a struct or JSON text."""
    meta = F.to_json("metadata", {"ignoreNullFields": "false"}) if jobs.schema["metadata"].dataType.typeName() == "struct" else F.col("metadata")
    own, format_json = jobs.withColumn("model", F.coalesce("model", F.lit(default_model))), canonical_json("output_format")
    if contract:  # the contract's own format is made canonical once, not for each job
        format_json = F.when(F.col("output_format").isNull(), canonical(schema_json(contract))).otherwise(format_json)
    hashed = request_hash(F.col("model"), F.col("instructions"), F.col("prompt"), F.col("max_output_tokens"), format_json, canonical_json(meta))
    own = own.withColumn("request_hash", hashed)
    return own.withColumn("output_format", F.coalesce("output_format", F.lit(schema_json(contract)))) if contract else own


def saved_request(prefix: str = "") -> Column:
    """What the log keeps of a request: no metadata, no hash."""
    names = {"model": "model", "instructions": "instructions", "prompt": "input", "max_output_tokens": "max_output_tokens", "output_format": "output_format"}
    return F.struct(*[F.col(prefix + c).alias(n) for c, n in names.items()])


def job_error() -> Column:
    """The first rule that a job breaks on its own; null for one that can be sent."""
    rules = (
        (F.coalesce(strip(F.col("job_id")), F.lit("")) == "", "job_id must be a non-empty string"),
        (blank(F.col("prompt")), "prompt must be a non-empty string"),
        (F.col("model").isNotNull() & (strip(F.col("model")) == ""), "model must be a non-empty string"),
        (F.col("max_output_tokens") <= 0, "max_output_tokens must be a positive integer"),
        (F.col("output_format").isNotNull() & F.try_parse_json("output_format").isNull(), "metadata and output_format must contain JSON-compatible values"),
    )
    first = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        first = F.when(F.coalesce(broken, F.lit(False)), message).otherwise(first)
    return first


def job_errors(jobs: DataFrame) -> DataFrame:
    """job_id, error of the jobs that can't be sent, and of ids that stand twice."""
    wrong = jobs.select("job_id", job_error().alias("error")).filter("error is not null")
    return wrong.unionByName(duplicate_ids(jobs, "job_id").select("job_id", F.lit("job_id values must be unique").alias("error")))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
