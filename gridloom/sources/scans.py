"""Scans of study files: text folders, item banks, prices, attempt logs, hashes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.items import item_error
from gridloom.functions.text import strip
from gridloom.operators.attempts import Pricing
from gridloom.shared import exists, store_of

SUFFIXES = ("csv", "json", "md", "txt")
#: Characters of the longest file that read_study_file() gives out.
MAX_FILE_CHARACTERS = 20_000


def _texts(spark: SparkSession, folder: str, **options) -> DataFrame:
    return spark.read.text(folder, wholetext=True, **options).select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_path").alias("path"), "value")


def text_folder(spark: SparkSession, folder: str, id_name: str = "transcript_id") -> DataFrame:
    """One row for each *.txt of a folder: id (stem), text (stripped), filename; no folder, no files or a blank file are errors. In file order when sorted by filename."""
    if not exists(spark, folder):
        raise ValueError(f"no such folder: {folder}")
    raw = _texts(spark, folder, pathGlobFilter="*.txt").select("filename", strip(F.col("value")).alias("text"))
    if not raw.limit(1).count():
        raise ValueError(f"no text files in {folder}")
    blank = raw.filter("text = ''").orderBy("filename").limit(1).collect()
    if blank:
        raise ValueError(f"{blank[0]['filename']} is blank")
    return raw.select(F.regexp_replace("filename", "\\.txt$", "").alias(id_name), "text", "filename")


def diaries(spark: SparkSession, folder: str) -> DataFrame:
    """diary_id and date (both the stem), text of each dated file; a blank file is an error, and no files are, whether or not the folder is there."""
    if not exists(spark, folder):
        raise ValueError(f"{folder} contains no diary files")
    raw = _texts(spark, folder, pathGlobFilter="*.txt").select(F.regexp_replace("filename", "\\.txt$", "").alias("diary_id"), strip(F.col("value")).alias("text"))
    first = raw.select("diary_id", (F.col("text") == "").alias("blank")).orderBy(F.desc("blank"), "diary_id").limit(1).collect()
    if not first:
        raise ValueError(f"{folder} contains no diary files")
    if first[0]["blank"]:
        raise ValueError(f"{folder}/{first[0]['diary_id']}.txt is empty")
    return raw.select("diary_id", F.col("diary_id").alias("date"), "text")


def _csv(spark: SparkSession, path: str, required: tuple[str, ...], what: str) -> DataFrame:
    """All cells of a CSV file as stripped texts, under stripped names without a byte order mark; row: the line of a record in a file without line breaks in cells."""
    if not exists(spark, path):
        raise ValueError(f"could not read {what}: {path}")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    cells = {n: strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for n, c in names.items()}
    return raw.select(F.monotonically_increasing_id().alias("_at"), *[c.alias(n) for n, c in cells.items()])


def item_bank(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, item_id, prompt, min_value, max_value, scoring_values of a CSV file.

    Cells are stripped, blank bounds are null. Errors name file and row: missing columns, blank ids or prompts, numbers that
    are none, broken scales (item_error), ids that stand twice, no rows. An item bank is one small file, numbered in one task.
    """
    own = _csv(spark, path, ("item_id", "prompt", "min_value", "max_value"), "item bank")
    if "scoring_values" not in own.columns:
        own = own.withColumn("scoring_values", F.lit(""))
    own = own.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at")))
    number = lambda c: F.when(F.col(c) != "", F.col(c).try_cast("double"))
    bad_number = lambda c: F.when((F.col(c) != "") & F.col(c).try_cast("double").isNull(), F.concat(F.lit(": could not convert string to float: "), F.to_json(F.struct(F.col(c).alias("v")))))
    rows = own.select("ordinal", "item_id", "prompt", number("min_value").alias("low"), number("max_value").alias("high"), "scoring_values", F.coalesce(bad_number("min_value"), bad_number("max_value")).alias("cell"))
    first = F.when(F.col("item_id") == "", " has a blank item_id").when(F.col("prompt") == "", " has a blank prompt").when(F.col("cell").isNotNull(), F.col("cell"))
    broken = F.concat(F.lit(": "), item_error(F.col("item_id"), F.col("prompt"), F.col("low"), F.col("high"), F.col("scoring_values")))
    rows = rows.withColumn("error", F.coalesce(first, broken))
    wrong = rows.filter("error is not null").orderBy("ordinal").select("ordinal", "error").limit(1).collect()
    if wrong:
        raise ValueError(f"{path}:{wrong[0]['ordinal'] + 1}{wrong[0]['error']}")
    if not rows.limit(1).count():
        raise ValueError(f"{path} has no data rows")
    if rows.groupBy("item_id").count().filter("count > 1").limit(1).count():
        raise ValueError("item_id values must be unique")
    return rows.select("ordinal", "item_id", "prompt", F.col("low").alias("min_value"), F.col("high").alias("max_value"), "scoring_values")


RATES = ("input_per_million", "cached_input_per_million", "output_per_million")


def price_rows(spark: SparkSession, path: str, model: str, tier: str = "standard") -> DataFrame:
    """The price rows of a model and tier, rates as numbers."""
    own = _csv(spark, path, ("model", "service_tier", *RATES, "as_of", "source_url"), "pricing file")
    return own.filter((F.col("model") == model) & (F.col("service_tier") == tier)).select("model", "service_tier", *[F.col(r).try_cast("double").alias(r) for r in RATES], "as_of", "source_url")


def pricing(spark: SparkSession, path: str, model: str, tier: str = "standard") -> Pricing:
    """The one price of a model and tier; none, several or a malformed one are errors."""
    rows = price_rows(spark, path, model, tier).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} has {'duplicate' if rows else 'no'} pricing for model {model!r} and service tier {tier!r}")
    r = rows[0]
    try:
        return Pricing(model, *[r[x] for x in RATES], r["as_of"], tier, r["source_url"])
    except ValueError as e:
        raise ValueError(f"invalid pricing for model {model!r} in {path}: {e}") from e


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq (1-based line number), line of a text file. Lines are read apart, so a file of any size takes many tasks; their order is that of Spark's splits, each counted once."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    parts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each split
    return lines.join(F.broadcast(parts), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("least") + 1).alias("seq"), F.col("value").alias("line"))


def attempt_log(spark: SparkSession, path: str) -> DataFrame:
    """seq, record (variant), job_id for each line of a JSONL log; a missing file has none, blank lines are skipped, a malformed line is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], "seq bigint, record variant, job_id string")
    own = log_lines(spark, path).filter(strip(F.col("line")) != "").select("seq", F.try_parse_json("line").alias("record"))
    own = own.withColumn("job_id", F.try_variant_get("record", "$.job_id", "string"))
    bad = own.filter("record is null or coalesce(job_id, '') = ''").orderBy("seq").select("seq", F.col("record").isNull().alias("json")).limit(1).collect()
    if bad:
        raise ValueError(f"invalid {'JSON' if bad[0]['json'] else 'job record'} in {path} at line {bad[0]['seq']}")
    return own


def latest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each job of a JSONL log, unchecked, with the line where the job first stood (ord)."""
    own = log_lines(spark, path).filter(strip(F.col("line")) != "").withColumn("record", F.parse_json("line"))
    own = own.withColumn("job_id", F.variant_get("record", "$.job_id", "string"))
    return own.groupBy("job_id").agg(F.max_by("line", "seq").alias("line"), F.min("seq").alias("ord")).select("job_id", "ord", F.parse_json("line").alias("record"))


def study_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), characters of all files with a known suffix, in path order."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    own = _texts(spark, root, recursiveFileLookup=True).select(F.substring_index(F.col("path"), base.rstrip("/") + "/", -1).alias("path"), F.length("value").alias("characters"))
    return own.filter(F.col("path").rlike(f"(?i)\\.({'|'.join(SUFFIXES)})$")).orderBy("path")


def read_study_file(path: str, root: str) -> str:
    """One file of a study on the driver: inside the folder, of a known suffix, not too long."""
    top = os.path.realpath(root)
    target = os.path.realpath(os.path.join(top, path))
    if target == top or not target.startswith(top + os.sep):
        raise ValueError("Path must stay inside the study folder.")
    if not os.path.isfile(target):
        raise ValueError(f"Study file not found: {path}")
    if os.path.splitext(target)[1].lower().lstrip(".") not in SUFFIXES:
        raise ValueError(f"Unsupported study file: {path}")
    text = read_text(target)
    if len(text) > MAX_FILE_CHARACTERS:
        raise ValueError(f"{path} is too large: {len(text):,} characters, of which at most {MAX_FILE_CHARACTERS:,} are given out")
    return text


def read_text(path: str) -> str:
    """A small file as it stands: instructions, for example."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Bytes of a file that a hash reads at once.
HASH_BLOCK = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            digest = hashlib.sha256()
            store, inner = store_of(path)
            with store.open_input_stream(inner, buffer_size=0) as f:
                while block := f.read(HASH_BLOCK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "sha256"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of a file, or of each *.txt directly in a folder, in path order.

    Spark lists the files; their contents are read in blocks of HASH_BLOCK by the tasks, from any store that pyarrow opens by its
    address, so a file of any size takes one block of memory.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    read = spark.read.format("binaryFile")
    found = (read.option("pathGlobFilter", "*.txt").load(path) if folder else read.load(path)).select("path")
    found = found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return found.mapInArrow(_digests, "path string, sha256 string").withColumn("path", F.regexp_replace("path", "^file:/*", "/")).orderBy("path")
