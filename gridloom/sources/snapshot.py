"""The attempt log in batches, and the latest record of each job kept beside it.

A log is a folder of batches, `batch-<records before the run>-<number>`, each a folder of JSON lines that gets its name when it is
complete; names ascend as batches come. Beside it, in `<log>.snapshot`, stands a table of the latest records, bucketed by job_id,
with the name of the last batch in it. What is read is that table and the batches behind it: only the tail is aggregated, and it meets the
table by a join for which the table isn't shuffled. compact() writes the two together as the next table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import attempts
from gridloom.shared import discard, exists, listed, renamed
from gridloom.sources.sinks import read_small, write_text


def batch_name(start: int, number: int) -> str:
    return f"batch-{start:015d}-{number:09d}"


def append_batch(records: DataFrame, log_path: str, name: str | list[str]) -> bool:
    """Add a batch of records under its name, all at once; False if the log has it already.

    Several names are as many batches, told apart by the column batch and written together: each gets its name in one step. Half of
    what a lost driver left behind has another name, which no reader sees, and is written anew.
    """
    spark, names = records.sparkSession, [name] if isinstance(name, str) else name
    if exists(spark, f"{log_path}/{names[0]}"):
        return False
    half = f"{log_path}/.{names[0]}"
    value = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")
    if len(names) == 1:
        records.select(value).write.mode("overwrite").text(half)
        renamed(spark, half, f"{log_path}/{names[0]}")
        return True
    records.select(value, F.col("batch").alias("name")).write.mode("overwrite").partitionBy("name").text(half)
    renamed(spark, *[x for n in names for x in (f"{half}/name={n}", f"{log_path}/{n}")])
    discard(spark, half)
    return True


def _batch(path: Column) -> Column:
    return F.regexp_extract(path, "/(batch-[0-9]+-[0-9]+)/", 1)


def records(spark: SparkSession, log_path: str, schema: str, after: str | None = None) -> DataFrame:
    """The records of a log, or of its batches behind the named one: the others' files are not opened. Lines outside of batches count as the first."""
    if not exists(spark, log_path):
        return spark.createDataFrame([], schema).filter(F.lit(False))  # so that the planner knows: what is joined with it isn't shuffled
    own = spark.read.schema(schema).option("recursiveFileLookup", "true").json(log_path, mode="FAILFAST")
    return own if after is None else own.filter(_batch(F.col("_metadata.file_path")) > after)


class Snapshot:
    """The latest record of each job of a log (with schema, which has job_id, seq and batch)."""

    def __init__(self, spark: SparkSession, log_path: str, schema: str, buckets: int | None = None):
        self.spark, self.log_path, self.schema = spark, log_path, schema
        self.folder = f"{log_path.rstrip('/')}.snapshot"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _kept(self) -> dict | None:
        path = f"{self.folder}/current.json"
        return json.loads(read_small(self.spark, path)) if exists(self.spark, path) else None

    def _table(self, kept: dict) -> DataFrame:
        """The kept table by its name; a session that doesn't know it yet is told where it lies."""
        if not self.spark.catalog.tableExists(kept["table"]):
            path = kept["path"].replace("'", "\\'")
            self.spark.sql(f"create table {kept['table']} ({kept['columns']}) using parquet clustered by (job_id) sorted by (job_id) into {kept['buckets']} buckets location '{path}'")
        return self.spark.table(kept["table"])

    def tail(self) -> DataFrame:
        """The records behind the kept table."""
        kept = self._kept()
        return records(self.spark, self.log_path, self.schema, kept and kept["last"])

    def latest(self) -> DataFrame:
        """job_id, ord, attempts and the last record of each job, as attempts.state() gives them over the whole log."""
        kept = self._kept()
        if kept and not any(n > kept["last"] for n in listed(self.spark, self.log_path) if n.startswith("batch-")):
            return self._table(kept)
        tail = attempts.state(records(self.spark, self.log_path, self.schema, kept and kept["last"]))
        if not kept:
            return tail
        rest = [c for c in tail.columns if c != "job_id"]
        sides = [df.select("job_id", F.struct(*rest).alias(n)) for df, n in ((self._table(kept), "_old"), (tail, "_new"))]
        both = sides[0].join(sides[1], "job_id", "full")
        newer = F.coalesce(F.col("_new.seq") > F.col("_old.seq"), F.col("_new").isNotNull())
        row = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
        first, count = F.least("_old.ord", "_new.ord"), F.coalesce("_old.attempts", F.lit(0)) + F.coalesce("_new.attempts", F.lit(0))
        own = both.select("job_id", row.alias("_row"), first.alias("ord"), count.alias("attempts"))
        return own.select("job_id", *[F.col(c) if c in ("ord", "attempts") else F.col(f"_row.{c}").alias(c) for c in rest])

    def compact(self) -> None:
        """Write what latest() gives as the kept table; without a tail nothing happens. The table before it stays for its readers, older ones go."""
        kept = self._kept()
        if not self.tail().head(1):
            return
        rows, name = self.latest(), f"gridloom_snapshot_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "job_id").sortBy("job_id").option("path", path).saveAsTable(name)
        last = self.spark.table(name).agg(F.max("batch")).first()[0]
        columns = rows._jdf.schema().toDDL()
        now = {"table": name, "path": path, "last": last or "", "buckets": self.buckets, "columns": columns, "before": kept and {k: kept[k] for k in ("table", "path")}}
        write_text(self.spark, f"{self.folder}/current.json", json.dumps(now))
        if old := kept and kept.get("before"):
            self.spark.sql(f"drop table if exists {old['table']}")
            discard(self.spark, old["path"])
