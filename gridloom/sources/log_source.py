"""The attempt log as a Spark data source, "gridloom_log": JSON lines in folders by run, with line numbers that are known before a line is read.

A write gives each task a file; what the tasks say of their files (lines, bytes, the place of every MARK-th line, the statuses
in them) becomes one commit, and only files of a commit are read. So a reader splits files by bytes and still knows the number of
each line, and files of other runs, or without a wanted status, aren't opened. Lines are numbered from 1 over all commits in their
order, files in the order of their tasks.

    use(spark)
    records.write.format("gridloom_log").mode("append").save(path)   # run, job_id, status, line
    spark.read.format("gridloom_log").load(path)                     # seq, run, job_id, status, line

use() registers the source and lets Spark hand filters to Python sources in the session, without which it refuses to read. A log without commits is empty; lines must
hold no line breaks; runs may be any text. Of a job's commit that fails nothing is visible.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

from gridloom.shared import store_of

#: A file's places are kept for every so many lines, so a task reads at most so many.
MARK = 50_000
_COLUMNS = ("seq", "run", "job_id", "status", "line")


@dataclass
class Files(WriterCommitMessage):
    """What a task has written: file -> run, lines, bytes, the byte where each MARK-th line starts, statuses."""

    files: list[dict] = field(default_factory=list)


@dataclass
class Part(InputPartition):
    """Some lines of a file, from a byte to another; first is the number of the first."""

    path: str
    run: str
    start: int
    end: int
    first: int


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_log"

    def schema(self) -> str:
        return "seq bigint, run string, job_id string, status string, line string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is appended to: mode('append')")
        missing = {"run", "job_id", "status", "line"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"records lack {', '.join(sorted(missing))}")
        return LogWriter(self.options["path"])


def use(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class LogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Files:
        """One file a run and task, under a name of its own: a repeated task writes other files, and one of them is committed."""
        store, top = store_of(self.path)
        name, out, said = f"{uuid.uuid4().hex}.jsonl", {}, {}
        try:
            for r in iterator:
                run = r["run"]
                if run not in out:
                    place = f"run={quote(run, safe='')}/{name}"
                    store.create_dir(f"{top}/{os.path.dirname(place)}")
                    out[run] = store.open_output_stream(f"{top}/{place}")
                    said[run] = {"file": place, "run": run, "lines": 0, "bytes": 0, "marks": [], "statuses": set()}
                own = said[run]
                if "\n" in r["line"]:
                    raise ValueError("a line of the log holds a line break")
                if own["lines"] % MARK == 0:
                    own["marks"].append(own["bytes"])
                raw = json.dumps([r["job_id"], r["status"]], ensure_ascii=False).encode() + b"\t" + r["line"].encode() + b"\n"
                out[run].write(raw)
                own["lines"] += 1
                own["bytes"] += len(raw)
                own["statuses"].add(r["status"])
        finally:
            for f in out.values():
                f.close()
        return Files([x | {"statuses": sorted(x["statuses"], key=lambda s: (s is None, s))} for x in said.values()])

    def commit(self, messages: list[Files | None]) -> None:
        """The files of all tasks, in their order, as the next commit; another writer's of the same number makes this one fail."""
        store, top = store_of(self.path)
        files = [f for m in messages if m for f in m.files]
        folder = f"{top}/_commits"
        store.create_dir(folder)
        number = len(_commits(store, folder))
        new = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            f.write(json.dumps(files, ensure_ascii=False).encode())
        final = f"{folder}/{number:012d}.json"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            raise RuntimeError(f"commit {number} of {self.path} was made by another writer")
        store.move(new, final)

    def abort(self, messages: list[Files | None]) -> None:
        store, top = store_of(self.path)
        for m in messages:
            for f in m.files if m else ():
                store.delete_file(f"{top}/{f['file']}")


def _commits(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities of run and status choose files; Spark tests the rows' statuses again."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("run",), ("status",)):
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            if name == "status":
                yield f

    def partitions(self) -> list[Part]:
        store, top = store_of(self.path)
        out, first = [], 1
        for commit in _commits(store, f"{top}/_commits"):
            with store.open_input_stream(commit) as f:
                files = json.loads(f.read())
            for x in files:
                runs, statuses = self.wanted.get("run"), self.wanted.get("status")
                if (runs is None or x["run"] in runs) and (statuses is None or statuses & set(x["statuses"])):
                    ends = [*x["marks"][1:], x["bytes"]]
                    out += [Part(f"{self.path}/{x['file']}", x["run"], a, b, first + k * MARK) for k, (a, b) in enumerate(zip(x["marks"], ends, strict=True))]
                first += x["lines"]
        return out or [Part("", "", 0, 0, 1)]  # Spark asks for one at least

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, inner = store_of(part.path)
        with store.open_input_file(inner) as f:
            f.seek(part.start)
            lines = f.read(part.end - part.start).split(b"\n")[:-1]
        for k in range(0, len(lines), 10_000):
            heads, texts = zip(*(x.split(b"\t", 1) for x in lines[k : k + 10_000]), strict=True)
            jobs, statuses = zip(*map(json.loads, heads), strict=True)
            numbers = range(part.first + k, part.first + k + len(texts))
            columns = [pa.array(numbers, pa.int64()), pa.array([part.run] * len(texts)), pa.array(jobs, pa.string()), pa.array(statuses, pa.string()), pa.array([t.decode() for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, list(_COLUMNS))
