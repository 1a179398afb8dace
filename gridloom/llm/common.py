"""What the text operators share: the shared work folder, bounded Arrow batches, word hashing, SQL helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: with texts of some 100 KB a batch stays far below the memory of a Python worker.
ARROW_ROWS = 512
#: Bytes in one Arrow batch: pairs of long texts' shingle sets take some 300 KB a row.
ARROW_BYTES = 16 << 20

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by rows and bytes; texts are long, so the default of 10,000 rows without a bound of bytes is too much."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gridloom-"))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every run gets its own, so nothing is overwritten or read by another run."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete work tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and give it to body: a plain reference inside a lambda would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


#: Powers of two: the shifts of running().
_SHIFTS = [1 << k for k in range(31)]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or running maxima, of an array; step joins two values.

    By doubling: each of log n passes joins the value `shift` places before, so an array is made log n times and never
    grown element by element.
    """
    shifts = F.filter(F.array(*map(F.lit, _SHIFTS)), lambda d: d < F.size(values))
    return F.aggregate(shifts, values, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, step(x, F.get(a, i - d))).otherwise(x)))


def places(text: Column, pattern: str | Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """The matches of a pattern with their places, as an array of body(match, start, what stands before it).

    The matches and the parts between them, laid end to end, give the places; starts count code points. An empty array if there
    is none. The time is that of two scans and n log n steps for n matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def lay(hits: Column) -> Column:
        own = lambda parts: let(
            running(F.transform(hits, lambda x, i: F.length(F.get(parts, i)) + F.length(x)), lambda a, b: a + b),
            lambda ends: F.transform(hits, lambda x, i: body(x, F.get(ends, i) - F.length(x), F.get(parts, i))),
        )
        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), own))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lay)


#: Code points in one block of cut().
_BLOCK = 256


def blocks_of(text: Column) -> Column:
    """A text in blocks of _BLOCK code points, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """What stands from start to end (code points, from 0) in a text given in blocks: substring() would walk from the text's start each time."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
    own = lambda i, a, n: F.substr(F.coalesce(F.get(blocks, i), F.lit("")), a, n)
    head, tail = start - first * _BLOCK, end - last * _BLOCK
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(first == last, own(first, head + 1, end - start)).otherwise(F.concat(own(first, head + 1, F.lit(_BLOCK)), middle, own(last, F.lit(1), tail)))


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for up to `most` words; the rest is hashed each time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most and len(word) < 64:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ in order; bytes.split() splits at just these characters."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: An odd factor of full width; window hashes are polynomials in it over mixed word hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each window of `size` words, by doubling: a window of 2n is made of two of n."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, span, out, power = 0, 1, np.zeros(n, np.uint64), mixed(h)
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = mixed(out * FACTOR + power[done : done + n] + np.uint64(span))
                done += span
            left >>= 1
            if left:
                power = mixed(power[:-span] * FACTOR + power[span:] + np.uint64(span))
                span *= 2
    return out
