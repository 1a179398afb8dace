"""Masking of identifiers: detectors, spans, stable typed placeholders, splices, mergeable summaries.

A detector is any function text -> iterable of (label, start, end), code points, end exclusive; it runs once over each text, and what
it finds is written to the shared folder. Placeholders are numbered by first appearance within a scope, so equal identifiers share
one; the distinct identifiers are dealt by ranges, so a scope with a large share of them takes as large a share of the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import normalized, splice
from gridloom.operators.ordered import running
from gridloom.shared import written

#: The labels of identifiers.
LABELS = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")
Spans = Iterable[tuple[str, int, int]]

#: What the offline detector finds, in order of precedence; persons and addresses need a model.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|token|secret|api[_-]?key)\b\s?[=:]\s?\"?[A-Za-z0-9+/_.-]{8,}\"?)",
    "private_url": r"https?://[^\s<>\"']+",
    "private_email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "private_phone": r"\+[0-9][ ().0-9-]{7,}[0-9]",
    "account_number": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "private_date": r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])",
}


def pattern_detector(text: str) -> list[tuple[str, int, int]]:
    """Identifiers by patterns; of overlapping ones the first kind of PATTERNS stands."""
    taken: list[tuple[int, int]] = []
    out = []
    for label, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append((label, *m.span()))
    return sorted(out, key=lambda x: x[1:])


@dataclass(frozen=True)
class Deidentifier:
    """What is masked and by which detector. load gives the detector; it is called once a Python worker, when the first text comes."""

    labels: tuple[str, ...] = LABELS
    load: Callable[[], Callable[[str], Spans]] = lambda: pattern_detector
    device: str = "cpu"
    warning: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(sorted(set(self.labels))))
        if not self.labels:
            raise ValueError("labels must contain at least one privacy label")
        if unknown := sorted(set(self.labels) - set(LABELS)):
            raise ValueError(f"unknown privacy labels: {', '.join(unknown)}")
        if self.device not in ("cpu", "cuda"):
            raise ValueError("device must be 'cpu' or 'cuda'")

    def settings(self, scope: str = "transcript") -> dict:
        """For a run's manifest."""
        return {"enabled": True, "device": self.device, "labels": list(self.labels), "scope": scope}


SPAN = "array<struct<label:string,start:int,end:int>>"


def spans(text: Column, d: Deidentifier) -> Column:
    """The detector's spans of the wanted labels, by start and end. null and empty texts have none."""
    load = d.load
    held: list[Callable[[str], Spans]] = []

    @F.pandas_udf(SPAN)
    def found(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return texts.map(lambda t: [{"label": a, "start": b, "end": c} for a, b, c in held[0](t)] if t else [])

    wanted = F.filter(found(text), lambda s: s["label"].isin(list(d.labels)))
    return F.array_sort(wanted, lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] < b["end"])), -1).when((a["start"] == b["start"]) & (a["end"] == b["end"]), 0).otherwise(1))


def bad_spans(text: Column, found: Column) -> Column:
    """Whether any of the sorted spans is empty, out of range or overlaps the one before it."""
    wrong = F.transform(found, lambda s, i: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(text)) | F.coalesce(s["start"] < F.get(found, i - 1)["end"], F.lit(False)))
    return F.exists(wrong, lambda x: x)


def placeholders(found: DataFrame) -> DataFrame:
    """scope, label, norm, placeholder for spans (scope, label, original, seq, start): equal texts in a scope share one."""
    return _numbered(found.withColumn("norm", normalized("original")))


def _numbered(found: DataFrame) -> DataFrame:
    """placeholders() of spans with their norm."""
    first = found.groupBy("scope", "label", "norm").agg(F.min(F.struct("seq", "start")).alias("first"))
    return running(first, ["scope", "label"], ["first"]).select("scope", "label", "norm", F.format_string("[%s_%d]", F.upper("label"), "n").alias("placeholder"))


MATCH = "struct<label:string,start:int,end:int,original:string,replacement:string>"


def masked(texts: DataFrame, d: Deidentifier | None = None) -> DataFrame:
    """key, text (masked), matches, warning, labels_applied for texts (key, scope, seq, text).

    key tells rows apart, seq orders them within their scope (and may be a struct). Spans that overlap or lie outside abort
    before anything is masked. Spans travel without the texts until the last join.
    """
    d = d or Deidentifier()
    own = texts.select("key", "scope", "seq", "text", spans(F.col("text"), d).alias("spans"))
    original = lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"])
    each = F.explode(F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), original(s).alias("original"))))
    each = own.select("key", "scope", "seq", bad_spans(F.col("text"), F.col("spans")).alias("bad"), each.alias("s")).select("key", "scope", "seq", "bad", "s.*")
    each = written(each.withColumn("norm", normalized("original")), "spans")
    if each.filter("bad").limit(1).count():
        raise RuntimeError("the detector returned invalid or overlapping spans; no text was sent")
    named = _numbered(each).withColumnsRenamed({"scope": "_scope", "label": "_label", "norm": "_norm"})
    each = each.join(named, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("label") == F.col("_label")) & (F.col("norm") == F.col("_norm")))
    found = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "original", F.col("placeholder").alias("replacement")))).alias("m"))
    found = found.select("key", F.transform("m", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["original"].alias("original"), x["replacement"].alias("replacement"))).alias("matches"))
    out = texts.select("key", "text").join(found, "key", "left").withColumn("matches", F.coalesce("matches", F.expr(f"cast(array() as array<{MATCH}>)")))
    return out.select("key", splice(F.col("text"), F.col("matches")).alias("text"), "matches", F.lit(d.warning).cast("string").alias("warning"), F.array(*map(F.lit, d.labels)).alias("labels_applied"))


def mask_text(spark, text: str, d: Deidentifier | None = None) -> dict[str, Any]:
    """One text on its own: text, matches, warning, labels_applied."""
    if not isinstance(text, str):
        raise TypeError("text must be a string")
    one = spark.createDataFrame([(0, None, 0, text)], "key int, scope string, seq int, text string")
    return masked(one, d).drop("key").first().asDict(recursive=True)


def summarised(results: DataFrame) -> DataFrame:
    """key and the summary of each masked text: text_count, identifier_count, counts_by_label, warnings, labels_applied."""
    labels = F.transform("matches", lambda m: m["label"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x)).cast("bigint"))))
    warnings = F.when(F.col("warning").isNotNull(), F.array("warning")).otherwise(F.expr("cast(array() as array<string>)"))
    return results.select("key", F.lit(1).cast("bigint").alias("text_count"), F.size("matches").cast("bigint").alias("identifier_count"), counts.alias("counts_by_label"), warnings.alias("warnings"), "labels_applied")


def combined(summaries: DataFrame, *by: str, order: str = "seq") -> DataFrame:
    """Summaries put together for each group (or all): sums, sums by label, all labels applied, distinct warnings in order of their first row.

    Labels are a closed set, so each is a sum of its own and all is one aggregation with partial results. Warnings are distinct
    before they are collected: they come from detectors and are few.
    """
    sums = {label: F.sum(F.coalesce(F.col("counts_by_label").getItem(label), F.lit(0))) for label in LABELS}
    own = summaries.groupBy(*by).agg(
        F.coalesce(F.sum("text_count"), F.lit(0)).alias("text_count"),
        F.coalesce(F.sum("identifier_count"), F.lit(0)).alias("identifier_count"),
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sums.items()]).alias("sums"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels_applied")))).alias("labels_applied"),
    )
    said = summaries.select(*by, order, F.posexplode("warnings").alias("at", "warning")).groupBy(*by, "warning").agg(F.min(F.struct(order, "at")).alias("first"))
    said = said.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "warning"))), lambda x: x["warning"]).alias("warnings"))
    own = own.join(said, list(by), "left") if by else own.crossJoin(said)  # one row each
    counts = F.map_from_entries(F.filter("sums", lambda x: x["value"] > 0))
    return own.select(*by, "text_count", "identifier_count", counts.alias("counts_by_label"), F.coalesce("warnings", F.expr("cast(array() as array<string>)")).alias("warnings"), "labels_applied")


def payload(summary: DataFrame) -> DataFrame:
    """The summary as JSON for an audit, without any original."""
    rest = [c for c in summary.columns if c not in ("text_count", "identifier_count", "counts_by_label", "warnings", "labels_applied")]
    return summary.select(*rest, F.to_json(F.struct("text_count", "identifier_count", "counts_by_label", "warnings", "labels_applied")).alias("payload"))


def preview(text: Column, matches: Column, warning: Column, reveal: bool = True) -> Column:
    """A local review of what was found; originals in quotes, or hidden."""
    said = lambda m: F.concat(F.lit("'"), m["original"], F.lit("'")) if reveal else F.lit("[hidden]")
    lines = F.transform(matches, lambda m: F.concat(F.lit("- "), m["label"], F.lit(": "), said(m), F.lit(" -> "), m["replacement"]))
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("- none")))
    end = F.when(warning.isNotNull(), F.array(F.lit(""), F.concat(F.lit("Warning: "), warning))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(F.array(text, F.lit(""), F.lit("Detected identifiers:")), lines, end), "\n")


def mask_columns(records: DataFrame, fields: list[str], order: str, d: Deidentifier | None = None, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """records with the text fields masked, and the summary of each row (key: order).

    order must be unique; placeholders are numbered by it, then by the order of the fields. Nulls stay null. scope: a column
    whose rows share placeholders; without one all rows do.
    """
    if not fields or any(not f for f in fields):
        raise ValueError("fields must contain non-empty field names")
    if len(fields) != len(set(fields)):
        raise ValueError("fields must be unique")
    kinds = dict(records.dtypes)
    for f in fields:
        if f not in kinds:
            raise ValueError(f"records have no field {f!r}")
        if kinds[f] != "string":
            raise TypeError(f"field {f!r} must be text or null")
    if scope and records.filter(F.coalesce(F.trim(scope), F.lit("")) == "").limit(1).count():
        raise ValueError(f"every row needs a non-empty {scope!r}")
    place = F.col(scope) if scope else F.lit(None).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("text")) for i, f in enumerate(fields)])).alias("x")
    texts = records.select(F.col(order).alias("o"), place.alias("scope"), each).filter("x.text is not null")
    texts = texts.select(F.struct("o", "x.i").alias("key"), "scope", F.struct("o", "x.i").alias("seq"), "x.text")
    found = masked(texts, d)
    wide = found.groupBy(F.col("key.o").alias("_o")).agg(*[F.max(F.when(F.col("key.i") == i, F.col("text"))).alias(f"_new{i}") for i in range(len(fields))])
    out = records.join(wide, records[order] == wide["_o"], "left").drop("_o")
    out = out.withColumns({f: F.col(f"_new{i}") for i, f in enumerate(fields)}).select(*records.columns)
    each_summary = summarised(found).withColumn("seq", F.col("key")).withColumn(order, F.col("key.o"))
    return out, combined(each_summary, order)


def mask_nested(values: DataFrame, order: str, column: str, d: Deidentifier | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON inputs with their texts masked: strings at the top, under input, content or text, and all within a function call's output; ids, roles and types stay."""
    take = F.pandas_udf(lambda values: values.map(lambda v: _texts_of(v)[1]), "array<string>")
    put = F.pandas_udf(lambda values, new: pd.Series([_put(v, n) for v, n in zip(values, new, strict=True)], dtype=object), "string")
    own = values.select(order, F.col(column).alias("value"), take(column).alias("texts"))
    each = own.select(order, F.posexplode("texts").alias("i", "text"))
    found = masked(each.select(F.struct(order, "i").alias("key"), F.lit(None).cast("string").alias("scope"), F.struct(order, "i").alias("seq"), "text"), d)
    new = found.groupBy(F.col(f"key.{order}").alias(order)).agg(F.transform(F.array_sort(F.collect_list(F.struct("key.i", "text"))), lambda x: x["text"]).alias("new"))
    out = own.join(new, order, "left").select(order, put("value", "new").alias(column))
    return out, combined(summarised(found).withColumn("seq", F.col("key")))


def _walk(value: Any, texts: Iterator[str] | None, out: list[str], here: bool, below: bool) -> Any:
    """Collect the texts to mask in order, or put those of texts in their place."""
    if isinstance(value, str):
        if not (here or below):
            return value
        out.append(value)
        return next(texts) if texts else value
    if isinstance(value, list):
        return [_walk(v, texts, out, here, below) for v in value]
    if isinstance(value, dict):
        called = value.get("type") == "function_call_output"
        return {k: _walk(v, texts, out, below or k in ("input", "content", "text") or (called and k == "output"), below or (called and k == "output")) for k, v in value.items()}
    return value


def _texts_of(raw: str | None) -> tuple[Any, list[str]]:
    out: list[str] = []
    return _walk(json.loads(raw) if raw is not None else None, None, out, True, False), out


def _put(raw: str | None, new: Iterable[str] | None) -> str | None:
    return None if raw is None else json.dumps(_walk(json.loads(raw), iter([] if new is None else new), [], True, False), ensure_ascii=False)


def mask_file(spark, path: str, d: Deidentifier | None = None) -> tuple[bytes, dict]:
    """The masked copy of a text file, to be uploaded in its place, and its result."""
    with open(path, "rb") as f:
        raw = f.read()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError("local de-identification supports UTF-8 text files; extract text from binary documents before uploading") from e
    result = mask_text(spark, text, d)
    return result["text"].encode(), result


def label_counts(found: DataFrame) -> DataFrame:
    """A mergeable histogram of labels for each scope, as a sorted map in text form."""
    own = found.groupBy("scope", "label").agg(F.count("*").alias("n"))
    return own.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat_ws("=", x["label"], x["n"].cast("string"))), ",").alias("counts"), F.sum("n").alias("identifiers"))
