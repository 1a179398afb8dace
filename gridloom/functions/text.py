"""String, number and template functions as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What Python's strip() takes off: Unicode white space and four control characters.
_BLANK = "[\\s\\x1c-\\x1f]"


def strip(c: Column) -> Column:
    """White space off both ends, as Python strips it; F.trim takes spaces only."""
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def blank(c: Column) -> Column:
    """Whether strip() leaves nothing; a text is read up to its first other character. A null is blank."""
    return ~F.coalesce(c.rlike(f"(?U)[^{_BLANK[1:]}"), F.lit(False))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){_BLANK}+$", "")


@F.pandas_udf(T.StringType())
def normalized(x: pd.Series) -> pd.Series:
    """Case folded, white space runs as one space: the key under which equal identifiers share a placeholder."""
    return x.map(lambda v: None if v is None else " ".join(v.casefold().split()))


def after(c: Column, marker: str) -> Column:
    """What stands behind the first occurrence of marker; null without one."""
    at = F.instr(c, marker)
    return F.when(at > 0, F.substr(c, at + len(marker)))


def utc_now() -> Column:
    """The time of the query as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def padded(prefix: Column, separator: str, position: Column) -> Column:
    """prefix, separator and a 1-based number of two digits at least, from a 0-based position."""
    return F.concat(prefix, F.lit(separator), F.format_string("%02d", position + 1))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(T.StringType())
def py_g(x: pd.Series) -> pd.Series:
    """%g of a number, as Python prints it."""
    return x.map(lambda v: None if v is None or v != v else f"{v:g}")


def py_round(digits: int):
    """Rounding of the exact binary value, half to even, as Python rounds."""

    @F.pandas_udf(T.DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None or v != v else round(v, digits))

    return rounded


def scale(c: Column) -> Column:
    """'0 = Low | 1 = High' as an array of (value, label); parts without a number give a null value."""
    cut = lambda e: F.instr(e, "=")
    return F.transform(
        F.split(c, "\\|"),
        lambda e: F.struct(F.when(cut(e) > 0, F.trim(F.substr(e, F.lit(1), cut(e) - 1)).try_cast("double")).alias("value"), F.trim(F.substr(e, cut(e) + 1)).alias("label")),
    )


def categories(c: Column) -> Column:
    """'Yes | No' as an array of texts; with any '=' there are none."""
    return F.when(F.contains(c, F.lit("=")) | (strip(c) == ""), F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(c, "\\|"), lambda e: F.trim(e)))


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.greatest(F.bround(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


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
    whole = F.concat(own(first, head + 1, F.lit(_BLOCK)), middle, own(last, F.lit(1), tail))
    return F.when(end <= start, "").when(first == last, own(first, head + 1, end - start)).otherwise(whole)


def splice(text: Column, matches: Column) -> Column:
    """The text with the replacement of each match (start, end, replacement) in its place; matches are sorted and don't overlap."""
    piece = lambda b: F.transform(matches, lambda m, i: F.concat(cut(b, F.when(i == 0, 0).otherwise(F.get(matches, i - 1)["end"]), m["start"]), m["replacement"]))
    whole = F.transform(F.array(blocks_of(text)), lambda b: F.concat(F.array_join(piece(b), ""), cut(b, F.element_at(matches, -1)["end"], F.length(text))))
    return F.when(F.size(matches) > 0, whole[0]).otherwise(text)


def dollars(c: Column) -> Column:
    """Four decimals under a cent, else two."""
    four, two = (F.format_string(f"$%.{n}f", py_round(n)(c.cast("double"))) for n in (4, 2))
    return F.when(c < 0.01, four).otherwise(two)


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no blanks and raw Unicode, numbers as Python writes them; NaN is an error."""
    own = {v: canonical(v) for v in x.dropna().unique()}  # jobs share formats
    return x.map(lambda v: None if v is None else own[v])


def canonical(text: str) -> str:
    """canonical_json() of one text."""
    return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def json_kind(value: Column) -> Column:
    """text, number, flag, null, list or object for a variant; null where there is no value."""
    kind = F.schema_of_variant(value)  # as few times as may be: within a lambda each mention is evaluated anew
    names = F.create_map(*[F.lit(x) for pair in (("VOID", "null"), ("STRING", "text"), ("BOOLEAN", "flag"), ("ARRAY", "list"), ("OBJECT", "object")) for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring_index(kind, "<", 1)), F.when(kind.isNotNull(), "number"))


class Template:
    """A prompt template compiled to one concat: values are put in once and never expanded again."""

    @classmethod
    def from_file(cls, path: str, fields: Iterable[str]) -> Template:
        try:
            with open(path, encoding="utf-8") as f:
                return cls(f.read(), fields)
        except OSError as e:
            raise ValueError(f"could not read prompt template: {path}") from e

    def __init__(self, text: str, fields: Iterable[str]):
        self.fields = tuple(fields)
        if len(set(self.fields)) != len(self.fields):
            raise ValueError("template fields must be unique")
        self.parts: list[tuple[str, str | None]] = []
        for literal, name, spec, conversion in Formatter().parse(text):
            if name is not None and (spec or conversion or name not in self.fields):
                raise ValueError(f"template may hold the plain fields {', '.join(self.fields)} only")
            self.parts.append((literal, name))
        unused = set(self.fields) - {n for _, n in self.parts if n}
        if unused:
            raise ValueError(f"template doesn't use: {', '.join(sorted(unused))}")

    def render(self, **values: Column) -> Column:
        if set(values) != set(self.fields):
            raise ValueError(f"template takes exactly: {', '.join(self.fields)}")
        return F.concat(*[p for literal, name in self.parts for p in (F.lit(literal), values[name] if name else F.lit(""))])
