"""Versioned contracts for structured output: strict validation of JSON texts against a declared shape.

A shape maps each key to its kinds ("text", "number", "int", "null", "list", "object"), with item shapes for lists of objects.
Keys must all be there and no others; numbers are finite and no flags. It is checked over variants, so without Python; only a
key that occurs twice in one object and numbers that JSON doesn't know are refused here where Python parsers may take them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import json_kind

#: JSON Schema types of the kinds.
_TYPES = {"text": "string", "number": "number", "int": "integer", "null": "null", "list": "array", "object": "object"}


@dataclass(frozen=True)
class Field:
    kinds: tuple[str, ...]
    items: dict[str, Field] | None = None  # of a list of objects
    low: int | None = None
    high: int | None = None
    most: int | None = None  # length of a list
    least: int = 0


@dataclass(frozen=True)
class Contract:
    name: str
    version: str
    fields: dict[str, Field] = field(default_factory=lambda: {"rating": Field(("number", "text", "null"))})

    @property
    def contract_id(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def output_format(self) -> dict:
        return {"type": "json_schema", "name": f"{self.name}_v{self.version}", "strict": True, "schema": _schema(self.fields, self.name)}

    def error(self, text: Column) -> Column:
        """What is wrong with an answer's JSON; null for a sound one."""
        value = F.try_parse_json(text)
        return F.when(value.isNull(), "Invalid JSON").otherwise(_object_error(value, self.fields, ""))

    def parsed(self, text: Column) -> Column:
        """The answer as a variant where it is sound."""
        return F.when(self.error(text).isNull(), F.try_parse_json(text))


def _schema(fields: dict[str, Field], title: str) -> dict:
    def one(name: str, f: Field) -> dict:
        kinds = []
        for k in f.kinds:
            kind: dict = {"type": _TYPES[k]}
            if k == "list" and f.items:
                kind["items"] = _schema(f.items, name)
            for key, limit in (("maxItems", f.most), ("minItems", f.least or None), ("minimum", f.low), ("maximum", f.high)):
                if limit is not None:
                    kind[key] = limit
            kinds.append(kind)
        return {**(kinds[0] if len(kinds) == 1 else {"anyOf": kinds}), "title": name.replace("_", " ").title()}

    return {"type": "object", "title": title, "properties": {n: one(n, f) for n, f in fields.items()}, "required": list(fields), "additionalProperties": False}


def _object_error(value: Column, fields: dict[str, Field], path: str) -> Column:
    keys = F.json_object_keys(F.to_json(value))
    names = F.array(*map(F.lit, fields))
    missing, extra = F.array_except(names, keys), F.array_except(keys, names)
    at = lambda n: f"{path}{n}"
    first = F.lit(None).cast("string")
    for name, f in reversed(fields.items()):
        own = F.try_variant_get(value, f"$['{name}']", "variant")
        first = F.coalesce(_field_error(own, f, at(name)), first)
    wrong = lambda a, what: F.when(F.size(a) > 0, F.concat(F.lit(path), F.element_at(a, 1), F.lit(f": {what}")))
    return F.when(json_kind(value) != "object", f"{path.rstrip('.')}: Input should be an object".lstrip(": ")).otherwise(F.coalesce(wrong(missing, "Field required"), wrong(extra, "Extra inputs are not permitted"), first))


def _field_error(value: Column, f: Field, path: str) -> Column:
    kind = F.coalesce(json_kind(value), F.lit("null"))
    number = F.try_variant_get(value, "$", "double")
    whole = (kind == "number") & (number == F.floor(number))
    fits = kind.isin([k for k in f.kinds if k != "int"]) | (whole if "int" in f.kinds else F.lit(False))
    out = F.when(~fits, f"{path}: Input should be {' or '.join(_TYPES[k] for k in f.kinds)}")
    if f.low is not None:
        out = out.when(number < f.low, f"{path}: Input should be greater than or equal to {f.low}")
    if f.high is not None:
        out = out.when(number > f.high, f"{path}: Input should be less than or equal to {f.high}")
    if "list" in f.kinds:
        parts = F.try_variant_get(value, "$", "array<variant>")
        if f.most is not None:
            out = out.when(F.size(parts) > f.most, f"{path}: List should have at most {f.most} item{'s' * (f.most != 1)}")
        if f.least:
            out = out.when(F.size(parts) < f.least, f"{path}: List should have at least {f.least} item{'s' * (f.least != 1)}")
        if f.items:
            errors = F.filter(F.transform(parts, lambda x: _object_error(x, f.items, f"{path}.")), lambda e: e.isNotNull())
            return F.coalesce(out, F.get(errors, F.lit(0)))
    return out


def schema_json(contract: Contract) -> str:
    return json.dumps(contract.output_format, ensure_ascii=False)


#: The plain rating of a study.
RATING = Contract("rating", "1")
_CITATION = {"text": Field(("text",))}
#: A rating with at most one justification, which quotes the text it was sent.
CITED_RATING = Contract(
    "rating_with_citations",
    "1",
    {"rating": Field(("number", "text", "null")), "justifications": Field(("list",), {"explanation": Field(("text",)), "citations": Field(("list",), _CITATION, least=1, most=1)}, most=1)},
)
#: The three model stages of the diary workflow.
DIARY_THEMES = Contract("diary_themes", "1", {"themes": Field(("list",), {"label": Field(("text",)), "description": Field(("text",)), "quote": Field(("text",)), "importance": Field(("int",), low=1, high=5)})})
THEME_SYNTHESIS = Contract("theme_synthesis", "1", {"themes": Field(("list",), {"title": Field(("text",)), "description": Field(("text",)), "candidate_ids": Field(("list",))})})
THEME_AUDIT = Contract("theme_audit", "1", {"explanation": Field(("text",)), "quotes": Field(("list",), {"diary_id": Field(("text",)), "date": Field(("text",)), "text": Field(("text",))}), "uncertainty": Field(("text",))})
