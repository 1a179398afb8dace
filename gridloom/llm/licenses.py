"""License and rights statements by ordered signature rules, in DataFrame operations only.

Each rule has a keyword, a pattern, a label, a priority and a weight. Only the rules whose keyword a text holds are tried, and
every match of a pattern contains its keyword. Of the detections in one text, an interval inside another one of the same or a
higher priority (lower number) falls, a stronger one inside a weaker one stays, and what stays gives labels and score. All is
one projection: no shuffle, nothing leaves the row.

Defined cases: null and empty texts have no words and no labels, score 0; equal rows each give a row; null doc_ids stay.
Positions are exact on texts of any length; time grows with the text and as n log n with its detections, memory with both (some
300 bytes a detection).
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, places, running

#: Characters of a word; letters of both cases stand for the lower case.
W = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    """Tried on texts that hold keyword and also: every match of the pattern must contain both, so neither may hold a blank."""

    keyword: str
    pattern: str
    label: str
    priority: int
    weight: float
    also: str = ""


#: Families: label, keyword of the names that contain it as a word, names (patterns in lower case, words parted by one blank).
FAMILIES = (
    ("apache", "apache", ("apache license", "apache software license", "asl 2\\.0")),
    ("mit", "mit", ("mit license", "expat license", "x11 license")),
    ("bsd", "bsd", ("bsd license", "[234]-clause bsd", "bsd [234]-clause", "simplified bsd license", "new bsd license")),
    ("gpl", "gnu", ("gnu general public license", "gnu gpl", "gplv[123]", "gpl-[123]\\.0")),
    ("lgpl", "lesser", ("gnu lesser general public license", "lesser gpl", "lgpl(?:v[23])?")),
    ("agpl", "affero", ("gnu affero general public license", "affero gpl", "agpl(?:v3)?")),
    ("gfdl", "documentation", ("gnu free documentation license", "free documentation license")),
    ("mpl", "mozilla", ("mozilla public license", "mpl [12]\\.[01]")),
    ("epl", "eclipse", ("eclipse public license", "epl [12]\\.0")),
    ("cddl", "distribution", ("common development and distribution license",)),
    ("isc", "isc", ("isc license",)),
    ("zlib", "zlib", ("zlib license", "zlib/libpng license")),
    ("artistic", "artistic", ("artistic license", "perl artistic license")),
    ("boost", "boost", ("boost software license",)),
    ("unlicense", "unlicense", ("the unlicense", "unlicense")),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("ofl", "font", ("sil open font license", "open font license")),
    ("psf", "python", ("python software foundation license", "psf license")),
    ("ms-pl", "microsoft", ("microsoft public license", "microsoft reciprocal license")),
    ("eupl", "european", ("european union public license",)),
    ("odbl", "database", ("open database license", "odc-odbl")),
    ("pddl", "database", ("public domain dedication and license",)),
    ("ogl", "government", ("open government licen[cs]e",)),
    ("cc0", "cc0", ("cc0", "cc0 1\\.0 universal")),
    ("cc-by-nc-nd", "cc", ("cc by-nc-nd", "creative commons attribution-noncommercial-noderiv(?:ative)?s")),
    ("cc-by-nc-sa", "cc", ("cc by-nc-sa", "creative commons attribution-noncommercial-sharealike")),
    ("cc-by-nc", "cc", ("cc by-nc", "creative commons attribution-noncommercial")),
    ("cc-by-nd", "cc", ("cc by-nd", "creative commons attribution-noderiv(?:ative)?s")),
    ("cc-by-sa", "cc", ("cc by-sa", "creative commons attribution-sharealike")),
    ("cc-by", "cc", ("cc by", "creative commons attribution")),
)
#: Forms a name stands in: pattern around {name}, priority, weight.
FORMS = (
    ("licensed under (?:the )?(?:terms of )?(?:the )?{name}(?:,? version [0-9](?:\\.[0-9])*|,? v?[0-9](?:\\.[0-9])*)?", 1, 0.95),
    ("(?:released|distributed|published|available|redistributed) under (?:the )?(?:terms of )?(?:the )?{name}(?:,? (?:version |v)?[0-9](?:\\.[0-9])*)?", 1, 0.95),
    ("(?:subject to|governed by|covered by|under) (?:the )?(?:terms of )?(?:the )?{name}", 2, 0.9),
    ("{name},? (?:version |v)?[0-9](?:\\.[0-9])*", 3, 0.8),
    ("{name}", 5, 0.6),
)
#: Sentences of the licenses themselves and of rights statements: keyword, pattern, label, priority, weight, also.
SENTENCES = (
    ("permission", "permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 0, 1.0),
    ("permission", "permission to use, copy, modify, and(?:/or)? distribute this software", "isc", 0, 1.0),
    ("redistribution", "redistribution and use in source and binary forms", "bsd", 0, 1.0),
    ("warranty", "without warranty of any kind", "no-warranty", 4, 0.7),
    ("warranties", "without warranties or conditions of any kind", "no-warranty", 4, 0.7),
    ("provided", "provided \"?as is\"?", "no-warranty", 4, 0.6),
    ("domain", "(?:released into|placed in|dedicated to) the public domain", "public-domain", 1, 0.9, "public"),
    ("domain", "public domain", "public-domain", 5, 0.5, "public"),
    ("reserved", "all rights reserved", "reserved", 2, 0.9),
    ("reserved", "some rights reserved", "some-reserved", 2, 0.8),
    ("copyright", "copyright (?:\\(c\\)|©)? ?[12][0-9]{3}(?:[-–][12][0-9]{3})?", "copyright", 3, 0.7),
    ("copyright", "copyright", "copyright", 6, 0.4),
    ("©", "© ?[12][0-9]{3}", "copyright", 3, 0.6),
    ("proprietary", "proprietary and confidential", "proprietary", 1, 0.9),
    ("confidential", "confidential and proprietary", "proprietary", 1, 0.9),
    ("unauthorized", "unauthorized (?:copying|use|reproduction|distribution)", "proprietary", 2, 0.8),
    ("prohibited", "(?:copying|reproduction|redistribution|distribution) (?:is|are) (?:strictly )?prohibited", "proprietary", 2, 0.8),
    ("consent", "without (?:the )?(?:prior )?(?:written )?consent of", "permission-needed", 3, 0.7, "without"),
    ("permission", "without (?:the )?(?:prior )?(?:express )?(?:written )?permission", "permission-needed", 3, 0.7, "without"),
    ("permission", "used (?:by|with) permission", "permission-given", 3, 0.7, "used"),
    ("commercial", "for (?:non-commercial|noncommercial) (?:use|purposes) only", "non-commercial", 2, 0.8),
    ("commercial", "not for commercial (?:use|purposes)", "non-commercial", 2, 0.8),
    ("commercial", "(?:non-commercial|noncommercial) use only", "non-commercial", 2, 0.8),
    ("personal", "for personal use only", "personal-use", 2, 0.8),
    ("research", "for research (?:use|purposes) only", "research-only", 2, 0.8),
    ("evaluation", "for evaluation (?:use|purposes) only", "evaluation-only", 2, 0.8),
    ("educational", "for educational (?:use|purposes) only", "educational-only", 2, 0.8),
    ("resale", "not for resale", "no-resale", 3, 0.6),
    ("redistribute", "you may (?:not )?(?:copy|use|modify)(?: and|,? or)? redistribute", "redistribution", 3, 0.6),
    ("redistribute", "permission to (?:copy|use) and redistribute", "redistribution", 3, 0.7, "permission"),
    ("attribution", "(?:with|requires?) (?:proper )?attribution", "attribution", 4, 0.5),
    ("credit", "as long as (?:proper )?credit is given", "attribution", 4, 0.5),
    ("liable", "in no event shall (?:the )?[a-z ]{3,60} be (?:held )?liable", "no-liability", 4, 0.7, "event"),
    ("liability", "limitation of liability", "no-liability", 5, 0.5),
    ("merchantability", "implied warranties of merchantability", "no-warranty", 4, 0.7, "warranties"),
    ("merchantability", "warranty of merchantability", "no-warranty", 4, 0.7),
    ("endorse", "may not be used to endorse or promote products", "bsd", 1, 0.9, "promote"),
    ("sublicense", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies", "mit", 0, 1.0),
    ("notice", "the above copyright notice and this permission notice shall be included", "mit", 0, 0.9, "copyright"),
    ("notice", "retain the above copyright notice", "bsd", 1, 0.9, "copyright"),
    ("foundation", "published by the free software foundation", "gpl", 1, 0.9),
    ("later", "either version [0-9](?:\\.[0-9])? of the license, or \\(?at your option\\)? any later version", "gpl", 0, 0.95, "license"),
    ("useful", "distributed in the hope that it will be useful", "gpl", 2, 0.8, "hope"),
    ("misrepresented", "the origin of this software must not be misrepresented", "zlib", 0, 1.0, "origin"),
    ("fee", "for any purpose with or without fee", "isc", 1, 0.9, "purpose"),
    ("boost", "distributed under the boost software license", "boost", 0, 1.0),
    ("unencumbered", "this is free and unencumbered software", "unlicense", 0, 1.0, "software"),
    ("patent", "grants? (?:to )?you a [a-z, -]{0,60}patent license", "patent-grant", 2, 0.8, "license"),
    ("contributor", "subject to the terms and conditions of this license, each contributor", "apache", 0, 1.0, "license"),
    ("trademark", "(?:is|are) (?:a )?(?:registered )?trademarks? of", "trademark", 4, 0.5),
    ("open-source", "open-source license", "open-source", 5, 0.5),
    ("domain", "domaine public", "public-domain", 5, 0.5, "public"),
    ("gemeinfrei", "gemeinfrei(?:es|e|en)?", "public-domain", 4, 0.6),
    ("dominio", "dominio público", "public-domain", 5, 0.5),
    ("rechte", "alle rechte vorbehalten", "reserved", 2, 0.9, "vorbehalten"),
    ("droits", "tous droits réservés", "reserved", 2, 0.9, "tous"),
    ("derechos", "todos los derechos reservados", "reserved", 2, 0.9, "reservados"),
    ("lizenziert", "lizenziert unter (?:der |einer )?", "license-notice", 3, 0.6),
    ("lizenz", "unter (?:der|einer) [a-z0-9 .-]{2,40}lizenz", "license-notice", 3, 0.7, "unter"),
    ("licence", "sous (?:la )?licence", "license-notice", 3, 0.6, "sous"),
    ("licencia", "bajo (?:la )?licencia", "license-notice", 3, 0.6, "bajo"),
    ("kommerziell", "nur (?:für|zur) (?:den )?(?:nicht-?kommerziellen) (?:gebrauch|nutzung)", "non-commercial", 2, 0.8, "nur"),
    ("gebrauch", "nur für den privaten gebrauch", "personal-use", 2, 0.8, "privaten"),
    ("commerciale", "(?:pas d'|aucune )utilisation commerciale", "non-commercial", 2, 0.8, "utilisation"),
    ("comercial", "(?:sin|no para) (?:uso|fines) comercial(?:es)?", "non-commercial", 2, 0.8),
    ("genehmigung", "ohne (?:vorherige )?(?:schriftliche )?genehmigung", "permission-needed", 3, 0.7, "ohne"),
    ("autorisation", "sans (?:l')?autorisation", "permission-needed", 3, 0.7, "sans"),
    ("autorización", "sin (?:la )?(?:previa )?autorización", "permission-needed", 3, 0.7, "sin"),
    ("gewähr", "ohne (?:jede |jegliche )?gewähr", "no-warranty", 4, 0.6, "ohne"),
    ("garantie", "sans (?:aucune )?garantie", "no-warranty", 4, 0.6, "sans"),
    ("garantía", "sin (?:ninguna )?garantía", "no-warranty", 4, 0.6, "sin"),
    ("namensnennung", "namensnennung", "cc-by", 3, 0.7),
    ("paternité", "paternité", "cc-by", 3, 0.6),
    ("reconocimiento", "(?:creative commons )?reconocimiento [0-9]\\.[0-9]", "cc-by", 3, 0.7),
    ("compliance", "you may not use this (?:file|work) except in compliance with the license", "license-notice", 2, 0.8, "license"),
    ("obtain", "you may obtain a copy of the license at", "license-notice", 2, 0.8, "license"),
    ("specific", "see the license for the specific language", "license-notice", 2, 0.7, "license"),
)
#: A text without any of these, in lower case, has no base phrase.
BASE_CUES = ("cc", "license", "reserved")


def keyword(name: str, key: str) -> str:
    """A word that every match of the name contains: the family's where the name has it, else its longest one."""
    fixed = re.findall("[a-z0-9]+", re.sub(r"\(\?:[^)]*\)\??|\[[^]]*\]|\\.", " ", name))
    return key if key in fixed else max((w for w in fixed if w != "license"), key=len)


def rules() -> list[Rule]:
    """The ordered table, built from families and forms: each name in each form, an identifier tag for each family, then the sentences."""
    table = [Rule("spdx", f"spdx-license-identifier: ?{label}[a-z0-9.+-]*", label, 0, 1.0) for label, _, _ in FAMILIES]
    for form, priority, weight in FORMS:
        cue = next((c for c in ("licensed", " under ", "[0-9]") if c in form), "")
        for label, key, names in FAMILIES:
            for name in names:
                also = cue.strip() if cue and "[" not in cue else "license" if "license" in name else ""
                table.append(Rule(keyword(name, key), form.format(name=name), label, priority, weight, also))
    table += [Rule(*s) for s in SENTENCES]
    spaced = [r._replace(pattern=f"(?<![a-z0-9])(?:{r.pattern.replace(' ', '[\\s-]+')})(?![a-z0-9])") for r in table]
    return sorted(spaced, key=lambda r: r.priority)


def cues(table: list[Rule]) -> tuple[str, ...]:
    """A text without any of these, in lower case, meets no rule: one of the two words that each rule needs."""
    return tuple(sorted({r.also if "licen" in r.also else r.keyword for r in table}))


def _rule_array(table: list[Rule]) -> Column:
    """All rules by their keywords as one literal array of structs, folded at planning."""
    groups: dict[str, list[dict]] = {}
    for r in table:
        groups.setdefault(r.keyword, []).append(r._asdict())
    rule = "struct<pattern:string,label:string,priority:int,weight:double,also:string>"
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": g} for k, g in groups.items()])), f"array<struct<keyword:string,rules:array<{rule}>>>")


def _places(text: Column, r: Column) -> Column:
    """Intervals of one rule in text."""
    spot = lambda x, start, _: F.struct(start.alias("s"), (-start - F.length(x)).alias("neg_e"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))
    return F.coalesce(places(text, r["pattern"], spot), F.expr("cast(array() as array<struct<s:int,neg_e:int,priority:int,label:string,weight:double>>)"))


def _kept(found: Column, priorities: list[int]) -> Column:
    """Suppress: an interval falls if it lies within another one of the same or a higher priority (equal ones: all but the first by label).

    In order of start, longest first, an interval lies within an earlier one if that ends no sooner; the furthest end so far of
    each priority and those above it tells.
    """

    def stand(own: Column) -> Column:
        reach = lambda p: running(F.transform(own, lambda x: F.when(x["priority"] <= p, -x["neg_e"]).otherwise(-1)), F.greatest)

        def filtered(all_of: Column) -> Column:
            before = lambda x, i: F.coalesce(F.get(F.get(all_of, F.array_position(F.array(*map(F.lit, priorities)), x["priority"]).cast("int") - 1), i - 1), F.lit(-1))
            return F.filter(own, lambda x, i: before(x, i) < -x["neg_e"])

        return F.when(F.size(own) > 1, let(F.array(*map(reach, priorities)), filtered)).otherwise(own)

    return F.transform(let(F.sort_array(found), stand), lambda x: F.struct(x["label"].alias("label"), x["weight"].alias("weight"), x["s"].alias("s"), (-x["neg_e"]).alias("e")))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    """Plain searches for fixed strings: some 20 times as fast as a pattern of alternatives."""
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def detections(text: Column, low: Column, table: list[Rule] | None = None) -> Column:
    """Detections that stand, as an array of (label, weight, s, e): code points, end exclusive. null where the text has no cue. low: text in lower case."""
    table = table or rules()
    groups = _rule_array(table)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def scan(plain: Column) -> Column:
        near = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(plain, g["keyword"])), lambda g: g["rules"]))
        tried = F.filter(near, lambda r: F.contains(plain, r["also"]))
        return _kept(F.flatten(F.transform(tried, lambda r: _places(plain, r))), sorted({r.priority for r in table}))

    return F.when(_any(low, cues(table)), let(F.translate(text, upper, lower), scan))


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for each row of docs."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("low", F.lower("text"))
    phrases = {p: GAP.join(f"(?i:{w})" for w in p.split()) for p in PHRASES}
    any_phrase = f"(?<!{W})(?:{'|'.join(phrases.values())})(?!{W})"
    words = lambda c: F.size(F.array_remove(F.split(c, GAP, -1), "")).cast("bigint")
    may = _any(F.col("low"), BASE_CUES)
    own = own.select(
        "doc_id",
        words(F.col("text")).alias("n_words"),
        F.when(may, F.split("text", any_phrase, -1)).alias("parts"),
        F.when(may, F.regexp_extract_all("text", F.lit(any_phrase), F.lit(0))).alias("hits"),
        detections(F.col("text"), F.col("low"), table).alias("found"),
    )
    none = F.expr("cast(array() as array<string>)")
    label = lambda x: F.when(x.rlike("^(?i:cc)"), PHRASES["cc by"]).when(x.rlike("^(?i:general)"), PHRASES["general public license"]).otherwise(PHRASES["all rights reserved"])
    own = own.select("*", F.coalesce(F.size("hits"), F.lit(0)).alias("n"), F.array_sort(F.coalesce(F.array_distinct(F.transform("hits", label)), none)).alias("base"))
    some = F.col("n") > 0
    best = F.aggregate(F.transform("found", lambda x: x["weight"]), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return own.select(
        "doc_id",
        "n_words",
        F.greatest(F.col("n"), F.lit(0)).cast("bigint").alias("n_base"),
        F.when(some, words(F.get("parts", F.lit(0)))).alias("first_word"),
        F.when(some, F.col("n_words") - words(F.element_at("parts", -1)) - words(F.element_at("hits", -1))).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce(F.transform("found", lambda x: x["label"]), none))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(some, 0.7).otherwise(0.0)).alias("score"),
        F.coalesce("found", F.expr("cast(array() as array<struct<label:string,weight:double,s:int,e:int>>)")).alias("detections"),
    )
