"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from wide patterns. Three labelers vote on each: a check of its structure (regex), a gazetteer of domains,
calling codes, given names, street words and the like, and the words in front of it (context). Expectation maximisation over
the counts of vote patterns, of the whole corpus, estimates how reliable each labeler is for each kind, and its posteriors
train the final classifier, a logistic regression over votes and length for each kind. Base kinds always stay; the classifier
decides the rest: a pair of capitalised words, say, is a candidate for a name, and few of them are one.

The texts are scanned by projections without shuffle; one aggregation gives a row for each vote pattern (at most KINDS x 32
rows), which is all the driver sees. EM and the regression run over these rows.

Defined cases: null and empty texts have no spans; equal rows each give a row; null doc_ids stay; without any candidate the
classifier keeps nothing besides the base spans. Time grows as n log n with the hits of a text and in proportion to its
length, memory with both: some 300 bytes a hit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks_of, cut, let, places, running, written

SPAN = "struct<kind:string,s:int,e:int,r:int,g:int,c:int,b:int>"


class Kind(NamedTuple):
    """pattern: candidates, leftmost and non-overlapping; gate: a text without any of these characters has none; base: spans that pass stay always."""

    name: str
    pattern: str
    gate: str
    base: bool
    known: str  # the gazetteer's yes
    context: str  # words in front of a span
    prior: float = 0.5  # share of true candidates that EM starts from


#: A run of characters is tried from its start, or from the end of the last match, alone: no second start can succeed.
_LOCAL = "A-Za-z0-9._%+-"
_DIGITS = "0123456789"
_NO_LETTER = "(?![\\p{L}\\p{N}])"
_NAME = "\\p{Lu}\\p{Ll}++"
#: Given names of the four languages.
GIVEN = (
    "Anna|Andrea|Andreas|Antonio|Barbara|Carlos|Carmen|Charles|Christian|Christine|Claire|Daniel|David|Elena|Elizabeth|Emma|Eva|Francisco|"
    "Frank|George|Hans|Hélène|Isabel|James|Javier|Jean|Jennifer|Johannes|John|José|Juan|Julia|Karl|Klaus|Laura|Linda|Louis|Lucía|Luis|Manuel|"
    "Marc|Maria|María|Marie|Mark|Martin|Mary|Michael|Miguel|Nathalie|Nicolas|Pablo|Patricia|Paul|Peter|Philippe|Pierre|Robert|Sabine|Sarah|"
    "Sofia|Sophie|Stefan|Susan|Susanne|Thomas|Ursula|William|Wolfgang"
)
#: The kinds in the order of the results, with patterns, gazetteers and context words.
KINDS = (
    Kind("email", f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", True, "(?i)\\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", "(?i)mail|contact|write|kontakt|courriel|correo", 0.95),
    Kind("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", ".", True, "^(?!0|127\\.|255\\.)", "(?i)\\bip\\b|addr|host|server|from|login", 0.9),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", _DIGITS, True, "^(4|5[1-5]|2[2-7]|3[47]|6011|65)", "(?i)card|visa|master|pay|karte|carte|tarjeta", 0.9),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "+", True, "^\\+(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])", "(?i)tel|phone|call|fax|mobil|anruf|appel|llam", 0.9),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}(?![A-Za-z0-9])", _DIGITS, False, "^(AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MD|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)", "(?i)iban|account|bank|konto|compte|cuenta"),
    Kind("secret", "(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\\x20]?[=:][\\x20]?\"?[A-Za-z0-9+/_.-]{8,}\"?", "=:", False, "[0-9a-f]{16,}", "(?i)login|user|auth|config|export|set", 0.8),
    Kind("local_phone", "(?<![0-9A-Za-z+().-])(?<!\\+[0-9]{1,3}\\x20)\\([0-9]{3}\\)[\\x20]?[0-9]{3}[.-][0-9]{4}(?![0-9])", "(", False, "^\\([2-9]", "(?i)tel|phone|call|fax|mobil", 0.7),
    Kind("name", f"(?<![\\p{{L}}\\p{{N}}]){_NAME}(?:\\x20{_NAME}){{1,2}}{_NO_LETTER}", "", False, f"^(?:{GIVEN})\\x20", "(?i)(?:(?<!\\p{L})(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|mme|señora?|sra?|doña?)\\.?|names?(?: is|:)?|named|heißt|appelle|llamo|regards,?|signed(?: by)?|contact:?)\\s*$", 0.02),
    Kind("address", f"(?<![\\p{{L}}\\p{{N}}])(?:[0-9]{{1,5}},?\\x20{_NAME}(?:\\x20{_NAME}){{0,2}}|{_NAME}(?:\\x20{_NAME})?\\x20[0-9]{{1,4}}[a-z]?|(?i:rue|avenue|calle|avenida|plaza)\\x20(?:del?\\x20(?:la\\x20)?|du\\x20|des\\x20)?{_NAME},?\\x20[0-9]{{1,4}}){_NO_LETTER}", _DIGITS, False, "(?i)(?:street|st|road|rd|avenue|ave|lane|drive|boulevard|blvd|straße|strasse|weg|platz|gasse|allee)(?!\\p{L})|^(?:rue|calle|avenida|plaza)\\x20", "(?i)(?:address|adresse|lives?(?: at)?|located at|anschrift|wohnt|habite|dirección|domicilio|vive en|ship to)[^.\\n]{0,12}$", 0.05),
    Kind("birth_date", "(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])", _DIGITS, False, "(?<![0-9])(?:19[2-9][0-9]|20[01][0-9])(?![0-9])", "(?i)(?:born|birth|dob|geboren|geburtsdatum|geb\\.|née?|naissance|nacid[oa]|nacimiento)[^.\\n]{0,12}$", 0.05),
)
#: Characters in front of a span that the context labeler reads.
BEFORE = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of at most 20 digits is right."""
    d = F.lpad(digits, 20, "0")
    twice = F.translate(d, "0123456789", "0246813579")
    total = sum((F.substring(d if k % 2 == 0 else twice, k, 1).cast("int") for k in range(2, 21)), F.substring(twice, 1, 1).cast("int"))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The check digits of an IBAN are right: its country and check digits go to the end, letters count from 10."""
    own = F.split(F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4))), "")
    value = lambda a, x: F.when(x == "", a).when(x.between("0", "9"), a * 10 + F.ascii(x) - 48).otherwise(a * 100 + F.ascii(x) - 55) % 97
    return F.aggregate(own, F.lit(0), value) == 1


def _passes(kind: str, m: Column, before: Column) -> Column:
    """The structural check; for a base kind it is the rule that the kind is defined by."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(13, 19) & luhn(F.substring(d, 1, 20)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    if kind == "name":  # a sentence's first word is written large anyway
        return ~F.right(before, F.lit(4)).rlike("(?:^|[.!?:\"|]|\n)\\s*$")
    if kind == "address":
        return ~m.rlike("(?<![0-9])(?:0|(?:19|20)[0-9]{2}(?![0-9]))")
    if kind == "birth_date":
        return m.rlike("^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]|-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$")
    return F.lit(True)


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def _spans(text: Column, k: Kind) -> Column:
    """Candidates of one kind with their votes."""

    def span(x: Column, start: Column, before: Column) -> Column:
        vote = lambda yes: F.when(yes, 1).otherwise(0)
        return F.struct(
            F.lit(k.name).alias("kind"),
            start.alias("s"),
            (start + F.length(x)).alias("e"),
            F.when(_passes(k.name, x, before), 1).otherwise(-1).alias("r"),
            vote(x.rlike(k.known)).alias("g"),
            vote(F.right(before, F.lit(BEFORE)).rlike(k.context)).alias("c"),
            F.least(F.lit(3), (F.length(x) / 12).cast("int")).alias("b"),
        )

    found = places(text, k.pattern, span)
    if k.base:
        found = F.filter(found, lambda x: x["r"] > 0)
    found = F.coalesce(found, _none())
    if not k.gate:
        return found
    some = F.contains(text, F.lit(k.gate[0]))
    for c in k.gate[1:]:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, found).otherwise(_none())


def all_spans(text: Column) -> Column:
    """All candidates of a text by kind, then start."""
    return F.concat(*[_spans(text, k) for k in KINDS])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), all_spans(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("spans"))


class Model(NamedTuple):
    """weights of the final classifier by kind and feature; reliability: P(vote | truth) by kind and labeler; prior: share of true candidates by kind."""

    weights: dict[tuple[str, str], float]
    reliability: dict[tuple[str, str, int, int], float]
    prior: dict[str, float]


#: What EM starts from: P(vote of yes | true), P(vote of yes | false) of the labelers.
START = {"r": (0.9, 0.5), "g": (0.6, 0.1), "c": (0.5, 0.05)}
#: Weight of the start against the counts of a kind: it keeps the two truths from changing places.
ANCHOR = 0.2


def fit(spans: DataFrame, rounds: int = 30, steps: int = 600) -> Model:
    """EM over the counts of vote patterns, then the classifier over the posteriors."""
    seen = spans.select(F.explode("spans").alias("x")).select("x.kind", "x.r", "x.g", "x.c", "x.b").groupBy("kind", "r", "g", "c", "b").count()
    rows = sorted((tuple(x) for x in seen.collect()), key=str)  # one row for each pattern: a bounded number
    weights: dict[tuple[str, str], float] = {}
    table: dict[tuple[str, str, int, int], float] = {}
    prior: dict[str, float] = {}
    for kind in KINDS:
        own = [x for x in rows if x[0] == kind.name]
        if not own:
            continue
        votes = np.array([[x[1] > 0, x[2] > 0, x[3] > 0] for x in own])
        n = np.array([x[5] for x in own], float)
        start = np.array([START[k] for k in "rgc"])
        yes, share, anchor = start.copy(), kind.prior, ANCHOR * n.sum() + 1
        for _ in range(rounds):
            likely = [share_ * np.prod(np.where(votes, yes[:, t], 1 - yes[:, t]), axis=1) for t, share_ in ((0, share), (1, 1 - share))]
            post = likely[0] / (likely[0] + likely[1])
            share = (n @ post + anchor * kind.prior) / (n.sum() + anchor)
            for t, own_post in ((0, post), (1, 1 - post)):
                yes[:, t] = ((n * own_post) @ votes + anchor * start[:, t]) / (n @ own_post + anchor)
        prior[kind.name] = float(share)
        for k, name in enumerate("rgc"):
            for t, truth in ((0, 1), (1, 0)):
                table[kind.name, name, truth, 1], table[kind.name, name, truth, 0] = float(yes[k, t]), float(1 - yes[k, t])
        x = np.column_stack([np.ones(len(own)), votes, np.array([[y[4] == b for b in range(4)] for y in own])]).astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += 2.0 * (x.T @ ((post - p) * n / n.sum()) - 1e-4 * w)
        weights |= {(kind.name, f): float(v) for f, v in zip(("1", "r", "g", "c", "b0", "b1", "b2", "b3"), w, strict=True)}
    return Model(weights, table, prior)


def _accepted(x: Column, m: Model) -> Column:
    """The classifier's verdict as an expression over a span."""
    verdict = F.lit(False)
    for k in KINDS:
        w = lambda f, k=k: m.weights.get((k.name, f), -99.0 if f == "1" else 0.0)
        length = F.lit(w("b3"))
        for b in range(3):
            length = F.when(x["b"] == b, w(f"b{b}")).otherwise(length)
        yes = F.lit(True) if k.base else F.lit(w("1")) + length + F.when(x["r"] > 0, w("r")).otherwise(0.0) + w("g") * x["g"] + w("c") * x["c"] >= 0
        verdict = F.when(x["kind"] == k.name, yes).otherwise(verdict)
    return verdict


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: (kind, s, e, votes) of every text, code points, end exclusive, by kind, then start. Texts are scanned once: the candidates are kept in the shared folder."""
    found, _ = written(candidates(docs), "spans")
    model = fit(found)
    return found.withColumn("spans", F.filter("spans", lambda x: _accepted(x, model)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs."""
    base = [k.name for k in KINDS if k.base]
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return find(docs).select("doc_id", *map(of, base), F.sha2(_joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of overlapping spans the one that starts first stands, to the furthest end."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def apart(own: Column, reach: Column) -> Column:
        """The spans that start behind all before them, each with its place among all."""
        new = lambda x, i: F.when((i == 0) | (x["s"] >= F.get(reach, i - 1)), F.struct(x["s"].alias("s"), i.alias("i"), x["kind"].alias("kind")))
        return F.filter(F.transform(own, new), lambda x: x.isNotNull())

    def put(reach: Column, first: Column, blocks: Column) -> Column:
        pieces = F.transform(first, lambda x, j: F.concat(cut(blocks, F.when(j == 0, 0).otherwise(F.get(reach, x["i"] - 1)), x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), cut(blocks, F.element_at(reach, -1), F.length(text)))

    whole = let(
        ordered,
        lambda own: let(
            running(F.transform(own, lambda x: x["e"]), F.greatest),
            lambda reach: let(apart(own, reach), lambda first: let(blocks_of(text), lambda blocks: put(reach, first, blocks))),
        ),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """The rows of docs with placeholders for the spans in text, and n_chars (if there) to match; null texts stay null.

    Candidates are found twice, for the fit and for the rows: the second scan costs less than to write all texts.
    """
    model = fit(candidates(docs))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("text").cast("string").alias("text"))
    own = own.select("row", "text", F.filter(all_spans(F.coalesce("text", F.lit(""))), lambda x: _accepted(x, model)).alias("kept"))
    own = own.select("row", "text", "kept", masked(F.col("text"), F.col("kept")).alias("masked"))
    new = {c: F.col("row").getField(c) for c in docs.columns}
    new["text"] = F.col("masked").cast(docs.schema["text"].dataType)
    if "n_chars" in new:
        new["n_chars"] = F.when(F.size("kept") > 0, F.length("masked")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return own.select(*[v.alias(c) for c, v in new.items()])
