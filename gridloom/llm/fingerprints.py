"""Document fingerprints by winnowing.

A text is read as units: words with the white space before them, cut every PIECE code points, and the letters of scripts that are
written without spaces one by one. The hash of a run of K units is a polynomial of the units' hashes modulo a prime, which rolls over
the text unit by unit. Of each window of W consecutive hashes the smallest is selected, of equal ones the rightmost; windows that
the text's ends cut off count as well. Hash and position (the number of the run's first unit) of what is selected are the
fingerprint. Units begin anew behind white space, so whatever two texts share over GUARANTEE units behind a space has a selected hash in
both, the same one: matches of that length are found, at their places, and what is shorter than K units is noise.

All steps are built-in functions over arrays: some 100 bytes a unit while a text is read. A document meets the one that follows it in
order of doc_id by one shuffle: rows go to ranges of ids, each range gets its successor's first rows as well, and a window in the
range looks ahead.

Defined cases: null texts are empty; an empty text has an empty fingerprint; a text of fewer than K units has one hash, that of its units after as
many empty ones as lack; the likeness of two fingerprints is 2 * shared / (own + other's) over distinct hashes, 1 if both are
empty; documents stand in order of doc_id, null first, equal ids by a hash of the text and the text; one document is its own
successor; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import let

#: Units in a hash, hashes in a window (4 * 2: two passes), and what two texts must share for a match to be certain.
K, W = 5, 8
GUARANTEE = K + W - 1
#: Code points of the longest unit.
PIECE = 8
#: Scripts without spaces between words: Thai and Lao, Myanmar, Khmer, Chinese and Japanese.
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u31A0-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT = rf"\s*+[^\s{_ALONE}]{{1,{PIECE}}}+|\s*+[{_ALONE}]|\s++"
#: The polynomial's prime and base: five products of a unit's 30 bits with a coefficient stay below 63 bits.
PRIME, BASE = 1_073_741_789, 486_187_739
#: A selected hash and its position in one number, which orders by hash and then by position from the right.
_PLACES = 1 << 31
_NONE = "cast(array() as array<bigint>)"
#: Ranges of ids for each shuffle partition.
RANGES = 8


def _rolled(units: Column) -> Column:
    """hash * 2^31 - position of each run of K units, null at the last K - 1 places."""
    powers = [pow(BASE, K - 1 - j, PRIME) for j in range(K)]
    own = F.transform(units, lambda u: F.xxhash64(u).bitwiseAND(2**30 - 1))

    def roll(a: Column) -> Column:
        run = lambda x, i: sum((F.get(a, i + j) * powers[j] for j in range(1, K)), x * powers[0])
        return F.transform(a, lambda x, i: run(x, i) % PRIME * F.lit(_PLACES) - i)

    return let(own, roll)


def _least(a: Column) -> Column:
    """The smallest of each W places from the place on; nulls don't count."""
    four = F.transform(a, lambda x, i: F.least(x, F.get(a, i + 1), F.get(a, i + 2), F.get(a, i + 3)))
    return let(four, lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + 4))))


def fingerprint(text: Column) -> Column:
    """The selected hashes of a text (not null), as hash * 2^31 - position, in the windows' order."""

    def select(units: Column) -> Column:
        lacking = F.greatest(F.lit(K) - F.size(units), F.lit(0))
        hashes = let(F.concat(F.array_repeat(F.lit(""), lacking), units), _rolled)
        padded = F.concat(F.array_repeat(F.lit(None).cast("long"), W - 1), hashes)
        windows = F.size(units) + lacking - (K - 1) + (W - 1)
        return F.when(F.size(units) > 0, F.array_distinct(F.slice(let(padded, _least), 1, windows))).otherwise(F.expr(_NONE))

    return let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), select)


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed + (_PLACES - 1), 31)


def positions(fingerprint: Column) -> Column:
    """array<struct<hash, position>> of a fingerprint."""
    return F.transform(fingerprint, lambda x: F.struct(hash_of(x).alias("hash"), (hash_of(x) * F.lit(_PLACES) - x).alias("position")))


def shown(fingerprint: Column) -> Column:
    """hash:position in order, comma-joined; the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit(":"), hash_of(x) * F.lit(_PLACES) - x)), ",")


def likeness(a: Column, b: Column) -> Column:
    """2 * shared / (own + other's) over the distinct hashes of two fingerprints; 1 if both are empty."""
    sets = lambda x, y: 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    distinct = lambda x: F.array_distinct(F.transform(x, hash_of))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(distinct(a), lambda x: let(distinct(b), lambda y: sets(x, y))))


def _ranged(docs: DataFrame) -> DataFrame:
    """doc_id, text, place, range, guest: rows in ranges of the order by doc_id, each range with its successor's first rows as guests.

    The ranges' edges are the rows next to quantiles of the order, one for each range: they, and nothing else, go through the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"))
    # the hash keeps rows apart that share an id, or have none
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(2**32).cast("decimal(11,0)") + F.hash("text").cast("decimal(11,0)")
    own = own.withColumn("place", place.cast("decimal(38,0)"))
    count = RANGES * parts
    asked = F.array(*[F.lit(k / count) for k in range(count)])
    listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<decimal(38,0)>")

    def ranged(edges: list) -> DataFrame:
        wide = math.isqrt(len(edges)) + 1
        upto = lambda a: F.greatest(F.size(F.filter(a, lambda e: e <= F.col("place"))), F.lit(1))
        rows = own.withColumn("coarse", (upto(listed(edges[::wide])) - 1) * wide)
        return rows.withColumn("range", F.col("coarse") + upto(F.slice(listed(edges), F.col("coarse") + 1, wide)) - 1)

    # the quantiles are rounded; a range's true edge is its first row
    about = own.agg(F.percentile_approx("place", asked, max(10_000, 20 * count)).alias("edges")).first()["edges"] or [0]
    edges = [r["edge"] for r in ranged(sorted(set(about))).groupBy("range").agg(F.min("place").alias("edge")).orderBy("edge").collect()] or [0]
    own = ranged(edges)
    opens = F.col("place") == F.get(listed(edges), F.col("range"))
    before = F.pmod(F.col("range") - 1, F.lit(len(edges)))
    seats = F.when(opens, F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))
    return own.select("doc_id", "text", "place", F.explode(seats).alias("seat")).select("doc_id", "text", "place", "seat.*").repartition(parts, "range")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text, fingerprint, edited_fingerprint, near_edited, near_next; fingerprints as of fingerprint().

    A document's edited text is its own with the last quarter, rounded down, replaced by as much of the beginning of the one that
    follows (all, if that is shorter).
    """
    rows = _ranged(docs).withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", "place", "text")
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).filter("not guest")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    changed = F.concat(F.left("text", F.char_length("text") - quarter), F.left("next", quarter))
    rows = rows.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint", changed.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def report(docs: DataFrame) -> DataFrame:
    """edited() with the edited text's digest in its place and fingerprints as strings."""
    return edited(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
