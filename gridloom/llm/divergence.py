"""Source divergence audit: how far the word use of sources of one language lies apart, and which terms set a source off.

Terms are counted for each (lang, source) inside the tasks, so one row a term, group and some 64 MB of text is shuffled. The postings
(lang, source, term, count) of the terms that at least MIN_DOCS documents of the language hold are written to the shared folder; the
rest works on them.

Pairs come from the postings: a term that neither of two sources has adds the same to their divergence wherever it stands, so
the sum over all terms is V times that, a correction for each source's own terms (taken once for each probability, by a
histogram), and one for the terms that both have, by a join of the postings with themselves on the term.

Terms are searched by upper bounds: each group's postings fall into buckets by count, and a bucket's largest probability in the
group and smallest in the language bound the divergence of what it holds. Buckets are evaluated best first, in waves of 4, 8, 16, ...,
until every bucket that a group hasn't seen is strictly below its k-th value.

Probabilities are p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)) and divergences f = floor((p - q)^2 / (p + q)), both in integers.

Defined cases: null text, lang and source are ''; repeated rows are documents of their own; a group without terms has N = 0 and takes part
in pairs; with V = 0 all pairs are 0 and there are no terms; ties stand in the byte order of the item; a language with one source has no
pairs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, discard, written

MIN_DOCS = 10
TOP = 10
#: Text of one task, in bytes, whose counts are held before they are handed on, and how many counts.
HELD_BYTES, HELD_TERMS = 64 << 20, 400_000
#: Counts below this have a bucket of their own, above it an octave has eight.
PLAIN = 32
#: Buckets of a group in the first wave; each wave takes twice as many.
FIRST_WAVE = 4

#: ASCII: letters in lower case, all else a space. Bytes from 0x80 stay: they are parts of letters of the term.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, added up within the task."""
    found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    seen = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for k in range(0, len(terms), 50_000):
                own = terms[k : k + 50_000]
                same = lambda x, own=own: pa.array([x], pa.binary()).cast(pa.string()).take(pa.array([0] * len(own)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = text.translate(_LETTERS).split()
            if not words:
                continue
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
            seen += len(text)
        if seen > HELD_BYTES or sum(len(n) for n, _ in found.values()) > HELD_TERMS:
            yield from out()
            found.clear()
            seen = 0
    yield from out()


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, n_lang: occurrences in the group and in the language, of the kept terms."""
    bounded_batches(docs.sparkSession)
    counts = _own(docs).mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return counts.withColumns({"n_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term)}).filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang")


def probability(n: Column, total: Column, terms: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, terms, absent: a row for each group; absent is the probability of a term that it lacks."""
    groups = _own(docs).select("lang", "source").distinct()
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = posts.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    rows = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    return rows.withColumn("absent", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1))


def pairs(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each two sources of a language over all its kept terms. posts: with p and absent."""
    f = divergence
    sides = groups.select("lang", "source", "absent", "terms")
    other = sides.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"))
    every = sides.join(other, "lang").filter("source <> item").select("lang", "source", "item", (f(F.col("absent"), F.col("other")) * F.col("terms")).alias("value"))
    alike = posts.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("m"))
    single = alike.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("m") * (f(F.col("p"), F.col("other")) - f(F.col("absent"), F.col("other")))).alias("value"))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a = posts.select("lang", "term", "source", "p", "absent")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("other"))
    p, q, p0, q0 = F.col("p"), F.col("q"), F.col("absent"), F.col("other")
    shared = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("value"))
    mirrored = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = every.unionByName(single).unionByName(mirrored(single)).unionByName(shared).unionByName(mirrored(shared))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def bucketed(posts: DataFrame) -> DataFrame:
    """posts with a bucket by count."""
    return posts.withColumn("bucket", F.when(F.col("n") < PLAIN, F.col("n")).otherwise(F.floor(8 * F.log2("n"))).cast("int"))


def bounds(posts: DataFrame) -> DataFrame:
    """lang, source, bucket, bound, turn: what f can reach in a group's bucket; turn is its place by bound. Buckets where no p exceeds its q are left out."""
    rows = posts.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "bucket", divergence(F.col("p"), F.col("q")).alias("bound"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")))


def top_terms(posts: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the k terms of each group with the largest divergence among those more likely in it than in the language.

    posts: with p, q and bucket. The tables of the waves are deleted, the last one stays.
    """
    spark = posts.sparkSession
    turns, turns_path = written(bounds(posts), "term-bounds")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    schema = "lang string, source string, item string, value bigint, rank int"
    best, path = spark.createDataFrame([], schema), None
    seen, wide = 0, FIRST_WAVE
    while True:
        kth = best.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        unseen = turns.filter(F.col("turn") > seen).join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth")
        if path is not None and unseen.isEmpty():
            break
        wave = unseen.filter(F.col("turn") <= seen + wide).select("lang", "source", "bucket")
        new = posts.filter("p > q").join(wave, ["lang", "source", "bucket"]).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        merged = best.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best, after = written(merged, "top-terms")
        if path is not None:
            discard(spark, path)
        path, seen, wide = after, seen + wide, 2 * wide
    discard(spark, turns_path)
    return best


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and each group's top terms."""
    found, _ = written(postings(docs, min_docs), "postings")
    groups, _ = written(_groups(docs, found), "groups")
    p = probability(F.col("n"), F.col("total"), F.col("terms"))
    q = probability(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    posts = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "absent")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = pairs(posts, groups).withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = top_terms(bucketed(posts), top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return apart.unionByName(terms)


#: The audit in DuckDB SQL, from the rules: every term with every group, no bounds and no postings.
SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
 o as (select id, lang, source, unnest(words) as term from d),
 kept as (select lang, term, count(*) as n_lang from o group by all having count(distinct id) >= 10),
 c as (select lang, source, term, count(*) as n from o semi join kept using (lang, term) group by all),
 langs as (select lang, count(*) as v, sum(n_lang) as n_lang from kept group by lang),
 g as (select lang, source, coalesce(any_value(v), 0) as v, any_value(langs.n_lang) as total_lang, coalesce(sum(c.n), 0) as total
  from (select distinct lang, source from d) left join langs using (lang) left join c using (lang, source) group by all),
 x as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) as p, 1 + (1000000000::hugeint * (n_lang + 2)) // (total_lang + 2 * v) as q
  from g join kept using (lang) left join c using (lang, source, term)),
 f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from x where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r qualify part = 'pair' or rank <= 10
"""
