"""Candidate themes, theme scores, ranks and selection; conversation histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import padded, py_round
from gridloom.operators.ordered import running
from gridloom.operators.validate import coverage
from gridloom.shared import written


def candidates(extractions: DataFrame, diaries: DataFrame) -> DataFrame:
    """candidate_id, diary_id, date, label, description, quote, importance from extractions (diary_id, themes) and diaries (diary_id, date, text); a quote that its diary doesn't hold is an error."""
    own = extractions.select("diary_id", F.posexplode("themes").alias("at", "x")).select(padded(F.col("diary_id"), "-c", F.col("at")).alias("candidate_id"), "diary_id", "x.*")
    own = own.join(diaries.select("diary_id", "date", "text"), "diary_id").withColumn("_lost", ~F.contains("text", F.col("quote")))
    own = written(own.select("candidate_id", "diary_id", "date", "label", "description", "quote", "importance", "_lost"), "candidates")  # the texts are met once
    bad = own.filter("_lost").orderBy("candidate_id").limit(1).collect()
    if bad:
        raise ValueError(f"extracted quote not found in {bad[0]['diary_id']}: {bad[0]['quote']!r}")
    return own.drop("_lost")


def canonical(synthesis: DataFrame) -> DataFrame:
    """theme_id, title, description, candidate_ids from one row of themes, numbered by position."""
    return synthesis.select(F.posexplode("themes").alias("at", "x")).select(padded(F.lit("theme"), "_", F.col("at")).alias("theme_id"), "x.title", "x.description", "x.candidate_ids")


def members(themes: DataFrame, found: DataFrame) -> DataFrame:
    """theme_id, candidate_id, source_id, importance: each theme with the candidates it lists; an unknown id is an error."""
    listed = themes.select("theme_id", F.explode("candidate_ids").alias("candidate_id"))
    unknown = [r[0] for r in coverage(listed, found, "candidate_id").filter("problem = 'missing'").orderBy("candidate_id").limit(20).select("candidate_id").collect()]
    if unknown:
        raise KeyError(", ".join(map(str, unknown)))
    return listed.join(found.select("candidate_id", F.col("diary_id").alias("source_id"), "importance"), "candidate_id")


def sources_of(themes: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """theme_id and its distinct sources, as rows of sources (diary_id, ...): explode, join, distinct, semi-join."""
    pairs = members(themes, found).select("theme_id", F.col("source_id").alias("diary_id")).distinct()
    return pairs.join(sources, "diary_id")


def raw_scores(members: DataFrame, sources: int) -> DataFrame:
    """theme_id, source_count, candidate_count, mean_importance, salience, unrounded, for members (theme_id, source_id, importance)."""
    own = members.groupBy("theme_id").agg(F.countDistinct("source_id").alias("source_count"), F.count("*").alias("candidate_count"), F.avg("importance").alias("mean_importance"))
    cover = F.lit(100) * F.col("source_count") / F.lit(sources)
    return own.withColumn("salience", 0.7 * cover + 0.3 * (F.col("mean_importance") / 5 * 100))


def scored(members: DataFrame, sources: int) -> DataFrame:
    """raw_scores() rounded, salience to one decimal and the mean to two after scoring, with rank by salience, then theme_id."""
    own = raw_scores(members, sources).withColumns({"salience": py_round(1)("salience"), "mean_importance": py_round(2)("mean_importance")})
    return ranked(own)


def ranked(scores: DataFrame) -> DataFrame:
    """rank 1, 2, 3 ... by salience, highest first, then theme_id; themes are dealt by ranges of both."""
    own = running(scores.withColumn("_down", -F.col("salience")), [], ["_down", "theme_id"])
    return own.withColumn("rank", F.col("n").cast("int")).drop("_down", "n")


def top(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.orderBy(F.desc("salience"), "theme_id").limit(n)


def histories(turns: DataFrame) -> DataFrame:
    """What each turn sends: all turns up to it, in order. A conversation's turns are collected once and sliced for each turn."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("whole"))
    each = whole.select("conv_id", "whole", F.posexplode("whole").alias("at", "x"))
    return each.select("conv_id", "x.turn", "x.role", "x.text", F.transform(F.slice("whole", F.lit(1), F.col("at") + 1), lambda y: F.struct(y["role"].alias("role"), y["text"].alias("text"))).alias("history"))


def history_refs(turns: DataFrame) -> DataFrame:
    """What each turn sends, by reference: conv_id, turn, sent (turns up to it, its own included) and a digest of them.

    As many rows as turns, whatever their histories hold: the digest is a running sum, modulo 2^60, of a digest of each turn with its
    number, so equal histories have equal digests and it is known which were sent before. history_of() gives the texts.
    """
    own = F.conv(F.substr(F.md5(F.concat_ws("\x1f", F.col("turn").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))), F.lit(1), F.lit(15)), 16, 10).cast("decimal(20,0)")
    parts = running(turns.select("conv_id", "turn", own.alias("_own")), ["conv_id"], ["turn"], {"_sum": F.col("_own").cast("decimal(38,0)")})
    return parts.select("conv_id", "turn", F.col("n").alias("sent"), (F.col("_sum") % F.lit(2**60).cast("decimal(20,0)")).cast("bigint").alias("digest"))


def history_of(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The turns that each wanted turn (conv_id, turn) sends, as rows: conv_id, sent_with, turn, role, text. Texts move for these alone."""
    asked = wanted.select("conv_id", F.col("turn").alias("sent_with")).distinct()
    return turns.join(asked, "conv_id").filter(F.col("turn") <= F.col("sent_with")).select("conv_id", "sent_with", "turn", "role", "text")


def numbered(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The elements of a list column with their 1-based position."""
    return df.select(*keep, F.posexplode(column).alias("at", "element")).select(*keep, (F.col("at") + 1).alias("number"), "element")


def report_totals(scores: DataFrame, audits: DataFrame) -> DataFrame:
    """One row: themes, mentions, audits."""
    return scores.agg(F.count("*").alias("themes"), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("mentions")).crossJoin(audits.agg(F.count("*").alias("audits")))
