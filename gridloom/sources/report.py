"""The theme report: scores joined to themes and audits, every text escaped, as one HTML page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import html_escape
from gridloom.operators.themes import report_totals
from gridloom.sources.sinks import write_text

#: Stands where a theme has no audit.
NO_AUDIT = "Evidence audit not requested for this theme."
STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;color:#222}article{border:1px solid #ccd;border-radius:8px;margin:1rem 0;padding:1rem}blockquote{border-left:3px solid #c93;margin:.5rem 0;padding:.3rem 1rem}cite{display:block;color:#667}"


def cards(themes: DataFrame, scores: DataFrame, audits: DataFrame) -> DataFrame:
    """rank, card (HTML) of each score: themes (theme_id, title, description), audits (theme_id, explanation, quotes of text and date), which may be missing."""
    quote = lambda q: F.concat(F.lit("<blockquote>"), html_escape(q["text"]), F.lit("<cite>"), html_escape(q["date"]), F.lit("</cite></blockquote>"))
    said = audits.select("theme_id", html_escape(F.col("explanation")).alias("explanation"), F.array_join(F.transform("quotes", quote), "").alias("quotes"))
    own = scores.join(themes.select("theme_id", "title", "description"), "theme_id").join(said, "theme_id", "left")
    one = lambda c: F.format_string("%.1f", F.col(c))
    card = F.concat(
        F.lit("<article><p>"), F.format_string("%02d", F.col("rank")), F.lit(" "), html_escape(F.col("theme_id")), F.lit("</p><h2>"), html_escape(F.col("title")), F.lit("</h2><p>"), one("salience"),
        F.lit("</p><p>"), html_escape(F.col("description")), F.lit("</p><p><strong>"), F.col("source_count").cast("string"), F.lit("</strong> diary days, <strong>"), F.col("candidate_count").cast("string"),
        F.lit("</strong> mentions, <strong>"), one("mean_importance"), F.lit("</strong> mean importance</p><h3>Evidence audit</h3><p>"), F.coalesce("explanation", F.lit(NO_AUDIT)), F.lit("</p>"), F.coalesce("quotes", F.lit("")), F.lit("</article>"),
    )
    return own.select("rank", card.alias("card"))


def write_report(themes: DataFrame, scores: DataFrame, audits: DataFrame, path: str) -> str:
    """The page; scores are one row a theme, so few."""
    t = report_totals(scores, audits).first()
    body = "\n".join(r["card"] for r in cards(themes, scores, audits).orderBy("rank").collect())
    head = f"<h1>Mood diary life themes</h1><p><strong>{t['themes']}</strong> canonical themes, <strong>{t['mentions']}</strong> candidate mentions, <strong>{t['audits']}</strong> evidence audits</p>"
    page = f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Mood Diary Theme Report</title><style>{STYLE}</style></head><body>{head}\n{body}\n</body></html>\n'
    write_text(scores.sparkSession, path, page)
    return page
