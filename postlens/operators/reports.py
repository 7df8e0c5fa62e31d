"""Report tables (R1-R5); rendering to PDF/XLSX is out of scope, these are
the tables a renderer would consume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import sentiment_key
from postlens.operators.filters import where_clause
from postlens.operators.metrics import aspect_sentiment_split_open, label_counts, pct, theme_sizes


def sentiment_report_summary(df: DataFrame, start=None, end=None, digits: int = 1) -> DataFrame:
    """``(metric, value, percent)`` rows: Total Tweets, Positive,
    Negative, Neutral."""
    sub = where_clause(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    row = sub.agg(F.count("*").alias("total"), *label_counts(key))
    return row.select(F.expr(
        "stack(4, 'Total Tweets', total, 'Positive', positive, 'Negative', negative, 'Neutral', neutral) "
        "as (metric, value)"), "total").select(
        "metric", "value",
        F.when(F.col("metric") == "Total Tweets", F.lit(None).cast("double"))
        .otherwise(pct("value", "total", digits)).alias("percent"))


def sentiment_report_daily(df: DataFrame, start=None, end=None) -> DataFrame:
    """R2: per day positive, negative, neutral and their total."""
    sub = where_clause(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    g = sub.groupBy(F.to_date("createdat").alias("date")).agg(*label_counts(key))
    return g.select("date", "positive", "negative", "neutral",
                    (F.col("positive") + F.col("negative") + F.col("neutral")).alias("total")).orderBy("date")


def aspect_report(df: DataFrame, start=None, end=None, digits: int = 1) -> DataFrame:
    """Aspect × label counts and percents, fallback aspect excluded,
    total descending."""
    return aspect_sentiment_split_open(df, start, end, include_others=False, digits=digits,
                                       both_or_none=True)


def theme_report(df: DataFrame, themes: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Theme id, name (default ``Theme N``), post count, summary (default
    sentence), count descending.  ``themes`` is the (small) name table."""
    sizes = theme_sizes(where_clause(df, start, end))
    if themes is not None:
        sizes = sizes.join(F.broadcast(themes.select("id", "name", "summary")), "id", "left")
    else:
        sizes = sizes.select("*", F.lit(None).cast("string").alias("name"),
                             F.lit(None).cast("string").alias("summary"))
    return sizes.select(
        "id",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Theme "), F.col("id").cast("string")))
        .alias("name"),
        "tweet_count",
        F.coalesce(F.nullif(F.col("summary"), F.lit("")),
                   F.concat(F.lit("Analysis of "), F.col("tweet_count").cast("string"),
                            F.lit(" tweets in this theme"))).alias("summary"),
    ).orderBy(F.col("tweet_count").desc(), "id")


def dashboard_report(df: DataFrame, start=None, end=None, days: int = 60, top_aspects: int = 12) -> dict:
    """The three tables of the dashboard report: summary, the last
    ``days`` daily rows (ascending), the ``top_aspects`` largest aspects."""
    daily = sentiment_report_daily(df, start, end)
    last = daily.orderBy(F.col("date").desc()).limit(days).orderBy("date")
    aspects = aspect_report(df, start, end).limit(top_aspects)
    return {"summary": sentiment_report_summary(df, start, end), "daily": last, "aspects": aspects}


def dashboard_daily(df: DataFrame, start=None, end=None, days: int = 60) -> DataFrame:
    """R5 daily table on its own."""
    return dashboard_report(df, start, end, days)["daily"]


def dashboard_aspects(df: DataFrame, start=None, end=None, top: int = 12) -> DataFrame:
    """R5 aspect table with its rank."""
    a = aspect_report(df, start, end)
    top_a = a.orderBy(F.col("total").desc(), "aspect").limit(top)
    return top_a.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "aspect")))


_ = W  # word lists are parameters of the callers
