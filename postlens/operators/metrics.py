"""Aggregations.

Shape of every operator: one scan, one ``groupBy`` with conditional counts
(``count_if``) so the partial aggregate runs map-side and only a handful of
rows per partition are shuffled; vocabularies are joined *after* the
aggregate, when both sides are at most a few dozen rows.  Shares of a total
use ``sum() over ()`` on those aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import aspect_api_key, aspect_display, pretty_label, sentiment_key
from postlens.functions.dates import period_bucket
from postlens.operators.filters import date_window, include_others as _include_others

def _all():
    """Whole-table window; only ever applied to post-aggregate tables (at most
    vocabulary-size rows), never to posts."""
    return Window.partitionBy()


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------
def vocab_frame(spark: SparkSession, values: Sequence[str], name: str, order_col: str = "ord") -> DataFrame:
    """A small literal table built inside the plan (no driver → executor data)."""
    rows = [F.struct(F.lit(v).alias(name), F.lit(i).alias(order_col)) for i, v in enumerate(values)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def align_counts(counts: DataFrame, vocab: Sequence[str], key: str, cols: Sequence[str]) -> DataFrame:
    """G2 without a join: add a zero row per vocabulary value, re-aggregate,
    keep the vocabulary keys and number them in vocabulary order (``ord``).
    Membership is computed inside the aggregate, so the filter stays on the
    small aggregated rows instead of being pushed into the scan (where it
    would re-evaluate a possibly large key expression per input row)."""
    voc = vocab_frame(counts.sparkSession, vocab, key)
    zeros = voc.select(key, *[F.lit(0).cast("long").alias(c) for c in cols])
    merged = counts.select(key, *[F.col(c).cast("long").alias(c) for c in cols]).unionByName(zeros)
    order = F.array_position(F.array(*[F.lit(v) for v in vocab]), F.col(key))
    merged = merged.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols], F.max(order).alias("_pos"))
    return merged.where(F.col("_pos") > 0).select(key, (F.col("_pos") - 1).cast("int").alias("ord"), *cols)


def pct(n: Column | str, total: Column | str, digits: int | None) -> Column:
    """``round(100*n/total, digits)``; 0.0 when total is 0."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    raw = F.lit(100.0) * n / total
    val = raw if digits is None else F.round(raw, digits)
    return F.when(total > 0, val).otherwise(F.lit(0.0))


def label_counts(label: Column) -> list[Column]:
    """positive/neutral/negative conditional counts for one aggregate."""
    return [F.count_if(label == F.lit(s)).alias(s) for s in W.SENTIMENTS]


# ---------------------------------------------------------------------------
# F1-F3 sentiment summaries
# ---------------------------------------------------------------------------
def sentiment_summary(df: DataFrame, start=None, end=None, digits: int = 2,
                      label_col: str = "sentiment_label") -> DataFrame:
    """one row per label (the three labels always present, others kept),
    with count, window total and percent; zero rows on an empty window."""
    sub = date_window(df, start, end)
    counts = sub.groupBy(sentiment_key(F.col(label_col)).alias("sentiment_label")).agg(F.count("*").alias("count"))
    zeros = vocab_frame(df.sparkSession, W.SENTIMENTS, "sentiment_label").select(
        "sentiment_label", F.lit(0).cast("long").alias("count"))
    merged = counts.unionByName(zeros).groupBy("sentiment_label").agg(F.sum("count").alias("count"))
    merged = merged.withColumn("total", F.sum("count").over(_all()))
    return merged.withColumn("percent", pct("count", "total", digits))


def sentiment_summary_scored(df: DataFrame, start=None, end=None, digits: int = 1,
                             both_or_none: bool = False) -> DataFrame:
    """F2: F1 plus the mean score per label (null when the label is absent);
    percent to ``digits`` (1 by default)."""
    from postlens.operators.filters import where_clause

    sub = where_clause(df, start, end, both_or_none=both_or_none)
    key = sentiment_key(F.col("sentiment_label")).alias("sentiment_label")
    counts = sub.groupBy(key).agg(F.count("*").alias("count"), F.avg("sentiment_score").alias("avg_score"))
    zeros = vocab_frame(df.sparkSession, W.SENTIMENTS, "sentiment_label").select(
        "sentiment_label", F.lit(0).cast("long").alias("count"), F.lit(None).cast("double").alias("avg_score"))
    merged = counts.unionByName(zeros).groupBy("sentiment_label").agg(
        F.sum("count").alias("count"), F.max("avg_score").alias("avg_score"))
    merged = merged.withColumn("total", F.sum("count").over(_all()))
    return merged.select("sentiment_label", "count", F.round("avg_score", 6).alias("avg_score"), "total",
                         pct("count", "total", digits).alias("percent"))


def window_sentiment_summary(df: DataFrame, start=None, end=None) -> DataFrame:
    """the brief's window summary; same table as F1 (total 0 on an empty
    window, decision in SURVEY §2.13)."""
    return sentiment_summary(df, start, end, digits=2)


# ---------------------------------------------------------------------------
# F4-F6 trends
# ---------------------------------------------------------------------------
def daily_trend(df: DataFrame, start=None, end=None) -> DataFrame:
    """per day, percent of each label over pos+neu+neg, unrounded, wide."""
    sub = date_window(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    g = sub.groupBy("date").agg(*label_counts(key))
    tot = F.col("positive") + F.col("neutral") + F.col("negative")
    return g.select(
        "date",
        *[F.when(tot > 0, F.col(s) / tot * F.lit(100.0)).otherwise(F.lit(0.0)).alias(s) for s in W.SENTIMENTS],
    )


def sentiment_trend(df: DataFrame, period: str = "daily", start=None, end=None, offset: int = 0,
                    limit: int = 0, digits: int = 1, ts_col: str = "createdat") -> DataFrame:
    """counts and percents per daily/weekly(Monday)/monthly bucket.
    ``limit > 0`` pages buckets newest first (``offset`` skipped), returned
    oldest first."""
    sub = date_window(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    g = sub.groupBy(period_bucket(F.col(ts_col), period).alias("date")).agg(
        *[F.count_if(key == F.lit(s)).alias(f"{s}_count") for s in W.SENTIMENTS],
        F.count("*").alias("total"),
    )
    out = g.select(
        "date",
        *[pct(f"{s}_count", "total", digits).alias(s) for s in W.SENTIMENTS],
        *[f"{s}_count" for s in W.SENTIMENTS],
        "total",
    )
    if limit and limit > 0:
        out = out.orderBy(F.col("date").desc()).offset(max(0, int(offset))).limit(int(limit))
    return out.orderBy("date")


def reaggregate_trend(daily: DataFrame, period: str) -> DataFrame:
    """unweighted mean of daily percents per Monday week or month.
    ``date`` is the Monday (``yyyy-MM-dd``) or the month (``yyyy-MM``)."""
    if period == "weekly":
        key = F.date_format(F.date_trunc("week", F.col("date")), "yyyy-MM-dd")
    elif period == "monthly":
        key = F.date_format(F.col("date"), "yyyy-MM")
    else:
        key = F.date_format(F.col("date"), "yyyy-MM-dd")
    g = daily.groupBy(key.alias("date")).agg(*[F.avg(s).alias(s) for s in W.SENTIMENTS])
    return g.select("date", *[F.round(s, 4).alias(s) for s in W.SENTIMENTS]).orderBy("date")


# ---------------------------------------------------------------------------
# F7-F13 aspects
# ---------------------------------------------------------------------------
def aspect_distribution(df: DataFrame, start=None, end=None, aspects: Sequence[str] = W.ASPECTS,
                        digits: int = 2) -> DataFrame:
    """counts on the fixed vocabulary (keys normalised by B13); total and
    percent over the vocabulary only; zeros when empty."""
    sub = date_window(df, start, end)
    counts = sub.groupBy(aspect_api_key(F.col("aspect_dominant")).alias("aspect")).agg(F.count("*").alias("count"))
    out = align_counts(counts, aspects, "aspect", ["count"])
    out = out.withColumn("total", F.sum("count").over(_all()))
    return out.select("aspect", "ord", "count", "total", pct("count", "total", digits).alias("percent"))


def aspect_distribution_open(df: DataFrame, start=None, end=None, digits: int = 2,
                             both_or_none: bool = False) -> DataFrame:
    """F8: every displayed aspect (fallback included), count and percent of
    all rows, descending."""
    from postlens.operators.filters import where_clause

    sub = where_clause(df, start, end, both_or_none=both_or_none)
    g = sub.groupBy(aspect_display(F.col("aspect_dominant")).alias("aspect")).agg(F.count("*").alias("count"))
    g = g.withColumn("total", F.sum("count").over(_all()))
    return g.select("aspect", "count", pct("count", "total", digits).alias("percent")).orderBy(
        F.col("count").desc(), "aspect")


def aspect_avg_scores(df: DataFrame, start=None, end=None, keys: Sequence[str] = W.ASPECT_KEYS,
                      digits: int = 4) -> DataFrame:
    """mean of each ``aspect_<key>`` column (``digits`` dp, empty → 0)."""
    sub = date_window(df, start, end)
    present = [k for k in keys if f"aspect_{k}" in df.columns]
    return sub.agg(*[F.coalesce(F.round(F.avg(f"aspect_{k}"), digits), F.lit(0.0)).alias(k) for k in present])


def _split_counts(sub: DataFrame, bucket: Column) -> DataFrame:
    key = sentiment_key(F.col("sentiment_label"))
    return sub.groupBy(bucket.alias("aspect")).agg(*label_counts(key))


def _split_percent(df: DataFrame, digits: int) -> DataFrame:
    tot = F.col("positive") + F.col("neutral") + F.col("negative")
    return df.select(
        "*", *[pct(s, tot, digits).alias(f"{s}_pct") for s in W.SENTIMENTS])


def aspect_sentiment_split(df: DataFrame, start=None, end=None, aspects: Sequence[str] = W.ASPECTS,
                           include_others: bool = False, digits: int = 2) -> DataFrame:
    """aspect × sentiment on the fixed vocabulary (order kept in ``ord``),
    plus an ``others`` bucket (null aspect included) when asked; percent
    within aspect over pos+neu+neg."""
    sub = date_window(df, start, end)
    a = aspect_api_key(F.col("aspect_dominant"))
    bucket = F.when(a.isin(*aspects), a).otherwise(F.lit("others"))
    counts = _split_counts(sub, bucket)
    return _split_from_counts(df.sparkSession, counts, aspects, include_others, digits)


def _split_from_counts(spark: SparkSession, counts: DataFrame, aspects: Sequence[str], include_others: bool,
                       digits: int) -> DataFrame:
    labels = list(aspects) + (["others"] if include_others else [])
    out = align_counts(counts, labels, "aspect", W.SENTIMENTS)
    return _split_percent(out, digits)


def build_aspect_rollup(df: DataFrame) -> DataFrame:
    """F12 (writer): the date-free aspect × sentiment rollup
    ``(aspect_dominant, positive, neutral, negative)``; written once by a job."""
    key = sentiment_key(F.col("sentiment_label"))
    return df.groupBy(aspect_api_key(F.col("aspect_dominant")).alias("aspect_dominant")).agg(*label_counts(key))


def aspect_split_from_rollup(rollup: DataFrame, aspects: Sequence[str] = W.ASPECTS, include_others: bool = False,
                             digits: int = 2) -> DataFrame:
    """F12 (reader): the F10 answer from the rollup; must equal F10 with no dates."""
    a = F.col("aspect_dominant")
    bucket = F.when(a.isin(*aspects), a).otherwise(F.lit("others"))
    counts = rollup.groupBy(bucket.alias("aspect")).agg(*[F.sum(s).alias(s) for s in W.SENTIMENTS])
    return _split_from_counts(rollup.sparkSession, counts, aspects, include_others, digits)


def aspect_sentiment_split_open(df: DataFrame, start=None, end=None, include_others: bool = False,
                                digits: int = 1, both_or_none: bool = False) -> DataFrame:
    """aspect × sentiment over every displayed aspect (B11), total and
    percent within aspect, ordered by total desc."""
    from postlens.operators.filters import where_clause

    sub = _include_others(where_clause(df, start, end, both_or_none=both_or_none), include_others)
    g = _split_counts(sub, aspect_display(F.col("aspect_dominant")))
    g = g.withColumn("total", F.col("positive") + F.col("neutral") + F.col("negative"))
    out = g.select("aspect", "positive", "negative", "neutral", "total",
                   *[pct(s, "total", digits).alias(f"{s}_pct") for s in W.SENTIMENTS])
    return out.orderBy(F.col("total").desc(), "aspect")


def top_aspects(df: DataFrame, start=None, end=None, k: int = 6) -> DataFrame:
    """the k most frequent dominant aspects with their label counts; the
    fallback is removed *after* the top-k cut, so k-1 rows can come back."""
    sub = date_window(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    g = sub.groupBy(F.col("aspect_dominant").alias("aspect")).agg(
        F.count("*").alias("count"),
        F.count_if(key == "positive").alias("pos"),
        F.count_if(key == "negative").alias("neg"),
        F.count_if(key == "neutral").alias("neu"),
    )
    top = g.orderBy(F.col("count").desc(), F.col("aspect")).limit(int(k))  # per-partition top-k, then merge
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("aspect"))))
    return ranked.where(aspect_display(F.col("aspect")) != W.ASPECT_FALLBACK)


# ---------------------------------------------------------------------------
# F14-F18 one-row stats, ranges, themes
# ---------------------------------------------------------------------------
def sentiment_counts_row(df: DataFrame, start=None, end=None, both_or_none: bool = False) -> DataFrame:
    """one row — total, positive, negative, neutral, mean score."""
    from postlens.operators.filters import where_clause

    sub = where_clause(df, start, end, both_or_none=both_or_none)
    key = sentiment_key(F.col("sentiment_label"))
    return sub.agg(
        F.count("*").alias("total"),
        F.count_if(key == "positive").alias("positive"),
        F.count_if(key == "negative").alias("negative"),
        F.count_if(key == "neutral").alias("neutral"),
        F.round(F.avg("sentiment_score"), 6).alias("avg_sentiment"),
    )


def basic_stats(df: DataFrame, aspect_col: str = "aspect", keywords_col: str = "topic_keywords",
                top: int = 10) -> DataFrame:
    """long-form ``(metric, key, value, rank)``: row count, label counts
    (null kept as ``null``), top aspects, top non-empty topic keywords.  One
    scan with grouping sets, ranks computed on the small result."""
    cols = {"sentiment": F.coalesce(F.col("sentiment_label").cast("string"), F.lit("null"))}
    if aspect_col in df.columns:
        cols["aspect"] = F.col(aspect_col).cast("string")
    if keywords_col in df.columns:
        cols["topic_keywords"] = F.nullif(F.col(keywords_col).cast("string"), F.lit(""))
    proj = df.select(*[c.alias(n) for n, c in cols.items()])
    sets = [[F.col(n)] for n in cols] + [[]]
    g = proj.groupingSets(sets, *[F.col(n) for n in cols]).agg(
        F.count("*").alias("value"), *[F.grouping(n).alias(f"_g_{n}") for n in cols])
    metric = F.lit("n_tweets")
    key = F.lit("")
    for n in cols:
        metric = F.when(F.col(f"_g_{n}") == 0, F.lit(n)).otherwise(metric)
        key = F.when(F.col(f"_g_{n}") == 0, F.col(n)).otherwise(key)
    long = g.select(metric.alias("metric"), key.alias("key"), "value")
    long = long.where(~((F.col("metric") != "n_tweets") & (F.col("metric") != "sentiment") & F.col("key").isNull()))
    fixed = long.where(F.col("metric").isin("n_tweets", "sentiment")).withColumn("rank", F.lit(0))
    ranked = long.where(F.col("metric").isin("aspect", "topic_keywords"))
    rk = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("key")))
    # filtering on the rank itself lets Spark cut to `top` rows per metric map-side
    ranked = ranked.withColumn("rank", rk).where(F.col("rank") <= top)
    return fixed.unionByName(ranked)


def date_range(df: DataFrame, date_col: str = "date") -> DataFrame:
    """F16: min and max date."""
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def theme_sizes(df: DataFrame, start=None, end=None, theme_col: str = "theme") -> DataFrame:
    """posts per theme, descending (ties by id)."""
    sub = date_window(df, start, end)
    return sub.groupBy(F.col(theme_col).cast("int").alias("id")).agg(F.count("*").alias("tweet_count")).orderBy(
        F.col("tweet_count").desc(), "id")


def theme_sentiment(df: DataFrame, theme_col: str = "theme") -> DataFrame:
    """per theme, positive/negative/neutral counts (zero-filled)."""
    key = sentiment_key(F.col("sentiment_label"))
    return df.groupBy(F.col(theme_col).cast("int").alias("id")).agg(
        F.count("*").alias("tweet_count"), *label_counts(key))


# ---------------------------------------------------------------------------
# F19-F24 drill-downs and client-side shares
# ---------------------------------------------------------------------------
def day_drilldown(df: DataFrame, day, digits: int = 4) -> DataFrame:
    """one day (exactly), long form ``(section, aspect, count,
    section_total, percent)``; ``section`` is ``all`` or a label; zero rows
    dropped."""
    sub = date_window(df, day, day)
    key = sentiment_key(F.col("sentiment_label"))
    g = sub.groupBy(aspect_display(F.col("aspect_dominant")).alias("aspect")).agg(*label_counts(key))
    g = g.withColumn("all", F.col("positive") + F.col("neutral") + F.col("negative"))
    stacked = g.select("aspect", F.expr("stack(4, 'all', `all`, 'positive', positive, 'neutral', neutral, "
                                        "'negative', negative) as (section, count)"))
    stacked = stacked.where(F.col("count") > 0)
    stacked = stacked.withColumn("section_total", F.sum("count").over(Window.partitionBy("section")))
    return stacked.withColumn("percent", pct("count", "section_total", digits))


def daily_label_counts(df: DataFrame, start=None, end=None) -> DataFrame:
    """per date, counts by label and total (one job for the window)."""
    sub = date_window(df, start, end)
    key = sentiment_key(F.col("sentiment_label"))
    return sub.groupBy("date").agg(*label_counts(key), F.count("*").alias("total"))


def aspect_split_for_sentiment(df: DataFrame, sentiment: str, start=None, end=None, digits: int = 1) -> DataFrame:
    """F11 (others included) for one label: display label, count, percent."""
    s = sentiment.lower()
    split = aspect_sentiment_split_open(df, start, end, include_others=True, digits=digits)
    return split.select(pretty_label(F.col("aspect"), "none").alias("aspect"), F.col(s).alias("count"), F.col(f"{s}_pct").alias("percentage"),
                        F.lit(s).alias("sentiment"))


def theme_share(themes: DataFrame, n: int | None = None, count_col: str = "tweet_count") -> DataFrame:
    """whole-number share of each (selected) theme in their sum."""
    sel = themes
    if n is not None:
        sel = sel.orderBy(F.col(count_col).desc(), F.col("id")).limit(int(n))
    sel = sel.withColumn("_sum", F.sum(count_col).over(_all()))
    return sel.withColumn("share", F.when(F.col("_sum") > 0, F.round(F.col(count_col) / F.col("_sum") * 100, 0))
                          .otherwise(F.lit(0.0)).cast("int")).drop("_sum")


def aspect_stacked_totals(df: DataFrame, start=None, end=None) -> DataFrame:
    """per aspect (label upper-cased): counts, total and whole-number
    percent of each label."""
    split = aspect_sentiment_split_open(df, start, end, include_others=True)
    out = split.select(F.upper("aspect").alias("label"), *W.SENTIMENTS, "total")
    return out.select("label", *W.SENTIMENTS, "total", *[
        F.when(F.col("total") > 0, F.round(F.col(s) / F.col("total") * 100, 0)).otherwise(F.lit(0.0))
        .cast("int").alias(f"{s}_share") for s in W.SENTIMENTS])


def grand_total(df: DataFrame, start=None, end=None) -> DataFrame:
    """total posts over all aspects × labels."""
    split = aspect_sentiment_split_open(df, start, end, include_others=True)
    return split.agg(F.sum("total").alias("total"))
