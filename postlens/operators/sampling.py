"""Sort, limit, top-k, sampling and set operators.

Every cut has a total order (ties broken by ``id``).  Per-group "first n"
cuts are written as ``row_number() <= n``: Spark plans them with a partial
``WindowGroupLimit`` before the shuffle, so each map task sends at most n
rows per group and a group holding a third of the data never lands whole in
one task.  Global top-n uses ``orderBy().limit()`` (per-partition top-n,
then a merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import first_non_empty, resolve, serialize_rows
from postlens.operators.packing import pack_columns, unpack_columns
from postlens.session import cut_lineage
from postlens.operators.filters import (aspect_sentiment_equals, date_window, select_fields, text_search,
                                        theme_equals, timestamp_window)


#: Rows up to which Spark plans a partial limit for a ranking window, and parts of a group beyond it.
PARTIAL_LIMIT, SALTS = 1000, 64


def _newest(ts_col: str = "createdat", id_col: str = "id"):
    return [F.col(ts_col).desc(), F.col(id_col)]


def theme_posts(df: DataFrame, theme_id: int, limit: int = 20, start=None, end=None, q: str | None = None,
                fields: Sequence[str] | str | None = None) -> DataFrame:
    """H1: newest ``limit`` posts of a theme, optional whole-day window and
    text search, caller-chosen fields (E9)."""
    n = max(1, int(limit))
    sub = text_search(timestamp_window(theme_equals(df, theme_id), start, end), q)
    top = sub.orderBy(*_newest()).limit(n)
    return serialize_rows(select_fields(top, fields))


def theme_post_items(df: DataFrame, theme_id: int, limit: int = 10, start=None, end=None) -> DataFrame:
    """H1 (item form) with B16/B17: text = first non-empty of the text
    columns, url = first non-empty of the url columns, duplicated aliases."""
    n = max(1, int(limit))
    date_col = resolve(df, W.DATE_API, "date", required=False)
    sub = timestamp_window(theme_equals(df, theme_id), start, end, date_col or "createdat")
    top = sub.orderBy(F.col(date_col).desc(), F.col("id")).limit(n) if date_col else sub.limit(n)
    texts = [c for c in W.TEXT_THEMES if c in df.columns]
    urls = [c for c in ["twitter_url", "tweet_url"] if c in df.columns]
    created = F.coalesce(F.col(date_col).cast("string"), F.lit("")) if date_col else F.lit("")
    text = first_non_empty(*texts) if texts else F.lit("")
    url = first_non_empty(*urls) if urls else F.lit("")
    opt = {c: (F.col(c) if c in df.columns else F.lit(None)) for c in
           ["sentiment_label", "sentiment_score", "aspect_dominant"]}
    return top.select(created.alias("date"), created.alias("createdat"), *[v.alias(k) for k, v in opt.items()],
                      url.alias("url"), url.alias("twitterurl"), text.alias("text"), text.alias("text_clean"))


def sample_posts(df: DataFrame, aspect: str, sentiment: str, start=None, end=None, limit: int = 10,
                 by_stored_key: bool = False) -> DataFrame:
    """H2: newest posts for an aspect and a label, with ``total_available``
    (all matches) beside each returned row."""
    n = max(1, int(limit))
    sub = aspect_sentiment_equals(date_window(df, start, end), aspect, sentiment, by_stored_key=by_stored_key)
    text_col = resolve(df, W.TEXT_SAMPLE, "text")
    sub = sub.where(F.col(text_col).isNotNull())
    top = sub.orderBy(*_newest()).limit(n).select("id", "createdat", F.col(text_col).alias("text"))
    total = sub.agg(F.count("*").alias("total_available")).withColumn("_k", F.lit(0))
    # both sides are small: at most n rows, and one
    return top.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")


def newest_rows(df: DataFrame, max_rows: int, ts_col: str = "createdat", id_col: str = "id") -> DataFrame:
    """H3: keep the newest ``max_rows`` rows."""
    return df.orderBy(*_newest(ts_col, id_col)).limit(int(max_rows))


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """H4: reproducible sample of n rows — the n smallest ``md5(seed|id)``;
    independent of partitioning, unlike ``sample()``."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return df.withColumn("_h", key).orderBy("_h", id_col).limit(int(n)).drop("_h")


def first_n_per_group(df: DataFrame, group_col: str, n: int, order: Sequence = None) -> DataFrame:
    """H5/H6 building block: first n rows per group by ``order`` (default
    oldest first, then id).  Beyond ``PARTIAL_LIMIT`` rows Spark plans no
    partial limit; groups are then cut in ``SALTS`` hashed parts first, so a
    large group is sorted by many tasks and at most n rows of each part meet."""
    order = list(order) if order else [F.col("createdat"), F.col("id")]
    if n > PARTIAL_LIMIT:
        part = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        first = F.row_number().over(Window.partitionBy(group_col, "_part").orderBy(*order))
        df = df.withColumn("_part", part).withColumn("_rn", first).where(F.col("_rn") <= n).drop("_part", "_rn")
    rn = F.row_number().over(Window.partitionBy(group_col).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n)


def numbered(df: DataFrame, order: Sequence, out_col: str, packed: Sequence[str] = ()) -> DataFrame:
    """Number all rows 1..n by ``order`` without gathering them: ranges are
    sorted by as many tasks, and each range starts after the sizes of those
    before it (a table of one row for each range, sent to all tasks).  Rows move
    once, with the string columns ``packed`` as one compressed value, and are
    stored nowhere else: their sizes are counted on the same shuffled ranges
    that the result reads, as its plan begins with them."""
    spark, columns, low = df.sparkSession, df.columns, (1 << 33) - 1
    rows = pack_columns(df, packed, "_packed") if packed else df
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    rows = DataFrame(spark._jsparkSession.internalCreateDataFrame(ranged._jdf.queryExecution().toRdd(), ranged._jdf.schema(), False), spark)
    sizes = cut_lineage(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    # Spark's increasing id holds a row's place in its range below 33 bits
    rows = rows.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    rows = rows.join(starts, "_range").withColumn(out_col, F.col("_before") + F.col("_place") + 1)
    return (unpack_columns(rows, packed, "_packed") if packed else rows).select(*columns, out_col)


def balanced_sample(df: DataFrame, n: int, labels: Sequence[str] = ("negative", "positive", "neutral")) -> DataFrame:
    """H5: first n posts of each label, labels in the given order → adds
    ``label_order`` and ``pos``."""
    sub = df.where(F.col("sentiment_label").isin(*labels))
    ranked = first_n_per_group(sub, "sentiment_label", n)
    lorder = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("sentiment_label")).cast("int")
    return ranked.select("*", lorder.alias("label_order")).withColumnRenamed("_rn", "pos")


def first_n_per_theme(df: DataFrame, n: int, theme_col: str = "theme") -> DataFrame:
    """H6: first n posts per theme (by id, i.e. table order)."""
    return first_n_per_group(df, theme_col, n, [F.col("id")]).withColumnRenamed("_rn", "pos")


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """H7: the k most common non-null values → ``(rank, value, count)``."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))
    top = g.orderBy(F.col("count").desc(), "value").limit(int(k))
    return top.select(F.row_number().over(Window.orderBy(F.col("count").desc(), "value")).alias("rank"),
                      "value", "count")


def distinct_dates(df: DataFrame, ts_col: str = "createdat") -> DataFrame:
    """H10."""
    return df.select(F.to_date(ts_col).alias("date")).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    """H11."""
    return df.distinct()


def capped_themes(themes: DataFrame, n: int, count_col: str = "tweet_count") -> DataFrame:
    """The n largest themes plus the uncapped theme count."""
    top = themes.orderBy(F.col(count_col).desc(), F.col("id")).limit(int(n))
    total = themes.agg(F.count("*").alias("n_available")).withColumn("_k", F.lit(0))
    return top.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")


def aspects_export(df: DataFrame, aspects: Sequence[str], start=None, end=None, per_label: int | None = None,
                   labels: Sequence[str] = ("positive", "neutral", "negative")) -> DataFrame:
    """For each of the aspects, in their order, all posts (or the newest
    ``per_label``) of each label, in label order and newest first, numbered
    1..n over the whole export, with aspect, label and the range label."""
    names = list(dict.fromkeys(a.lower() for a in aspects))
    shown = {a.lower(): a for a in reversed(aspects)}
    sub = date_window(df, start, end).where(F.lower(F.col("aspect_dominant")).isin(*names))
    sub = sub.where(F.lower(F.col("sentiment_label")).isin(*labels))
    text = first_non_empty(*[c for c in ["text_clean", "text", "fulltext"] if c in df.columns])
    aorder = F.array_position(F.array(*[F.lit(a) for a in names]), F.lower("aspect_dominant")).cast("int")
    lorder = F.array_position(F.array(*[F.lit(x) for x in labels]), F.lower("sentiment_label")).cast("int")
    sub = sub.select(text.alias("tweet_text"), aorder.alias("_aspect"), lorder.alias("_label"), "createdat", "id")
    newest = [F.col("createdat").desc(), F.col("id")]
    if per_label:
        sub = first_n_per_group(sub.withColumn("_group", F.struct("_aspect", "_label")), "_group", per_label, newest)
    rows = numbered(sub, [F.col("_aspect"), F.col("_label"), *newest], "tweet_no", ["tweet_text"])
    return rows.select(
        "tweet_no", "tweet_text", F.element_at(F.array(*[F.lit(shown[a]) for a in names]), F.col("_aspect")).alias("aspect"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_label")).alias("sentiment"),
        F.lit(f"{start} to {end}").alias("date_range"))


def aspect_export(df: DataFrame, aspect: str, start=None, end=None, per_label: int | None = None,
                  labels: Sequence[str] = ("positive", "neutral", "negative")) -> DataFrame:
    """The export of one aspect."""
    return aspects_export(df, [aspect], start, end, per_label, labels)


def aspect_sentiment_export(df: DataFrame, aspect: str, sentiment: str, start=None, end=None,
                            limit: int | None = None) -> DataFrame:
    """A10: one aspect and one label, all posts or the newest ``limit``, numbered."""
    return aspect_export(df, aspect, start, end, per_label=limit, labels=(sentiment.lower(),))
