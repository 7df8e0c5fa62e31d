"""The aspect × sentiment rollup by day (F12), kept up to date by deltas.

Each batch of posts adds its own counts, ``(date, aspect_dominant, positive,
neutral, negative)``, whatever days its posts are of: a late post is one more in
the counts of its day.  A batch is a partition of the table with the batch's
name, written as a whole, so a batch that is run again replaces what it had
added, and one that fails adds nothing until it is run again.  Readers add up
the batches; a window's predicate goes down to their files.  ``compact`` rolls
all batches up into one.

The rollup is days × aspects × batches rows, whatever the number of posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import aspect_api_key, sentiment_key
from postlens.operators.filters import date_window
from postlens.operators.metrics import label_counts
from postlens.sources import published

SCHEMA = "date date, aspect_dominant string, positive long, neutral long, negative long"
BASE = "base"


def day_counts(posts: DataFrame) -> DataFrame:
    """The counts of posts by day and aspect key; posts without a day have a null one."""
    key = sentiment_key(F.col("sentiment_label"))
    return posts.groupBy("date", aspect_api_key(F.col("aspect_dominant")).alias("aspect_dominant")).agg(*label_counts(key))


def rollup(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The rollup of a window (or of all posts), in the form of ``metrics.build_aspect_rollup``."""
    folder = published.current(spark, path)
    rows = spark.read.schema(SCHEMA + ", batch string").parquet(folder) if folder else spark.createDataFrame([], SCHEMA)
    rows = date_window(rows, start, end)
    return rows.groupBy("aspect_dominant").agg(*[F.sum(s).alias(s) for s in W.SENTIMENTS])


def rebuild(posts: DataFrame, path: str) -> None:
    """A new rollup of all posts."""
    published.publish(day_counts(posts).withColumn("batch", F.lit(BASE)), path, ["batch"])


def add_batch(posts: DataFrame, path: str, batch: str) -> None:
    """Add the posts of a batch, of whatever days; a batch that was added before is replaced."""
    if batch == BASE or "/" in batch or not batch:
        raise ValueError(f"not a batch name: {batch!r}")
    spark = posts.sparkSession
    folder = published.current(spark, path)
    if folder is None:
        rebuild(posts.where("false"), path)
        folder = published.current(spark, path)
    # the partition's rows are set in one commit of Spark's writer; the other batches' files are not touched
    day_counts(posts).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def compact(spark: SparkSession, path: str) -> None:
    """All batches as one, as a new version: until it is whole, readers see the old one.  No batch may run meanwhile, and
    those from before can't be replaced any more."""
    folder = published.current(spark, path)
    if folder is None:
        return
    rows = spark.read.schema(SCHEMA + ", batch string").parquet(folder)
    rows = rows.groupBy("date", "aspect_dominant").agg(*[F.sum(s).alias(s) for s in W.SENTIMENTS])
    published.publish(rows.withColumn("batch", F.lit(BASE)), path, ["batch"])
