"""Structured Streaming over the same operators.

The reference reads whole files; these helpers run the stateless stages and
the period trend incrementally for a growing post table.  Event-time state is
bounded by a watermark; checkpoints go under the session's shared checkpoint
folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.functions import wordlists as W
from postlens.functions.columns import sentiment_key
from postlens.session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_posts_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                       max_files_per_trigger: int = 100) -> DataFrame:
    """A streaming posts table from event parquet files arriving in
    ``source_dir`` (same projection as the batch fixture, without text)."""
    ev = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
          .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    label = (F.when(F.col("event_type").isin("purchase", "signup"), F.lit("positive"))
             .when(F.col("event_type") == "error", F.lit("negative")).otherwise(F.lit("neutral")))
    return ev.select(F.col("event_id").alias("id"), F.col("ts").alias("createdat"), "user_id",
                     label.alias("sentiment_label"), (F.col("value") / F.lit(500.0)).alias("sentiment_score"))


def windowed_trend(posts: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                   dedupe: bool = True) -> DataFrame:
    """F5 on a stream: label counts per event-time window; duplicates of an
    id inside the watermark are dropped first (B10 for streams)."""
    s = posts.withColumn("createdat", F.col("createdat").cast("timestamp"))
    s = s.withWatermark("createdat", watermark)
    if dedupe:
        s = s.dropDuplicatesWithinWatermark(["id"])
    key = sentiment_key(F.col("sentiment_label"))
    return s.groupBy(F.window("createdat", window).alias("w")).agg(
        *[F.count_if(key == F.lit(x)).alias(x) for x in W.SENTIMENTS], F.count("*").alias("total"))


def start(df: DataFrame, name: str, sink: str = "memory", output_mode: str = "append",
          path: str | None = None, foreach_batch: Callable | None = None,
          available_now: bool = False) -> StreamingQuery:
    """Start a streaming query with its checkpoint under the shared folder;
    ``available_now`` processes everything present, then stops."""
    ckpt = os.path.join(ensure_checkpoint_dir(df.sparkSession), "streams", name)
    w = df.writeStream.queryName(name).outputMode(output_mode).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    if sink == "parquet":
        return w.format("parquet").option("path", path).start()
    return w.format(sink).start()


def stage_writer(transform: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function applying a stateless stage (e.g. sentiment
    or aspect scoring) to each micro-batch and appending it to ``out``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("append").parquet(out)

    return write
