"""The streaming trend equals the batch daily counts on the same events."""

import uuid

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from postlens.operators import metrics as M
from postlens.sources.fixtures import posts
from postlens.streaming import live


def test_stream_trend_matches_batch(spark):
    stream = live.event_posts_stream(spark, SF_SMALL, file_glob="events.parquet")
    # a fresh name → a fresh checkpoint (a reused one resumes and reads nothing new)
    name = f"trend_test_{uuid.uuid4().hex[:8]}"
    q = live.start(live.windowed_trend(stream), name, output_mode="complete", available_now=True)
    q.awaitTermination(300)
    got = {r["d"]: (r["positive"], r["negative"], r["neutral"], r["total"]) for r in
           spark.sql(f"select cast(w.start as date) as d, * from {name}").collect()}
    want = {r["date"]: (r["positive_count"], r["negative_count"], r["neutral_count"], r["total"]) for r in
            M.sentiment_trend(posts(spark, SF_SMALL, with_text=False), "daily").collect()}
    assert got == want


def test_stage_writer(spark, tmp_path):
    stream = live.event_posts_stream(spark, SF_SMALL, file_glob="events.parquet")
    out = str(tmp_path / "scored")
    fn = live.stage_writer(lambda b: b.withColumn("score2", F.col("sentiment_score") * 2), out)
    q = live.start(stream, f"stage_test_{uuid.uuid4().hex[:8]}", foreach_batch=fn, available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(out).count() == posts(spark, SF_SMALL, with_text=False).count()
