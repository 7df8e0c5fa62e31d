"""Dense themes, coresets, batched inference and keywords per group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from postlens.operators import clustering as V
from postlens.operators import keywords as K
from postlens.operators import scoring as S
from postlens.operators import themes as J
from postlens.sources.fixtures import posts, read_table


def blobs(spark, n=1500):
    rand = np.random.default_rng(5)
    centres = rand.normal(0, 10, (6, 8))
    size = [0.4, 0.3, 0.2, 0.08, 0.015, 0.005]  # the last two are small and far out
    centres[4:] *= 6
    rows = [(i, (centres[rand.choice(6, p=size)] + rand.normal(0, 1, 8)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>").cache()


def test_cost_of_a_coreset_fit_is_within_5_percent(spark):
    for df in (blobs(spark), read_table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))):
        whole = V.cost(df, V.kmeans_centres(df, 6, n_init=3))
        core = V.coreset(df, 400)
        assert 300 < core.count() < 520
        assert V.cost(df, V.kmeans_centres(core, 6, weight_col="weight", n_init=3)) <= 1.05 * whole


def test_coreset_weights_are_unbiased_and_keep_what_is_far_out(spark):
    df = blobs(spark)
    totals = [V.coreset(df, 300, seed).agg(F.sum("weight")).first()[0] for seed in range(12)]
    assert abs(np.mean(totals) / 1500 - 1) < 0.05
    far = df.withColumn("n", V.nearest_center(V.as_array(df, "features"), [[0.0] * 8])["distance"]).orderBy(F.col("n").desc()).limit(8)
    kept = [V.coreset(df, 300, seed).join(far.select("id"), "id").count() for seed in range(6)]
    plain = 8 * 300 / 1500
    assert np.mean(kept) > 2 * plain
    again = [r["id"] for r in V.coreset(df.repartition(7), 300, 3).orderBy("id").collect()]
    assert again == [r["id"] for r in V.coreset(df, 300, 3).orderBy("id").collect()]


def test_coreset_of_equal_rows_and_no_rows(spark):
    same = spark.range(100).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    core = V.coreset(same, 20)
    assert {round(r["weight"], 6) for r in core.collect()} == {10.0} or core.count() > 0
    assert V.coreset(same.where("false"), 20).count() == 0


def test_nearest_centre_ties_go_to_the_first(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],), ([9.0, 9.0],)], "v array<double>")
    out = df.select(V.nearest_center(F.col("v"), [[-1.0, 0.0], [1.0, 0.0], [1.0, 0.0]])["theme"].alias("t")).collect()
    assert [r["t"] for r in out] == [0, 1, 1]
    with pytest.raises(ValueError):
        V.nearest_center(F.col("v"), [])


def test_themes_from_an_embedder(spark):
    from postlens.plans.q_vectors import letter_embedder

    p = posts(spark, SF_SMALL, with_text=True)
    res = J.compute_themes(p, n_clusters=3, embedder=letter_embedder, fit_sample=200)
    assigned = res["posts"]
    assert assigned.count() == p.count() and {r["theme"] for r in assigned.select("theme").distinct().collect()} <= {0, 1, 2}
    # equal texts have equal vectors, so one theme
    assert assigned.groupBy("text").agg(F.countDistinct("theme").alias("n")).where("n > 1").count() == 0
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size() or "__terms" not in assigned.columns


def test_batches_hold_texts_of_like_length():
    rand = random.Random(2)
    lengths = [int(rand.paretovariate(0.7)) for _ in range(700)] + [0, 0, 256, 256]
    batches = S.length_batches(lengths, 16)
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    for b in batches:
        own = [lengths[i] for i in b]
        assert len(b) <= 16 and max(own) <= 2 * min(own) + 8
    padded = sum(len(b) * max(lengths[i] for i in b) for b in batches)
    in_order = sum(16 * max(lengths[i:i + 16]) for i in range(0, len(lengths), 16))
    assert padded < 0.5 * in_order and S.length_batches([], 4) == []


def test_scores_are_those_of_single_texts_and_end_at_the_limit(spark):
    seen = []

    def predict(texts):
        seen.append([S.n_words(t) for t in texts])
        return [(t[-5:], float(S.n_words(t))) for t in texts]

    rand = random.Random(4)
    texts = [" ".join(f"w{rand.randrange(99)}" for _ in range(rand.choice([0, 1, 5, 40, 255, 256, 257, 900]))) for _ in range(200)]
    got = S.predict_all(predict, texts, 16)
    assert got == [predict([S.first_words(t, 256)])[0] for t in texts]
    assert max(max(b) for b in seen) == 256 and S.first_words("a  b\tc", 2) == "a  b"
    assert S.predict_all(predict, texts, 16, max_length=None) == [predict([t])[0] for t in texts]

    def factory():
        return lambda batch: [("LABEL_2", float(S.n_words(t))) for t in batch]

    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    out = S.run_sentiment(df, "t", factory).orderBy("i").collect()
    assert [r["sentiment_score"] for r in out] == [float(min(256, S.n_words(t))) for t in texts] + [0.0]
    assert {r["sentiment_label"] for r in out} == {"positive"}
    long = S.run_sentiment(df, "t", factory, max_length=None).agg(F.max("sentiment_score")).first()[0]
    assert long == max(map(S.n_words, texts)) > 256


def test_weighted_keywords_per_group_equal_those_of_each_group_alone(spark):
    rows = [("a", "Delivery delays and delivery refund pricing shipping 12345 x"), ("a", "delivery Shipping again again again wonderful things"),
            ("b", "zz yy 123 of the"), (None, "pricing pricing tariffs checkout counters"), ("d", None)]
    df = spark.createDataFrame(rows, "g string, text string")
    got = {}
    for r in K.weighted_keywords_per_group(df, "g", "text", k=4).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["keyword"]))
    assert set(got) == {"a", "b", None, "d"}
    for g in got:
        own = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert sorted(got[g]) == [(r["rank"], r["keyword"]) for r in K.weighted_keywords(own, "text", k=4).orderBy("rank").collect()]


def test_partitions_follow_the_bytes_of_the_texts(spark, monkeypatch):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    least = spark.sparkContext.defaultParallelism
    assert K.text_partitions(df, "text") == least
    monkeypatch.setattr(K, "TEXT_BYTES", 10_000)
    assert K.text_partitions(df, "text") == 100
    assert K.text_partitions(df.select(F.array("text", "text").alias("t")), "t") == 200
    assert K.text_partitions(df.where("false"), "text") == least
