"""Briefs read the posts once, and hold on empty and odd windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from postlens.operators import briefs as K
from postlens.sources.fixtures import posts

POSTS = "id long, date date, createdat timestamp_ntz, text string, sentiment_label string, sentiment_score double, aspect_dominant string"


def scans(df):
    """Parquet scans in the plan that ran, by file; a reused exchange is not another."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    return [line.split("Location:")[1].split("[", 1)[1].split("]")[0] for line in final.split("\n") if "Scan parquet" in line or "FileScan parquet" in line]


@pytest.mark.parametrize("brief", [K.executive_summary, K.rule_based_summary, K.rule_based_brief])
def test_one_scan_of_the_posts(spark, brief):
    df = posts(spark, SF_SMALL, with_text=True)
    files = scans(brief(df, "2024-01-05", "2024-01-20"))
    assert sorted(f.rsplit("/", 1)[1] for f in files) in (["documents.parquet", "events.parquet"], ["events.parquet"], ["documents.parquet", "events.parquet"][::-1])


@pytest.mark.parametrize("brief", [K.executive_summary, K.rule_based_summary, K.rule_based_brief])
def test_empty_window(spark, brief):
    rows = brief(posts(spark, SF_SMALL, with_text=True), "2030-01-01", "2030-01-02").collect()
    if brief is K.rule_based_brief:
        text = {r["section"]: r["text"] for r in rows}
        assert text["risks"].startswith("Monitor") and text["opportunities"].startswith("Focus") and "0 conversations" in text["executive_text"]
    else:
        assert len(rows) == 1 and rows[0]["total"] == 0


def frame(spark, rows):
    day = dt.date(2024, 1, 6)
    return spark.createDataFrame([(i, day, dt.datetime(2024, 1, 6, 0, i % 60), *r) for i, r in enumerate(rows)], POSTS)


def test_odd_labels_and_aspects(spark):
    df = frame(spark, [("delivery delays", "NEGATIVE", 0.1, "delivery"), ("delivery refund", None, None, None), (None, "mixed", 0.9, " none "),
                       ("pricing", "negative", 0.2, "pricing"), ("staff", "positive", 0.8, "staff")])
    one = K.executive_summary(df, "2024-01-01", "2024-01-31").first()
    assert (one["total"], one["positive"], one["neutral"], one["negative"]) == (5, 1, 1, 2)
    assert one["aspects"] == "delivery, pricing, staff" and one["keywords"] == "pricing, staff"
    two = K.rule_based_summary(df, "2024-01-01", "2024-01-31").first()
    assert (two["total"], two["positive"], two["neutral"], two["negative"], two["average_sentiment_score"]) == (5, 1, 0, 1, 0.5)
    rows = {r["section"]: [] for r in K.rule_based_brief(df, None, None).collect()}
    for r in K.rule_based_brief(df, None, None).collect():
        rows[r["section"]].append(r["text"])
    assert rows["themes"] == ["Delivery", "Pricing", "Staff"]
    assert rows["risks"][0].startswith("High negative sentiment (100.0%) in Delivery")


def test_prompt_has_counts_aspects_keywords_and_at_most_120_posts(spark):
    df = frame(spark, [(f"post {i} on delivery", ["positive", "negative", "neutral"][i % 3], 0.5, "delivery") for i in range(400)])
    row = K.executive_summary(df, "2024-01-01", "2024-01-31", with_prompt=True).first()
    lines = row["prompt"].split("\n")
    assert lines[0] == "Date window: 2024-01-01 to 2024-01-31" and '"total":400' in lines[1] and '"aspect":"delivery","count":400' in lines[1]
    assert '"keywords":["delivery","post"]' in lines[1] and lines[2] == "Examples (120 tweets):"
    assert len([x for x in lines if x.startswith("- post")]) == 120
    # negative posts come first
    shown = [int(x.split()[2]) for x in lines if x.startswith("- post")]
    assert all(i % 3 == 1 for i in shown[:120]) and lines[-1] == K.SUMMARY_PROMPT_TAIL
    few = K.executive_summary(df.where("id < 6"), "2024-01-01", "2024-01-31", with_prompt=True).first()["prompt"]
    assert [x for x in few.split("\n") if x.startswith("- post")] == [f"- post {i} on delivery" for i in (1, 4, 0, 3, 2, 5)]


def test_generator_is_given_the_prompt(spark):
    df = frame(spark, [("delivery", "negative", 0.1, "delivery")])
    row = K.executive_summary(df, "2024-01-01", "2024-01-31", generate_fn=lambda p: "seen " + str("Grounding (JSON)" in p and "- delivery" in p)).first()
    assert row["summary"] == "seen True" and row["used_llm"]
    assert not K.executive_summary(df, "2025-01-01", "2025-01-31", generate_fn=lambda p: "x").first()["used_llm"]


def test_sampled_keywords_and_other_aspects(spark):
    df = frame(spark, [("alpha", "negative", 0.1, "delivery"), ("alpha beta", "negative", 0.1, "delivery"), ("gamma", "positive", 0.1, "staff")])
    other = df.withColumn("aspect_dominant", F.lit("returns"))
    row = K.executive_summary(df, "2024-01-01", "2024-01-31", aspects_df=other, sample_per_sentiment=1).first()
    assert row["aspects"] == "returns" and row["keywords"] == "alpha, gamma" and row["total"] == 3
