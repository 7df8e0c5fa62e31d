"""Golden vectors derived by reading the reference (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import aspect_display, aspect_stored
from postlens.functions.dates import normalize_date_param
from postlens.functions.text import is_noise, with_sanitized_title, with_title_checks
from postlens.operators.briefs import extract_brief_json
from postlens.operators.metrics import theme_share
from postlens.operators.themes import mmr_order, name_similarity

TITLES = [
    ("Pricing Concerns and Tariff Impact", False, True),
    ("Prices and Tariffs", True, False),
    ("Order Fulfillment Issues", False, True),
    ("Pricing Concerns", True, False),
    ("Would and Customer Experience", True, False),
    ("Customer Service Experience Concerns", False, True),
    ("Garden Hose Colour Options", False, False),
]


def test_title_rules(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TITLES], "t string")
    got = {r["t"]: (r["t_meaningless"], r["t_valid"]) for r in with_title_checks(df, "t").collect()}
    for t, meaningless, valid in TITLES:
        assert got[t] == (meaningless, valid), t


def test_empty_title_invalid(spark):
    df = spark.createDataFrame([("",)], "t string")
    assert with_title_checks(df, "t").first()["t_valid"] is False


def test_sanitize(spark):
    df = spark.createDataFrame([("Prices and Tariffs", "Order Fulfillment Issues"),
                                ("Pricing Concerns", "Prices and Tariffs"),
                                ('  "Order Fulfillment  Issues" ', "x")], "p string, f string")
    got = [r["s"] for r in with_sanitized_title(df, "p", F.col("f"), "s").collect()]
    assert got == ["Order Fulfillment Issues", W.DEFAULT_TITLE, "Order Fulfillment Issues"]


@pytest.mark.parametrize("a,b,want", [
    ("Product Quality Issues", "Product Quality Issues", 1.0),
    ("Order Fulfillment Issues", "Order Fulfillment Issues Today", 1.0),
    ("Service Quality", "Food Products", 0.0),
    ("Pricing Concerns", "Tariff Impact", 0.3),
    ("Product Availability", "Product Availability Concerns", 1.0),
])
def test_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(name_similarity("a", "b").alias("s")).first()["s"]
    assert abs(got - want) < 1e-9


def test_aspect_keys(spark):
    rows = [(None, "Other", None), ("  ", "Other", None), ("none", "Other", "none"),
            ("Unspecified", "Other", "unspecified"), ("app/ux", "app/ux", "app_ux"), ("Other", "Other", "none"),
            ("Store Staff", "Store Staff", "store_staff")]
    df = spark.createDataFrame([(r[0],) for r in rows], "a string")
    got = df.select(aspect_display(F.col("a")).alias("d"), aspect_stored(F.col("a")).alias("s")).collect()
    assert [(g["d"], g["s"]) for g in got] == [(r[1], r[2]) for r in rows]


def test_noise_words(spark):
    words = ["walmart", "a_b", "user123", "ok", "tariff", "delivery", "abc12"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["n"] for r in df.select("w", is_noise(F.col("w")).alias("n")).collect()}
    assert [got[w] for w in words] == [True, True, True, True, False, False, False]


def test_json_extraction(spark):
    two = 'a ```json {"themes":["X"]} ``` b ```json {"themes":["Y"],"risks":["r"]} ``` c'
    texts = [two, 'x {"themes":["A"]} y', "no braces", "{bad}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"].asDict() for r in df.select(extract_brief_json("t").alias("s")).collect()]
    assert got[0]["themes"] == ["Y"] and got[0]["risks"] == ["r"]
    assert got[1]["themes"] == ["A"] and got[1]["risks"] == []
    for g in got[2:]:
        assert all(v == [] for v in g.values())


def test_date_param(spark):
    df = spark.createDataFrame([("2025-07-01",), ("07/31/2025",), ("7/1/2025",)], "d string")
    got = [r["p"] for r in df.select(normalize_date_param(F.col("d")).alias("p")).collect()]
    assert got == ["2025-07-01", "2025-07-31", "7/1/2025"]


def test_mmr_order():
    assert mmr_order({1: 100, 2: 90, 3: 50}, {(1, 2): 1.0, (2, 1): 1.0}, 3) == [1, 3, 2]


def test_theme_shares(spark):
    sizes = [820, 635, 503, 468, 410, 394, 364, 349, 335, 328, 299, 95]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, tweet_count long")
    got = [r["share"] for r in theme_share(df).orderBy(F.col("tweet_count").desc()).collect()]
    assert got == [16, 13, 10, 9, 8, 8, 7, 7, 7, 7, 6, 2]
    assert sum(sizes) == 5000
