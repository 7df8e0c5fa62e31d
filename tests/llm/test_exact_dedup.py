"""The extendible-hash index, against grouping by the text itself."""

import hashlib
import random
import string
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from postlens.llm import exact_dedup as D
from postlens.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    by = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        by[(text or "").translate(LOWER)].append((-1 if doc is None else doc, i))
    out = []
    for text, own in by.items():
        top, first = max(d for d, _ in own), True
        for doc, _ in own:
            out.append((None if doc < 0 else doc, None if top < 0 else top, len(own), doc == top and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and doc != top
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [(None, None), (None, ""), (1, ""), (1, ""), (2, "ABC É"), (3, "abc É"), (3, "aBc É"), (4, "abc é"), (5, "x" * 300_000),
       (6, "X" * 300_000), (7, "İ K"), (8, "i̇ k"), (9, " abc É"), (10, "\x00"), (11, "\x00")]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    df = QUERIES["op13_exact_dedup"](spark, SMALL)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(df) == sorted(con.execute(ORACLE_SQL["op13_exact_dedup"]).fetchall(), key=str)


@pytest.mark.parametrize("capacity, bits", [(None, 64), (2, 64), (1, 3), (4, 1)])
def test_any_bucket_size_and_colliding_keys(spark, capacity, bits):
    rand = random.Random(5)
    rows = ODD + [(rand.choice([None, *range(40)]), rand.choice("abcdeABCDE") * rand.randint(0, 4)) for _ in range(300)]
    assert result(D.groups(frame(spark, rows), capacity, bits)) == brute(rows)


def test_overfull_buckets_are_split(spark):
    records = D.grouped(D.keyed(frame(spark, [(i, str(i)) for i in range(3000)])))
    pointers, depth = D.directory(records, 20)
    slots = pointers.collect()
    assert len({r["slot"] for r in slots}) == len(slots) <= 2**depth
    assert len({r["depth"] for r in slots}) > 1  # some buckets were split more often than others
    sizes = D.located(records, pointers, depth).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) <= 20
    held = D.index(records.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm"), pointers, depth)
    assert held.where("chain <> 1 or chained <> 1 or key_rows <> 1").count() == 0


def test_one_text_on_a_third_of_all_rows_is_spread(spark):
    rows = [(i, "common" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    assert result(D.groups(frame(spark, rows))) == brute(rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(*r, 1, 2) for r in ODD]
    kept = D.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, key int, norm int"))
    assert kept.columns == ["doc_id", "text", "key", "norm"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9, 11]


def test_empty_table_and_clashing_columns(spark):
    df = frame(spark, ODD).selectExpr("*", "'k' as key", "1 as norm", "2 as bucket", "3 as turn", "4 as copies")
    assert result(D.groups(df)) == brute(ODD)
    assert D.groups(df.where("false")).collect() == [] and D.deduplicated(df.where("false")).collect() == []


def test_no_python_on_the_path(spark):
    plan = QUERIES["op13_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
