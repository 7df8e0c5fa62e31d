"""Published tables, rollups by batches, pages and the search index."""

import datetime as dt
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from postlens.operators import filters as E
from postlens.operators import metrics as M
from postlens.operators import paging, rollups, search_index
from postlens.plans import stages as P
from postlens.sources import files as A
from postlens.sources import published
from postlens.sources.fixtures import posts


def test_a_stage_that_fails_half_way_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "stage")
    old = spark.range(100).select("id", F.lit("2024-01-05").cast("date").alias("date"))
    A.write_stage(old, path)
    assert A.read_stage(spark, path).count() == 100

    @F.udf("long")
    def fails(i):
        if i == 777:
            raise RuntimeError("lost")
        return i

    with pytest.raises(Exception, match="lost"):
        A.write_stage(spark.range(0, 1000, 1, 8).select(fails("id").alias("id"), F.lit("2024-01-06").cast("date").alias("date")), path)
    assert A.read_stage(spark, path).agg(F.count("*"), F.max("date")).first() == (100, dt.date(2024, 1, 5))
    A.write_stage(old.where("id < 7"), path)
    assert A.read_stage(spark, path).count() == 7 and published.versions(spark, path).count() == 2
    assert A.scan(spark, path, F.col("id") < 3, ["id"]).count() == 3
    # a stage may be read while it is replaced by what is made of it
    A.write_stage(A.read_stage(spark, path).where("id > 2"), path)
    assert A.read_stage(spark, path).count() == 4


def test_a_stage_without_rows_keeps_its_columns(spark, tmp_path):
    old = spark.range(3).select("id", F.lit("2024-01-05").cast("date").alias("date"))
    A.write_stage(old.where("false"), str(tmp_path / "s"))
    empty = A.read_stage(spark, str(tmp_path / "s"))
    assert empty.count() == 0 and sorted(empty.dtypes) == [("date", "date"), ("id", "bigint")]


def test_plain_tables_and_missing_ones(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "plain"))
    assert A.read_stage(spark, str(tmp_path / "plain")).count() == 5
    assert published.current(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        A.read_stage(spark, str(tmp_path / "none"))


def test_stage_runners_read_what_was_published(spark, tmp_path):
    src = posts(spark, SF_SMALL, with_text=True).select("id", "createdat", "text")
    out = str(tmp_path / "s0")
    P.run_stage0(spark, out, df=src.where("id < 10"))
    P.run_stage0(spark, out, df=src)
    counts = P.run_stage1(spark, out, str(tmp_path / "s1"), "clean_tweet", positive=["that"], negative=["from"])
    assert counts.agg(F.sum("count")).first()[0] == src.count()


def split(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_appended_days_and_late_posts_equal_a_rebuild(spark, tmp_path):
    p = posts(spark, SF_SMALL, with_text=False)
    p = p.unionByName(p.limit(3).withColumn("date", F.lit(None).cast("date")).withColumn("aspect_dominant", F.lit(None).cast("string")))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    rollups.rebuild(p, whole)
    days = [r["date"] for r in p.select("date").distinct().orderBy("date").collect()]
    late = F.col("id") % 5 == 0
    for i, day in enumerate(days[:6]):
        rollups.add_batch(p.where(F.col("date").eqNullSafe(F.lit(day)) & ~late), parts, f"d{i}")
    rollups.add_batch(p.where(F.col("date").isin(days[6:]) & ~late), parts, "rest")
    rollups.add_batch(p.where(late & (F.col("id") % 2 == 0)), parts, "late")
    assert split(rollups.rollup(spark, parts)) != split(rollups.rollup(spark, whole))
    rollups.add_batch(p.where(late), parts, "late")  # the batch again, now with all of its posts
    for window in ((None, None), ("2024-01-05", "2024-01-09"), ("2024-01-10", None)):
        assert split(rollups.rollup(spark, parts, *window)) == split(rollups.rollup(spark, whole, *window))
    rollups.compact(spark, parts)
    assert split(rollups.rollup(spark, parts)) == split(rollups.rollup(spark, whole)) == split(M.build_aspect_rollup(p))
    window = rollups.rollup(spark, parts, "2024-01-05", "2024-01-09")
    assert split(M.aspect_split_from_rollup(window, include_others=True)) == split(M.aspect_sentiment_split(p, "2024-01-05", "2024-01-09", include_others=True))


def test_empty_rollups_and_names(spark, tmp_path):
    p = posts(spark, SF_SMALL, with_text=False)
    assert rollups.rollup(spark, str(tmp_path / "none")).count() == 0
    rollups.compact(spark, str(tmp_path / "none"))
    rollups.add_batch(p, str(tmp_path / "r"), "one")
    assert split(rollups.rollup(spark, str(tmp_path / "r"))) == split(M.build_aspect_rollup(p))
    for name in ("", "base", "a/b"):
        with pytest.raises(ValueError):
            rollups.add_batch(p, str(tmp_path / "r"), name)


def test_pages_are_those_of_the_whole_order(spark, tmp_path):
    rand = random.Random(3)
    rows = [(i, rand.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, day int").repartition(5)
    path, order = str(tmp_path / "p"), [F.col("day").desc(), F.col("id")]
    paging.build(df, path, order, rows_per_range=150)
    whole = sorted(rows, key=lambda r: (-r[1], r[0]))
    for offset, limit in ((0, 20), (137, 40), (1990, 50), (5000, 5), (0, 0), (700, 400)):
        assert [tuple(r) for r in paging.page(spark, path, order, offset, limit).collect()] == whole[offset:offset + limit]
    # a late page reads its own ranges, not those before it
    _, before, ranges = paging.touched(spark, path, 1900, 30)
    assert before >= 1500 and len(ranges) <= 2
    plan = paging.page(spark, path, order, 1900, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan
    day, last = whole[419][1], whole[419][0]
    after = (F.col("day") < day) | ((F.col("day") == day) & (F.col("id") > last))
    assert [tuple(r) for r in paging.page_after(spark, path, order, after, 30).collect()] == whole[420:450]
    paging.build(df.where("false"), str(tmp_path / "e"), order)
    assert paging.page(spark, str(tmp_path / "e"), order, 0, 5).collect() == []


TEXTS = ["Refund for order 5531", "delivery LATE again", "ünïcode straße", "a", "", None, "100% off_sale", "zebra crossing"]


def test_indexed_search_skips_files_and_loses_nothing(spark, tmp_path):
    rows = [(i, TEXTS[i % 8] if i < 80 else f"plain text number {i} of many") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    table, index = str(tmp_path / "a table"), str(tmp_path / "index")
    df.repartitionByRange(10, "id").write.parquet(table)
    search_index.build(spark, table, index, ["text"])
    total = search_index.files(spark, index, "zebra")[1]
    assert total == 10
    for q in ("refund", "LATE AGAIN", "STRASSE", "straße", "zebra", "a", "%", "0% off_", "many", "nowhere at all", "number 399", " Zebra ", "", None, "of"):
        want = E.text_search(spark.read.parquet(table), q, ["text"])
        assert sorted(map(tuple, search_index.search(spark, table, index, q, ["text"]).collect())) == sorted(map(tuple, want.collect())), q
    for pattern in ("zebra", "order \\d+", "Late", "z.bra", "number 39", None):
        want = E.keyword_filter(spark.read.parquet(table), pattern, "text")
        assert sorted(map(tuple, search_index.keyword(spark, table, index, pattern, "text").collect())) == sorted(map(tuple, want.collect())), pattern
    assert len(search_index.files(spark, index, "zebra")[0]) <= 3 and search_index.files(spark, index, "nowhere at all")[0] == []
    assert len(search_index.files(spark, index, "number 399")[0]) == 1
    plan = search_index.search(spark, table, index, "zebra", ["text"]).inputFiles()
    assert len(plan) <= 3


def test_index_of_a_partitioned_table_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta", None, "2024-01-05"), (2, None, "gamma", "2024-01-06"), (3, None, None, "a b:c")], "id long, text string, fulltext string, day string")
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    df.write.partitionBy("day").parquet(table)
    search_index.build(spark, table, index, ["text", "fulltext"])
    assert [tuple(r) for r in search_index.search(spark, table, index, "GAMMA", ["text", "fulltext"]).select("id", "day").collect()] == [(2, "2024-01-06")]
    assert search_index.files(spark, index, "alpha")[1] == 3
    spark.createDataFrame([], "id long, text string").write.parquet(str(tmp_path / "none"))
    search_index.build(spark, str(tmp_path / "none"), str(tmp_path / "ni"), ["text"])
    assert search_index.search(spark, str(tmp_path / "none"), str(tmp_path / "ni"), "alpha", ["text"]).collect() == []


def test_index_of_long_texts_and_of_short_words_of_many_bytes(spark, tmp_path):
    """Each trigram of a long text was a substring counted from its beginning, which took quadratic time."""
    words = ["lorem%d" % (i * 7919 % 10007) for i in range(150_000)]
    rows = [(0, " ".join(words)), (1, "東京 station"), (2, "x" * 40_000 + "Needle"), (3, None)]
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.createDataFrame(rows, "id long, text string").repartitionByRange(4, "id").write.parquet(table)
    begun = time.monotonic()
    search_index.build(spark, table, index, ["text"])
    assert time.monotonic() - begun < 60
    for q, want in (("東京", [1]), ("needle", [2]), ("lorem9999 ", [0]), ("xn", [2]), ("nostation", [])):
        assert [r["id"] for r in search_index.search(spark, table, index, q, ["text"]).collect()] == want, q
    assert len(search_index.files(spark, index, "東京")[0]) == 1
    # no trigram spans two texts
    batch = pa.array([b"ab", b"cd", None, b"", b"wxyz", b"e"] * 20_000, pa.binary())
    grams = {int(g) for part in search_index._grams(batch.slice(1)) for g in part}
    assert grams == {int.from_bytes(b"wxy", "big"), int.from_bytes(b"xyz", "big")}


def test_ranges_share_tasks_and_folders(spark, tmp_path):
    """each range was a task and a folder of its own, all of which the driver heard of."""
    df = spark.range(30_000).select("id", (F.col("id") * 7919 % 30_000).alias("x")).repartition(5)
    path, order = str(tmp_path / "p"), [F.col("x").desc()]
    paging.build(df, path, order, rows_per_range=50)
    folders = list((tmp_path / "p" / "rows").glob("v-*/_part=*"))
    assert 1 <= len(folders) <= 4 and published.read(spark, f"{path}/sizes").count() >= 600
    for offset, limit in ((0, 10), (9_990, 120), (29_970, 50)):
        assert [r["x"] for r in paging.page(spark, path, order, offset, limit).collect()] == [29_999 - i for i in range(offset, min(offset + limit, 30_000))]
    assert len(paging.touched(spark, path, 12_345, 40)[2]) <= 3


def test_a_cleaned_text_that_is_the_text_is_stored_once(spark, tmp_path):
    """each stage stored every text twice, and by a codec that leaves it half as large again."""
    import os

    texts = spark.range(0, 300, 1, 1).select("id", F.lit("2024-01-06").cast("date").alias("date"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), " ").alias("text"))
    odd = texts.select("id", "date", F.when(F.col("id") % 7 > 0, F.col("text")).alias("text"))
    rows = odd.select(F.when(F.col("id") % 5 > 0, F.col("text")).when(F.col("id") % 10 > 0, F.lit("clean")).alias("clean_tweet"), "*")
    path = A.write_stage(rows, str(tmp_path / "s"))
    back = A.read_stage(spark, path)
    assert set(back.columns) == set(rows.columns) and all("__same" not in c for c in back.columns)
    assert back.select(rows.columns).exceptAll(rows).isEmpty() and rows.exceptAll(back.select(rows.columns)).isEmpty()
    size = sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(path) for n in names)
    rows.write.partitionBy("date").parquet(str(tmp_path / "plain"))
    plain = sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(tmp_path / "plain") for n in names)
    assert size < 0.6 * plain
