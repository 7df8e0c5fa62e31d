"""Plans and rules that matter at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlens import session
from postlens.operators import sampling as H
from postlens.operators.themes import mmr_order
from postlens.sources import files as A


def test_checkpoint_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class None_:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("SC", (), {"getCheckpointDir": lambda self: None_()})()

    fake = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_first_n_of_a_large_group(spark):
    df = spark.range(5000).select(F.col("id"), F.lit("g").alias("g"), (F.col("id") * 7919 % 5000).alias("createdat"))
    for n in (10, 1500):
        rows = H.first_n_per_group(df, "g", n).select("createdat", "_rn").collect()
        assert sorted((r["createdat"], r["_rn"]) for r in rows) == [(i, i + 1) for i in range(n)]


def test_numbering_of_all_rows(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x")).repartition(7)
    rows = H.numbered(df, [F.col("x").desc()], "n").collect()
    assert sorted((r["n"], r["x"]) for r in rows) == [(i + 1, 2999 - i) for i in range(3000)]


def test_limits_of_callers_are_kept(spark):
    df = spark.range(2500).select("id", F.lit("2024-01-05 00:00:00").cast("timestamp").alias("createdat"), F.lit(3).alias("theme"), F.lit("t").alias("text"))
    assert H.theme_posts(df, 3, limit=1500, fields=["id"]).count() == 1500


def test_mmr_by_bounds_equals_the_plain_walk():
    import random

    def plain(sizes, cos, n, lam):
        largest, order, left = max(sizes.values(), default=0) or 1, [], set(sizes)
        while left and len(order) < n:
            best = max(left, key=lambda i: (lam * sizes[i] / largest - (1 - lam) * max([0.0, *(cos.get((i, t), 0.0) for t in order)]), sizes[i], -i))
            left.remove(best)
            order.append(best)
        return order

    rand = random.Random(6)
    for _ in range(200):
        k = rand.randint(0, 60)
        sizes = {i: rand.randint(0, 30) for i in rand.sample(range(100), k)}
        cos = {}
        for a in sizes:
            for b in sizes:
                if a < b and rand.random() < 0.5:
                    cos[a, b] = cos[b, a] = rand.choice([-0.2, 0.1, 0.5, rand.random()])
        asked = set()

        def lookup(left, right):
            asked.update((a, b) for a in left for b in right)
            return {(a, b): cos[a, b] for a in left for b in right if (a, b) in cos}

        n, lam = rand.randint(0, 20), rand.choice([0.3, 0.65, 1.0])
        want = plain(sizes, cos, n, lam)
        assert mmr_order(sizes, cos, n, lam) == mmr_order(sizes, lookup, n, lam, block=rand.randint(1, 5)) == want
    # a long tail of small themes is not looked up
    sizes = {i: 10**6 - i * 900 for i in range(1000)}
    asked.clear()
    cos = {}
    assert mmr_order(sizes, lookup, 10, block=4) == list(range(10)) and len(asked) < 500


def test_mmr_asks_for_cosines_when_there_are_many_themes(spark, monkeypatch):
    from postlens.operators import themes as J

    rows = [(i, i % 6, f"{'alpha beta' if i % 6 < 3 else 'gamma delta'} word{i % 6} " * (1 + i % 3)) for i in range(120)]
    posts = spark.createDataFrame(rows, "id long, theme int, text string")
    themes = spark.createDataFrame([(i, 60 - i) for i in range(6)], "id int, tweet_count int")
    whole = [tuple(r) for r in J.mmr_select(themes, posts, 5).collect()]
    monkeypatch.setattr(J, "PAIRS", 0)
    assert [tuple(r) for r in J.mmr_select(themes, posts, 5).collect()] == whole and len(whole) == 5


def test_mmr_takes_ties_by_size_then_id():
    assert mmr_order({3: 10, 1: 10, 2: 5}, {}, 3) == [1, 3, 2]
    assert mmr_order({}, {}, 3) == [] and mmr_order({4: 0, 2: 0}, {}, 1) == [2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows_move_once(spark):
    """after the ranges are written, only their sizes are shuffled; rows were dealt a second time by range."""
    df = spark.range(0, 3000, 1, 6).select("id", (F.col("id") % 7).alias("x"), F.repeat(F.lit("text "), 20).alias("text"))
    rows = H.numbered(df, [F.col("x").desc(), F.col("id")], "n")
    plan = _plan(rows)
    assert plan.count("Window") == 1 and "SortMergeJoin" not in plan
    want = sorted(((6 - i % 7, i) for i in range(3000)))
    assert [(r["id"], r["n"]) for r in rows.orderBy("n").collect()] == [(i, k + 1) for k, (_, i) in enumerate(want)]
    assert rows.columns == ["id", "x", "text", "n"] and H.numbered(df.where("false"), [F.col("id")], "n").count() == 0


def test_fixed_export_moves_a_text_once(spark):
    """the sort carried a post's text in each of its forms."""
    day = dt.datetime(2024, 1, 5)
    forms = [("a", "a", "a"), (None, "b", "b"), ("", "c", "C"), ("x", None, None), ("p", "q", "r"), (None, None, "")]
    rows = [(i, "u", *f, "positive", 0.5, "none", day + dt.timedelta(days=i)) for i, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "id long, twitterurl string, text_clean string, text string, fulltext string, sentiment_label string, "
                                     "sentiment_score double, aspect_dominant string, createdat timestamp_ntz")
    out = A.fixed_export(df)
    assert out.columns == [h for _, h in A.FIXED_EXPORT]
    assert [tuple(r)[2:5] for r in out.collect()] == [tuple(x or "" for x in f) for f in reversed(forms)]
    assert "array_distinct" in _plan(out).split("Exchange")[1]


def test_moved_texts_are_packed(spark):
    """the sort moved texts as they are; strings come back as they were, nulls and broken ones too."""
    from postlens.operators import packing as P

    day = dt.datetime(2024, 1, 5)
    df = spark.createDataFrame([(i, f"form {i} " * 40, None if i % 2 else "é😀") for i in range(20)], "id long, text string, fulltext string")
    df = df.unionByName(df.limit(1).select("id", F.expr("cast(x'61FF62' as string)").alias("text"), F.lit("").alias("fulltext")))
    packed = P.pack_columns(df, ["text", "fulltext"], "_p")
    assert packed.columns == ["id", "_p"] and packed.where(F.length("_p") > 120).count() == 0
    back = P.unpack_columns(packed, ["text", "fulltext"], "_p")
    same = [F.col(c).cast("binary") for c in ("text", "fulltext")]
    assert back.schema == df.schema or back.columns == df.columns
    assert sorted(back.select("id", *same).collect(), key=repr) == sorted(df.select("id", *same).collect(), key=repr)
    wide = df.select("id", F.lit("u").alias("twitterurl"), F.lit("").alias("text_clean"), "text", "fulltext", F.lit("x").alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"),
                     F.lit("none").alias("aspect_dominant"), F.lit(day).alias("createdat"))
    moved = _plan(A.fixed_export(wide)).split("Exchange rangepartitioning")[0]
    assert "_unpack" in moved and "_pack(" not in moved


def test_numbered_rows_are_stored_once(spark, monkeypatch):
    """rows were in shuffle files and, sorted, in a table of the shared folder; they are only in shuffle files, packed."""
    monkeypatch.setattr(session, "scratch_path", lambda *a: (_ for _ in ()).throw(AssertionError("stored")))
    df = spark.range(0, 3000, 1, 6).select("id", (F.col("id") * 7919 % 3000).alias("x"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("text "), 20)).alias("text"))
    rows = H.numbered(df, [F.col("x").desc()], "n", ["text"])
    assert "FileScan" not in _plan(rows) and rows.columns == ["id", "x", "text", "n"]
    want = {(r["id"], r["x"], r["text"], 3000 - r["x"]) for r in df.collect()}
    assert set(map(tuple, rows.collect())) == want and set(map(tuple, rows.unionByName(rows).coalesce(1).collect())) == want
