"""Registered queries on stored structures: rollups by day, pages, search indexes
(E4, E5, F12, H8).  Each builds its structure from the given tables in the shared
folder, then asks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import metrics as M
from postlens.operators import paging, rollups, search_index
from postlens.operators.keywords import text_partitions
from postlens.plans.q_metrics import _SPLIT_BUCKET, _VOCAB
from postlens.plans.registry import register
from postlens.plans.sqlbits import aspect_split_sql
from postlens.session import scratch_path
from postlens.sources.fixtures import posts, read_table, with_posts

START, END = "2024-01-05", "2024-01-20"


@register("rollup_incremental", "F12,F10", with_posts(
    "with " + aspect_split_sql(_SPLIT_BUCKET, _VOCAB + ["others"], 2).replace(
        "from posts group by 1", f"from posts where date >= date '{START}' and date <= date '{END}' group by 1")))
def q_rollup_incremental(spark, d):
    """The split of a window from a rollup that got its posts in batches: the first days, the days after, posts that came
    late for either (twice, as a run that was repeated), and after all were rolled up into one, the rest."""
    p = posts(spark, d, with_text=False)
    path = scratch_path(spark, "rollup")
    late, last = F.col("id") % 7 == 3, F.col("id") % 11 == 5
    first = F.col("date") <= "2024-01-12"
    rollups.rebuild(p.where(first & ~late & ~last), path)
    rollups.add_batch(p.where(~first & ~late & ~last), path, "after")
    for _ in range(2):
        rollups.add_batch(p.where(late & ~last), path, "late")
    rollups.compact(spark, path)
    rollups.add_batch(p.where(last), path, "last")
    return M.aspect_split_from_rollup(rollups.rollup(spark, path, START, END), include_others=True)


@register("posts_page", "H8,H3", with_posts("""
select id, createdat, sentiment_label from posts order by createdat desc, id limit 40 offset 1500
"""))
def q_posts_page(spark, d):
    """Rows 1501 to 1540 of all posts, newest first."""
    path = scratch_path(spark, "pages")
    order = [F.col("createdat").desc(), F.col("id")]
    paging.build(posts(spark, d, with_text=False).select("id", "createdat", "sentiment_label"), path, order, rows_per_range=500)
    return paging.page(spark, path, order, 1500, 40)


def _indexed(spark, d) -> tuple[str, str]:
    """The documents as a table of several files, each of neighbouring ids, and its index.  Files hold some
    ``TEXT_BYTES`` of text, so that filters stay sparse and tasks small however many documents there are."""
    table, index = scratch_path(spark, "documents"), scratch_path(spark, "trigrams")
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    docs.repartitionByRange(max(16, text_partitions(docs, "text")), "doc_id").write.parquet(table)
    search_index.build(spark, table, index, ["text"])
    return table, index


@register("indexed_text_search", "E5", "select doc_id from documents where contains(lower(text), 'license')")
def q_indexed_search(spark, d):
    return search_index.search(spark, *_indexed(spark, d), " License ", ["text"]).select("doc_id")


@register("indexed_keyword_filter", "E4", "select doc_id from documents where regexp_matches(coalesce(text, ''), '(?i)released under')")
def q_indexed_keyword(spark, d):
    return search_index.keyword(spark, *_indexed(spark, d), "RELEASED under", "text").select("doc_id")
