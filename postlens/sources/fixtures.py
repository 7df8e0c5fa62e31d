"""Posts built from the driver's tables (FIXTURES.md §2).

``posts`` turns every ``events`` row into one post: the event time is the post
time, the event type stands in for the sentiment label, and deterministic
arithmetic on the id gives the five aspect scores.  The text comes from
``documents`` (document ``event_id mod n_docs``).  Each Spark builder has a
DuckDB twin (``*_SQL``) used by the oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import dominant_aspect

# FIXED VALUES — multipliers of the synthetic aspect scores
ASPECT_MULTIPLIERS = {"pricing": 7, "delivery": 13, "returns": 29, "staff": 37, "app_ux": 53}
N_THEMES = 12


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sentiment_from_event(c):
    return (
        F.when(c.isin("purchase", "signup"), F.lit("positive"))
        .when(c == "error", F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def posts(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """One post per event; ``with_text=False`` skips the documents join for
    queries that never read the text (every event has exactly one document,
    so both forms have the same rows)."""
    ev = read_table(spark, sf_dir, "events")
    scores = {
        f"aspect_{k}": ((F.col("event_id") * m) % 100) / F.lit(100.0) for k, m in ASPECT_MULTIPLIERS.items()
    }
    base = ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("createdat"),
        F.to_date("ts").alias("date"),
        "user_id",
        _sentiment_from_event(F.col("event_type")).alias("sentiment_label"),
        (F.col("value") / F.lit(500.0)).alias("sentiment_score"),
        *[c.alias(n) for n, c in scores.items()],
        (F.col("event_id") % N_THEMES).cast("int").alias("theme"),
    )
    base = base.withColumn(
        "aspect_dominant", dominant_aspect({k: f"aspect_{k}" for k in ASPECT_MULTIPLIERS})
    )
    if not with_text:
        return base
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # row count from parquet footers; a scalar on the driver, not data
    n_docs = docs.count()
    joined = base.join(docs, (F.col("id") % F.lit(n_docs)) == F.col("doc_id"), "inner").drop("doc_id")
    return joined


def posts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the full export projection: url, three text columns
    (``text_clean`` null or empty on some rows), and the flag columns."""
    p = posts(spark, sf_dir, with_text=True)
    return p.select(
        "*",
        F.concat(F.lit("https://x.com/i/status/"), F.col("id").cast("string")).alias("twitterurl"),
        F.when(F.col("id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("id") % 5 == 1, F.lit(""))
        .otherwise(F.col("text"))
        .alias("text_clean"),
        F.col("text").alias("fulltext"),
        F.col("text").contains("http").alias("has_url"),
        F.col("text").contains("#").alias("has_hashtag"),
    )


_SENT_SQL = (
    "case when e.event_type in ('purchase','signup') then 'positive' "
    "when e.event_type = 'error' then 'negative' else 'neutral' end"
)
_SCORES_SQL = ",\n  ".join(
    f"((e.event_id*{m}) % 100)/100.0e0 as aspect_{k}" for k, m in ASPECT_MULTIPLIERS.items()
)
_TOP_SQL = "greatest(" + ", ".join(f"aspect_{k}" for k in ASPECT_MULTIPLIERS) + ")"
_DOM_SQL = (
    f"case when {_TOP_SQL} < {W.ASPECT_THRESHOLD} then '{W.ASPECT_FALLBACK}' "
    + " ".join(f"when aspect_{k} = {_TOP_SQL} then '{k}'" for k in ASPECT_MULTIPLIERS)
    + " end"
)

POSTS_BASE_SQL = f"""
select *, {_DOM_SQL} as aspect_dominant from (
select e.event_id as id, e.ts as createdat, cast(e.ts as date) as date, e.user_id,
  {_SENT_SQL} as sentiment_label,
  e.value/500.0e0 as sentiment_score,
  {_SCORES_SQL},
  cast(e.event_id % {N_THEMES} as integer) as theme
from events e) b
"""

POSTS_SQL = f"""
select b.*, d.text, d.lang from ({POSTS_BASE_SQL}) b
join documents d on d.doc_id = b.id % (select count(*) from documents)
"""

POSTS_WIDE_SQL = f"""
select p.*, 'https://x.com/i/status/' || cast(p.id as varchar) as twitterurl,
  case when p.id % 5 = 0 then null when p.id % 5 = 1 then '' else p.text end as text_clean,
  p.text as fulltext,
  contains(p.text, 'http') as has_url,
  contains(p.text, '#') as has_hashtag
from ({POSTS_SQL}) p
"""


def with_posts(sql: str, text: bool = False, wide: bool = False) -> str:
    """Prefix an oracle query with the ``posts`` CTE (merged into the query's
    own ``WITH`` list when it has one)."""
    body = POSTS_WIDE_SQL if wide else (POSTS_SQL if text else POSTS_BASE_SQL)
    stripped = sql.lstrip()
    if stripped[:5].lower() == "with ":
        return f"with posts as ({body}),\n{stripped[5:]}"
    return f"with posts as ({body})\n{sql}"


# FIXED VALUES — aspect spellings cycled through by the messy variant
MESSY_ASPECTS = ["none", "", " Unspecified ", "App/UX", "app_ux", None, "Store Staff", "delivery"]


def messy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a messily typed post: date strings in four layouts (one
    unparseable), epoch seconds and milliseconds, null / upper-case labels,
    aspect spellings, and a ``text_clean`` that is null or empty on some rows.
    A projection: no event is dropped."""
    ev = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    fmt = (F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(i % 4 == 1, F.date_format("ts", "MMM-dd-yyyy"))
           .when(i % 4 == 2, F.date_format("ts", "MM/dd/yyyy"))
           .otherwise(F.lit("abc")))
    label = _sentiment_from_event(F.col("event_type"))
    label = F.when(i % 17 == 0, F.lit(None).cast("string")).when(i % 19 == 0, F.upper(label)).otherwise(label)
    asp = F.element_at(F.array(*[F.lit(a) for a in MESSY_ASPECTS]), (i % len(MESSY_ASPECTS) + 1).cast("int"))
    return ev.select(
        i.alias("id"),
        fmt.alias("created_at"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("created_epoch"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("created_ms"),
        F.col("ts"),
        label.alias("sentiment_label"),
        asp.alias("aspect_dominant"),
        F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, F.lit(""))
        .otherwise(F.col("props")).alias("text_clean"),
        F.col("props").alias("fulltext"),
    )


def _messy_aspects_sql() -> str:
    vals = ", ".join("null" if a is None else "'" + a + "'" for a in MESSY_ASPECTS)
    return f"[{vals}][(event_id % {len(MESSY_ASPECTS)}) + 1]"


MESSY_SQL = f"""
select event_id as id,
  case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%b-%d-%Y')
       when 2 then strftime(ts, '%m/%d/%Y') else 'abc' end as created_at,
  date_diff('second', timestamp '1970-01-01 00:00:00', ts) as created_epoch,
  date_diff('millisecond', timestamp '1970-01-01 00:00:00', ts) as created_ms,
  ts,
  case when event_id % 17 = 0 then null when event_id % 19 = 0 then upper({_SENT_SQL.replace('e.', '')})
       else {_SENT_SQL.replace('e.', '')} end as sentiment_label,
  {_messy_aspects_sql()} as aspect_dominant,
  case when event_id % 3 = 0 then null when event_id % 3 = 1 then '' else props end as text_clean,
  props as fulltext
from events
"""


def with_messy(sql: str) -> str:
    stripped = sql.lstrip()
    if stripped[:5].lower() == "with ":
        return f"with messy as ({MESSY_SQL}),\n{stripped[5:]}"
    return f"with messy as ({MESSY_SQL})\n{sql}"
