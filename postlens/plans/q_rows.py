"""Registered row-level queries: cleaning (B), filters (E), sampling (H),
joins (G), reports (R) and sources (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import dates as D
from postlens.functions.columns import (aspect_api_key, aspect_display, aspect_stored, first_non_empty,
                                        pretty_label, serialize_rows)
from postlens.operators import cleaning as B
from postlens.operators import filters as E
from postlens.operators import joins as G
from postlens.operators import metrics as M
from postlens.operators import reports as R
from postlens.operators import sampling as H
from postlens.plans.registry import register
from postlens.plans.sqlbits import ADISP, AKEY, SKEY, pct
from postlens.session import scratch_path
from postlens.sources import files as A
from postlens.sources.fixtures import ASPECT_MULTIPLIERS, messy_posts, posts, posts_wide, read_table, with_messy, with_posts

START, END, DAY = "2024-01-05", "2024-01-20", "2024-01-10"


def _east(x: str) -> str:
    return f"((({x}) AT TIME ZONE 'UTC') AT TIME ZONE 'US/Eastern')"


_PARSE = ("coalesce(try_strptime(created_at, '%Y-%m-%d %H:%M:%S'), try_strptime(created_at, '%b-%d-%Y'), "
          "try_strptime(created_at, '%m/%d/%Y'))")


def _p(spark, d):
    return posts(spark, d, with_text=False)


# ---------------------------------------------------------------------------
# B: cleaning and typing
# ---------------------------------------------------------------------------
@register("parse_date_strings", "B1,B4", with_messy(f"""
select id, {_east(_PARSE)} as created_at, cast({_east(_PARSE)} as date) as date from messy
"""))
def q_parse_strings(spark, d):
    return B.parse_date_column(messy_posts(spark, d), "created_at").select("id", "created_at", "date")


@register("detect_date_column", "B2", with_messy(f"""
select id, {_east(_PARSE)} as created_at, cast({_east(_PARSE)} as date) as date from messy
"""))
def q_detect(spark, d):
    m = messy_posts(spark, d).select("id", "created_at", "sentiment_label")
    return B.basic_date_parse(m).select("id", "created_at", "date")


@register("parse_epoch_millis", "B3", with_messy(f"""
select id, {_east('epoch_ms(created_ms)')} as created_ms, cast({_east('epoch_ms(created_ms)')} as date) as date
from messy
"""))
def q_epoch_ms(spark, d):
    return B.parse_date_column(messy_posts(spark, d), "created_ms").select("id", "created_ms", "date")


@register("parse_epoch_seconds", "B3", with_messy(f"""
select id, {_east('make_timestamp(created_epoch * 1000000)')} as created_epoch,
  cast({_east('make_timestamp(created_epoch * 1000000)')} as date) as date from messy
"""))
def q_epoch_s(spark, d):
    return B.parse_date_column(messy_posts(spark, d), "created_epoch").select("id", "created_epoch", "date")


@register("standardize_columns", "B5,B6", with_messy("""
select coalesce(text_clean, '') as clean_tweet, 'en' as lang, false as has_url, false as has_mention,
  false as has_hashtag, id, sentiment_label, text_clean from messy
"""))
def q_standardize(spark, d):
    m = messy_posts(spark, d).select("id", "sentiment_label", "text_clean")
    return B.standardize_columns(m)


@register("normalize_dates", "B7", with_messy(f"""
select id, {_PARSE} as created_at, cast({_PARSE} as date) as date_only from messy where {_PARSE} is not null
"""))
def q_normalize_dates(spark, d):
    return B.normalize_dates(messy_posts(spark, d).select("id", "created_at"), "created_at")


@register("ensure_llm_columns", "B8,B9", with_posts("""
select id, cast(date as timestamp) as date, sentiment_label, '' as text, -1 as topic_id, '' as topic_keywords
from posts
"""))
def q_ensure(spark, d):
    p = _p(spark, d).select("id", "date", "sentiment_label")
    return B.ensure_topics(B.ensure_llm_columns(p))


@register("drop_duplicate_posts", "B10", with_posts("""
select id, createdat, sentiment_label, theme from posts
"""))
def q_dedupe(spark, d):
    p = _p(spark, d).select("id", "createdat", "sentiment_label", "theme")
    later = p.select("id", (F.col("createdat") + F.expr("INTERVAL 1 HOUR")).alias("createdat"),
                     F.lit("neutral").alias("sentiment_label"), "theme")
    return B.drop_duplicate_posts(p.unionByName(later))


@register("aspect_keys", "B11,B12,B13", with_messy(f"""
select id, {ADISP} as display,
  case when trim(aspect_dominant) is null or trim(aspect_dominant) = '' then null
       when lower(trim(aspect_dominant)) = 'other' then 'none'
       else replace(regexp_replace(lower(trim(aspect_dominant)), '\\s+', '_', 'g'), '/', '_') end as stored,
  {AKEY} as api_key from messy
"""))
def q_aspect_keys(spark, d):
    m = messy_posts(spark, d)
    a = F.col("aspect_dominant")
    return m.select("id", aspect_display(a).alias("display"), aspect_stored(a).alias("stored"),
                    aspect_api_key(a).alias("api_key"))


@register("date_params", "B14", with_messy("""
select id, case when regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2}') then created_at
  when regexp_full_match(created_at, '\\d{2}/\\d{2}/\\d{4}')
    then regexp_replace(created_at, '^(\\d{2})/(\\d{2})/(\\d{4})$', '\\3-\\1-\\2') else created_at end as param
from messy
"""))
def q_date_params(spark, d):
    return messy_posts(spark, d).select("id", D.normalize_date_param(F.col("created_at")).alias("param"))


@register("serialize_rows", "B15", with_posts(f"""
select cast(id as varchar) as id, strftime(createdat, '%Y-%m-%d') as createdat, strftime(date, '%Y-%m-%d') as date,
  {ADISP} as aspect_dominant, sentiment_score from posts
"""))
def q_serialize(spark, d):
    return serialize_rows(_p(spark, d).select("id", "createdat", "date", "aspect_dominant", "sentiment_score"))


@register("first_text", "B16,B17", with_posts("""
select id, coalesce(nullif(text_clean, ''), nullif(text, ''), nullif(fulltext, ''), '') as text,
  coalesce(nullif(twitterurl, ''), '') as url, coalesce(nullif(twitterurl, ''), '') as twitterurl from posts
""", wide=True))
def q_first_text(spark, d):
    w = posts_wide(spark, d)
    url = first_non_empty("twitterurl")
    return w.select("id", first_non_empty("text_clean", "text", "fulltext").alias("text"), url.alias("url"),
                    url.alias("twitterurl"))


@register("pretty_labels", "B18", with_messy(f"""
select distinct {ADISP} as aspect,
  upper(substr({ADISP}, 1, 1)) || replace(substr({ADISP}, 2), '_', ' ') as label from messy
"""))
def q_pretty(spark, d):
    m = messy_posts(spark, d).select(aspect_display(F.col("aspect_dominant")).alias("aspect")).distinct()
    return m.select("aspect", pretty_label(F.col("aspect")).alias("label"))


@register("trend_labels", "B19,B20", with_posts("""
select distinct strftime(cast(date_trunc('week', date) as date), '%Y-%m-%d') as date,
  'Week ' || strftime(cast(date_trunc('week', date) as date), '%b %-d') as label from posts
"""))
def q_trend_labels(spark, d):
    t = M.sentiment_trend(_p(spark, d), "weekly")
    return t.select(D.iso_or_empty(F.col("date")).alias("date"), D.period_label(F.col("date"), "weekly").alias("label"))


@register("iso_or_empty", "B20", with_messy(f"""
select id, coalesce(strftime(cast({_PARSE} as date), '%Y-%m-%d'), '') as day from messy
"""))
def q_iso_or_empty(spark, d):
    m = messy_posts(spark, d).select("id", D.parse_string_timestamp(F.col("created_at"), "UTC").alias("t"))
    return m.select("id", D.iso_or_empty(F.col("t")).alias("day"))


# ---------------------------------------------------------------------------
# E: filters
# ---------------------------------------------------------------------------
@register("timestamp_window", "E3", with_posts(f"""
select id, createdat from posts where createdat >= timestamp '{START}' and createdat < timestamp '{END}' + interval 1 day
"""))
def q_ts_window(spark, d):
    return E.timestamp_window(_p(spark, d), START, END).select("id", "createdat")


@register("keyword_filter", "E4", with_posts("""
select id from posts where regexp_matches(coalesce(text, ''), '(?i)ment')
""", text=True))
def q_keyword(spark, d):
    return E.keyword_filter(posts(spark, d), "MENT", "text").select("id")


@register("text_search", "E5", with_posts("""
select id from posts where contains(lower(text_clean), 'the o') or contains(lower(text), 'the o')
  or contains(lower(fulltext), 'the o')
""", wide=True))
def q_search(spark, d):
    return E.text_search(posts_wide(spark, d), "The O").select("id")


@register("theme_aspect_filters", "E6,E7", with_posts("""
select id from posts where theme = 3 and lower(aspect_dominant) = 'delivery' and lower(sentiment_label) = 'negative'
"""))
def q_theme_aspect(spark, d):
    return E.aspect_sentiment_equals(E.theme_equals(_p(spark, d), 3), "Delivery", "NEGATIVE").select("id")


# ---------------------------------------------------------------------------
# H: sort / limit / sample
# ---------------------------------------------------------------------------
_H1_COLS = ["id", "twitterurl", "text_clean", "text", "fulltext", "sentiment_label", "sentiment_score",
            "aspect_pricing", "aspect_delivery", "aspect_returns", "aspect_staff", "aspect_app_ux", "aspect_dominant",
            "createdat", "lang", "has_url", "has_hashtag"]


@register("theme_posts", "H1,E9,B15", with_posts(f"""
select cast(id as varchar) as id, twitterurl, text_clean, text, fulltext, sentiment_label, sentiment_score,
  aspect_pricing, aspect_delivery, aspect_returns, aspect_staff, aspect_app_ux, {ADISP} as aspect_dominant,
  strftime(createdat, '%Y-%m-%d') as createdat, lang, has_url, has_hashtag
from posts where theme = 3 order by posts.createdat desc, posts.id limit 20
""", wide=True))
def q_theme_posts(spark, d):
    return H.theme_posts(posts_wide(spark, d), 3, limit=20)


@register("sample_posts", "H2,E7", with_posts("""
with f as (select id, createdat, text from posts where lower(aspect_dominant) = 'delivery'
           and lower(sentiment_label) = 'negative' and text is not null),
t as (select * from f order by createdat desc, id limit 100)
select t.*, (select count(*) from f) as total_available from t
""", text=True))
def q_sample_posts(spark, d):
    return H.sample_posts(posts(spark, d), "delivery", "negative", limit=100)


@register("newest_rows", "H3", with_posts("select id, createdat from posts order by createdat desc, id limit 500"))
def q_newest(spark, d):
    return H.newest_rows(_p(spark, d), 500).select("id", "createdat")


@register("seeded_sample", "H4", with_posts("""
select id from posts order by md5('42|' || cast(id as varchar)), id limit 50
"""))
def q_seeded(spark, d):
    return H.seeded_sample(_p(spark, d), 50).select("id")


@register("balanced_sample", "H5", with_posts("""
with r as (select id, sentiment_label, row_number() over (partition by sentiment_label order by createdat, id) as pos
           from posts where sentiment_label in ('negative', 'positive', 'neutral'))
select id, sentiment_label, cast(pos as integer) as pos,
  cast(case sentiment_label when 'negative' then 1 when 'positive' then 2 else 3 end as integer) as label_order
from r where pos <= 250
"""))
def q_balanced(spark, d):
    return H.balanced_sample(_p(spark, d), 250).select("id", "sentiment_label", "pos", "label_order")


@register("first_posts_per_theme", "H6", with_posts("""
with r as (select theme, id, row_number() over (partition by theme order by id) as pos from posts)
select theme, id, cast(pos as integer) as pos from r where pos <= 3
"""))
def q_first_per_theme(spark, d):
    return H.first_n_per_theme(_p(spark, d), 3).select("theme", "id", "pos")


@register("top_users", "H7", with_posts("""
with g as (select user_id as value, count(*) as count from posts where user_id is not null group by 1),
t as (select * from g order by count desc, value limit 10)
select cast(row_number() over (order by count desc, value) as integer) as rank, value, count from t
"""))
def q_top_users(spark, d):
    return H.top_values(_p(spark, d), "user_id", 10)


@register("distinct_dates", "H10", with_posts("select distinct cast(createdat as date) as date from posts"))
def q_distinct_dates(spark, d):
    return H.distinct_dates(_p(spark, d))


@register("distinct_rows", "H11,A3", """
select distinct user_id, event_type from events
""")
def q_distinct_rows(spark, d):
    ev = read_table(spark, d, "events").select("user_id", "event_type")
    return A.default_extraction(H.distinct_rows(ev))


@register("capped_themes", "H14", with_posts("""
with g as (select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1)
select *, (select count(*) from g) as n_available from (select * from g order by tweet_count desc, id limit 8)
"""))
def q_capped(spark, d):
    return H.capped_themes(M.theme_sizes(_p(spark, d)), 8)


@register("aspect_export", "A9,H12", with_posts(f"""
with f as (select id, createdat, lower(sentiment_label) as l,
             coalesce(nullif(text_clean, ''), nullif(text, ''), nullif(fulltext, ''), '') as tweet_text
           from posts where lower(aspect_dominant) = 'delivery' and lower(sentiment_label) in ('positive', 'neutral', 'negative')),
r as (select *, row_number() over (partition by l order by createdat desc, id) as rn from f),
k as (select * from r)
select cast(row_number() over (order by case l when 'positive' then 1 when 'neutral' then 2 else 3 end, rn) as bigint)
  as tweet_no, tweet_text, 'delivery' as aspect, l as sentiment, '{START} to {END}' as date_range from k
""", wide=True).replace("from posts where lower(aspect_dominant)",
                        f"from posts where date >= date '{START}' and date <= date '{END}' and lower(aspect_dominant)"))
def q_aspect_export(spark, d):
    return H.aspect_export(posts_wide(spark, d), "delivery", START, END)


@register("aspects_export", "A9", lambda: with_posts(f"""
with f as (select id, createdat, lower(sentiment_label) as l, lower(aspect_dominant) as a,
             coalesce(nullif(text_clean, ''), nullif(text, ''), nullif(fulltext, ''), '') as tweet_text
           from posts where date >= date '{START}' and date <= date '{END}'),
k as (select *, list_position(['pricing', 'delivery', 'returns', 'staff', 'app_ux'], a) as ao,
        list_position(['positive', 'neutral', 'negative'], l) as lo from f)
select cast(row_number() over (order by ao, lo, createdat desc, id) as bigint) as tweet_no, tweet_text,
  a as aspect, l as sentiment, '{START} to {END}' as date_range from k where ao > 0 and lo > 0
""", wide=True))
def q_aspects_export(spark, d):
    """All aspects and labels in one export with one numbering."""
    return H.aspects_export(posts_wide(spark, d), list(ASPECT_MULTIPLIERS), START, END)


@register("aspect_sentiment_export", "A10", with_posts(f"""
with f as (select id, createdat, coalesce(nullif(text_clean, ''), nullif(text, ''), nullif(fulltext, ''), '') as tweet_text
           from posts where date >= date '{START}' and date <= date '{END}'
           and lower(aspect_dominant) = 'staff' and lower(sentiment_label) = 'positive'),
r as (select *, row_number() over (order by createdat desc, id) as rn from f)
select cast(rn as bigint) as tweet_no, tweet_text, 'staff' as aspect, 'positive' as sentiment,
  '{START} to {END}' as date_range from r
""", wide=True))
def q_aspect_sentiment_export(spark, d):
    return H.aspect_sentiment_export(posts_wide(spark, d), "staff", "positive", START, END)


# ---------------------------------------------------------------------------
# G: joins
# ---------------------------------------------------------------------------
@register("rows_not_in_sample", "G1,H4", with_posts("""
with s as (select id from posts order by md5('42|' || cast(id as varchar)), id limit 2500)
select id from posts where id not in (select id from s)
"""))
def q_not_in_sample(spark, d):
    p = _p(spark, d)
    return G.rows_not_in(p, H.seeded_sample(p, 2500)).select("id")


def _theme_names(p):
    """A small name table derived from the posts: the most frequent dominant
    aspect of each even theme (odd themes stay unnamed → defaults)."""
    from pyspark.sql import Window

    counts = p.groupBy("theme", "aspect_dominant").agg(F.count("*").alias("n"))
    rk = F.row_number().over(Window.partitionBy("theme").orderBy(F.col("n").desc(), "aspect_dominant"))
    top = counts.withColumn("rk", rk).where(F.col("rk") == 1).select("theme", F.col("aspect_dominant").alias("a"))
    return top.where(F.col("theme") % 2 == 0).select(
        F.col("theme").cast("int").alias("id"), F.concat(F.initcap("a"), F.lit(" Theme")).alias("name"),
        F.concat(F.lit("Posts mostly about "), F.col("a")).alias("summary"))


_NAMES_SQL = """
names as (select cast(theme as integer) as id, upper(substr(a, 1, 1)) || lower(substr(a, 2)) || ' Theme' as name,
            'Posts mostly about ' || a as summary
          from (select theme, aspect_dominant as a, row_number() over (partition by theme order by n desc, aspect_dominant) as rk
                from (select theme, aspect_dominant, count(*) as n from posts group by 1, 2))
          where rk = 1 and theme % 2 = 0)
"""


@register("theme_text_join", "G3,A8", with_posts(f"""
with {_NAMES_SQL},
g as (select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1)
select g.id, g.tweet_count, coalesce(nullif(n.name, ''), 'Theme ' || cast(g.id as varchar)) as name,
  coalesce(nullif(n.summary, ''), 'Analysis of ' || cast(g.tweet_count as varchar) || ' tweets in this theme') as summary
from g left join names n on g.id = n.id
"""))
def q_theme_text(spark, d):
    p = _p(spark, d)
    path = scratch_path(spark, "theme_sidecar")
    A.write_theme_sidecar(_theme_names(p), path)
    names = A.read_theme_sidecar(spark, path)
    return G.with_theme_text(M.theme_sizes(p), names)


@register("aspects_outside_vocabulary", "G4", with_posts(f"""
select id, {AKEY} as aspect from posts where {AKEY} not in ('pricing', 'delivery', 'returns', 'staff', 'app/ux')
"""))
def q_outside_vocab(spark, d):
    p = _p(spark, d).select("id", aspect_api_key(F.col("aspect_dominant")).alias("aspect"))
    return G.in_vocabulary(p, "aspect", ["pricing", "delivery", "returns", "staff", "app/ux"], keep=False)


# ---------------------------------------------------------------------------
# R: reports
# ---------------------------------------------------------------------------
@register("report_sentiment_summary", "R1", with_posts(f"""
with c as (select count(*) as total, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'negative', 'neutral'))}
           from posts where date >= date '{START}' and date <= date '{END}')
select 'Total Tweets' as metric, total as value, null::double as percent from c
union all select 'Positive', positive, {pct('positive', 'total', 1)} from c
union all select 'Negative', negative, {pct('negative', 'total', 1)} from c
union all select 'Neutral', neutral, {pct('neutral', 'total', 1)} from c
"""))
def q_report_summary(spark, d):
    return R.sentiment_report_summary(_p(spark, d), START, END)


@register("report_sentiment_daily", "R2", with_posts(f"""
select cast(createdat as date) as date, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'negative', 'neutral'))},
  count_if({SKEY} in ('positive', 'negative', 'neutral')) as total from posts group by 1
"""))
def q_report_daily(spark, d):
    return R.sentiment_report_daily(_p(spark, d))


_ASPECT_REPORT = f"""
g as (select {ADISP} as aspect, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'neutral', 'negative'))}
      from posts where date >= date '{START}' and date <= date '{END}' group by 1),
t as (select aspect, positive, negative, neutral, positive + neutral + negative as total from g where aspect <> 'Other')
"""


@register("report_aspects", "R3", with_posts(f"""
with {_ASPECT_REPORT}
select *, {pct('positive', 'total', 1)} as positive_pct, {pct('neutral', 'total', 1)} as neutral_pct,
  {pct('negative', 'total', 1)} as negative_pct from t
"""))
def q_report_aspects(spark, d):
    return R.aspect_report(_p(spark, d), START, END)


@register("report_themes", "R4,G3", with_posts(f"""
with {_NAMES_SQL},
g as (select cast(theme as integer) as id, count(*) as tweet_count from posts
      where date >= date '{START}' and date <= date '{END}' group by 1)
select g.id, coalesce(nullif(n.name, ''), 'Theme ' || cast(g.id as varchar)) as name, g.tweet_count,
  coalesce(nullif(n.summary, ''), 'Analysis of ' || cast(g.tweet_count as varchar) || ' tweets in this theme') as summary
from g left join names n on g.id = n.id
"""))
def q_report_themes(spark, d):
    p = _p(spark, d)
    return R.theme_report(p, _theme_names(p), START, END)


@register("report_dashboard_daily", "R5", with_posts(f"""
with g as (select cast(createdat as date) as date, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'negative', 'neutral'))}
           from posts group by 1)
select date, positive, negative, neutral, positive + negative + neutral as total
from (select * from g order by date desc limit 20)
"""))
def q_report_dash_daily(spark, d):
    return R.dashboard_daily(_p(spark, d), days=20)


@register("report_dashboard_aspects", "R5", with_posts(f"""
with {_ASPECT_REPORT.replace(f"where date >= date '{START}' and date <= date '{END}' ", "")},
x as (select *, {pct('positive', 'total', 1)} as positive_pct, {pct('neutral', 'total', 1)} as neutral_pct,
  {pct('negative', 'total', 1)} as negative_pct from t order by total desc, aspect limit 12)
select *, cast(row_number() over (order by total desc, aspect) as integer) as rank from x
"""))
def q_report_dash_aspects(spark, d):
    return R.dashboard_aspects(_p(spark, d), top=12)


# ---------------------------------------------------------------------------
# A: sources and sinks
# ---------------------------------------------------------------------------
@register("csv_roundtrip", "A1,A4,A6", with_posts(f"""
select strftime(date, '%Y-%m-%d') as date, strftime(createdat, '%Y-%m-%d %H:%M:%S') as createdat,
  sentiment_label, aspect_dominant, user_id from posts
"""))
def q_csv_roundtrip(spark, d):
    p = _p(spark, d)
    path = scratch_path(spark, "raw_export.csv")
    exp = A.raw_export(p).select(F.date_format("date", "yyyy-MM-dd").alias("date"),
                                 F.date_format("createdat", "yyyy-MM-dd HH:mm:ss").alias("createdat"),
                                 "sentiment_label", "aspect_dominant", "user_id")
    A.write_csv(exp, path)
    schema = "date string, createdat string, sentiment_label string, aspect_dominant string, user_id bigint"
    from pyspark.sql import types as T  # noqa: F401

    return spark.read.option("header", True).schema(schema).csv(path)


@register("parquet_stage_roundtrip", "A4,A5", with_posts(f"""
select id, sentiment_label, date from posts where date >= date '{START}' and date <= date '{END}'
  and sentiment_label = 'negative'
"""))
def q_parquet_roundtrip(spark, d):
    path = scratch_path(spark, "stage1.parquet")
    A.write_stage(_p(spark, d).select("id", "sentiment_label", "date"), path)
    cond = (F.col("date") >= F.lit(START).cast("date")) & (F.col("date") <= F.lit(END).cast("date")) & \
        (F.col("sentiment_label") == "negative")
    return A.scan(spark, path, cond, ["id", "sentiment_label", "date"])


@register("warehouse_sql", "A2", """
select event_type, count(*) as n, round(sum(value), 2) as value from events group by 1
""")
def q_warehouse(spark, d):
    read_table(spark, d, "events").createOrReplaceTempView("postlens_events")
    return A.run_sql(spark, "select event_type, count(*) as n, round(sum(value), 2) as value from postlens_events "
                            "group by 1")


@register("fixed_export", "A7", with_posts(f"""
select coalesce(cast(id as varchar), '') as "ID", coalesce(twitterurl, '') as "Twitter URL",
  coalesce(text_clean, '') as "Text Clean", coalesce(text, '') as "Text", coalesce(fulltext, '') as "Full Text",
  coalesce(sentiment_label, '') as "Sentiment Label", coalesce(printf('%.6f', sentiment_score), '') as "Sentiment Score",
  {ADISP} as "Aspect Dominant", coalesce(strftime(createdat, '%Y-%m-%d'), '') as "Created At" from posts
""", wide=True))
def q_fixed_export(spark, d):
    return A.fixed_export(posts_wide(spark, d))
