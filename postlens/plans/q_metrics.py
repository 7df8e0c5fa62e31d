"""Registered aggregate queries (F1-F24) over the posts built from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import metrics as M
from postlens.plans.registry import register
from postlens.plans.sqlbits import ADISP, AKEY, ASPECT_VALUES, SENT_VALUES, SKEY, aspect_split_sql, counts3, pct
from postlens.sources.fixtures import posts, with_posts

# window used by the windowed variants (inside the events date range)
START, END, DAY = "2024-01-05", "2024-01-20", "2024-01-10"


def _p(spark, d):
    return posts(spark, d, with_text=False)


@register("sentiment_summary", "F1", with_posts(f"""
with c as (select {SKEY} as sentiment_label, count(*) as count from posts group by 1
           union all select s, 0 from {SENT_VALUES} v(s, o)),
m as (select sentiment_label, cast(sum(count) as bigint) as count from c group by 1)
select sentiment_label, count, cast(sum(count) over () as bigint) as total,
  {pct('count', 'sum(count) over ()', 2)} as percent from m
"""))
def q_sentiment_summary(spark, d):
    return M.sentiment_summary(_p(spark, d))


@register("sentiment_summary_window", "F1,E1,F3", with_posts(f"""
with w as (select * from posts where date >= date '{START}' and date <= date '{END}'),
c as (select {SKEY} as sentiment_label, count(*) as count from w group by 1
           union all select s, 0 from {SENT_VALUES} v(s, o)),
m as (select sentiment_label, cast(sum(count) as bigint) as count from c group by 1)
select sentiment_label, count, cast(sum(count) over () as bigint) as total,
  {pct('count', 'sum(count) over ()', 2)} as percent from m
"""))
def q_sentiment_summary_window(spark, d):
    return M.window_sentiment_summary(_p(spark, d), START, END)


@register("sentiment_summary_scored", "F2,E2", with_posts(f"""
with w as (select * from posts where date >= date '{START}' and date <= date '{END}'),
c as (select {SKEY} as sentiment_label, count(*) as count, avg(sentiment_score) as avg_score from w group by 1
      union all select s, 0, null from {SENT_VALUES} v(s, o)),
m as (select sentiment_label, cast(sum(count) as bigint) as count, max(avg_score) as avg_score from c group by 1)
select sentiment_label, count, round(avg_score, 6) as avg_score, cast(sum(count) over () as bigint) as total,
  {pct('count', 'sum(count) over ()', 1)} as percent from m
"""))
def q_sentiment_summary_scored(spark, d):
    return M.sentiment_summary_scored(_p(spark, d), START, END, both_or_none=True)


_DAILY = f"""
g as (select date, {counts3()} from posts group by date),
t as (select date, {', '.join(f"case when (positive + neutral + negative) > 0 then {s} / (positive + neutral + negative) * 100.0e0 else 0.0e0 end as {s}" for s in ('positive', 'neutral', 'negative'))} from g)
"""


@register("daily_trend", "F4", with_posts(f"with {_DAILY} select * from t"))
def q_daily_trend(spark, d):
    return M.daily_trend(_p(spark, d))


def _trend_sql(period: str) -> str:
    bucket = {"daily": "cast(createdat as date)",
              "weekly": "cast(date_trunc('week', cast(createdat as date)) as date)",
              "monthly": "cast(date_trunc('month', cast(createdat as date)) as date)"}[period]
    cols = ", ".join(f"{pct(s + '_count', 'total', 1)} as {s}" for s in ("positive", "neutral", "negative"))
    return with_posts(f"""
with g as (select {bucket} as date, {', '.join(f"count_if({SKEY} = '{s}') as {s}_count" for s in ('positive', 'neutral', 'negative'))},
  count(*) as total from posts group by 1)
select date, {cols}, positive_count, neutral_count, negative_count, total from g
""")


@register("sentiment_trend_daily", "F5", _trend_sql("daily"))
def q_trend_daily(spark, d):
    return M.sentiment_trend(_p(spark, d), "daily")


@register("sentiment_trend_weekly", "F5", _trend_sql("weekly"))
def q_trend_weekly(spark, d):
    return M.sentiment_trend(_p(spark, d), "weekly")


@register("sentiment_trend_monthly_orders", "F5", f"""
with posts as (select o_orderkey as id, o_orderdate as createdat, cast(o_orderdate as date) as date,
  case o_orderstatus when 'F' then 'positive' when 'O' then 'neutral' else 'negative' end as sentiment_label
  from orders),
g as (select cast(date_trunc('month', cast(createdat as date)) as date) as date,
  {', '.join(f"count_if({SKEY} = '{s}') as {s}_count" for s in ('positive', 'neutral', 'negative'))},
  count(*) as total from posts group by 1)
select date, {', '.join(f"{pct(s + '_count', 'total', 1)} as {s}" for s in ('positive', 'neutral', 'negative'))},
  positive_count, neutral_count, negative_count, total from g
""")
def q_trend_monthly_orders(spark, d):
    from postlens.sources.fixtures import read_table

    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("createdat"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "neutral")
        .otherwise("negative").alias("sentiment_label"))
    return M.sentiment_trend(o, "monthly")


@register("sentiment_trend_paged", "F5,H8", with_posts(f"""
with g as (select cast(createdat as date) as date,
  {', '.join(f"count_if({SKEY} = '{s}') as {s}_count" for s in ('positive', 'neutral', 'negative'))},
  count(*) as total from posts group by 1),
p as (select * from g order by date desc limit 7 offset 3)
select date, {', '.join(f"{pct(s + '_count', 'total', 1)} as {s}" for s in ('positive', 'neutral', 'negative'))},
  positive_count, neutral_count, negative_count, total from p
"""))
def q_trend_paged(spark, d):
    return M.sentiment_trend(_p(spark, d), "daily", offset=3, limit=7)


@register("trend_reaggregated_weekly", "F6", with_posts(f"""
with {_DAILY}
select strftime(date_trunc('week', date), '%Y-%m-%d') as date,
  round(avg(positive), 4) as positive, round(avg(neutral), 4) as neutral, round(avg(negative), 4) as negative
from t group by 1
"""))
def q_trend_reagg(spark, d):
    return M.reaggregate_trend(M.daily_trend(_p(spark, d)), "weekly")


@register("aspect_distribution", "F7,G2,B13", with_posts(f"""
with c as (select {AKEY} as aspect, count(*) as count from posts group by 1),
v as (select * from {ASPECT_VALUES} v(aspect, ord)),
j as (select v.aspect, v.ord, cast(coalesce(c.count, 0) as bigint) as count from v left join c on v.aspect = c.aspect)
select aspect, ord, count, cast(sum(count) over () as bigint) as total,
  {pct('count', 'sum(count) over ()', 2)} as percent from j
"""))
def q_aspect_distribution(spark, d):
    return M.aspect_distribution(_p(spark, d))


@register("aspect_distribution_open", "F8,B11", with_posts(f"""
with g as (select {ADISP} as aspect, count(*) as count from posts group by 1)
select aspect, count, {pct('count', 'sum(count) over ()', 2)} as percent from g
"""))
def q_aspect_distribution_open(spark, d):
    return M.aspect_distribution_open(_p(spark, d))


@register("aspect_avg_scores", "F9", with_posts("""
select coalesce(round(avg(aspect_pricing), 4), 0.0e0) as pricing, coalesce(round(avg(aspect_delivery), 4), 0.0e0) as delivery,
  coalesce(round(avg(aspect_returns), 4), 0.0e0) as returns, coalesce(round(avg(aspect_staff), 4), 0.0e0) as staff,
  coalesce(round(avg(aspect_app_ux), 4), 0.0e0) as app_ux from posts
"""))
def q_aspect_avg_scores(spark, d):
    return M.aspect_avg_scores(_p(spark, d))


_VOCAB = ["pricing", "delivery", "returns", "staff", "app/ux"]
_SPLIT_BUCKET = f"(case when {AKEY} in ('pricing', 'delivery', 'returns', 'staff', 'app/ux') then {AKEY} else 'others' end)"


@register("aspect_sentiment_split", "F10,G2,G4", with_posts(
    "with " + aspect_split_sql(_SPLIT_BUCKET, _VOCAB + ["others"], 2)))
def q_aspect_split(spark, d):
    return M.aspect_sentiment_split(_p(spark, d), include_others=True)


@register("aspect_split_from_rollup", "F12", with_posts(
    "with " + aspect_split_sql(_SPLIT_BUCKET, _VOCAB + ["others"], 2)))
def q_aspect_split_rollup(spark, d):
    rollup = M.build_aspect_rollup(_p(spark, d))
    return M.aspect_split_from_rollup(rollup, include_others=True)


_OPEN_SPLIT = f"""
g as (select {ADISP} as aspect, {counts3()} from posts group by 1),
t as (select aspect, positive, negative, neutral, positive + neutral + negative as total from g)
"""


def _open_split_sql(include_others: bool) -> str:
    where = "" if include_others else "where aspect <> 'Other'"
    return with_posts("with " + _OPEN_SPLIT + f"""
select aspect, positive, negative, neutral, total,
  {pct('positive', 'total', 1)} as positive_pct, {pct('neutral', 'total', 1)} as neutral_pct,
  {pct('negative', 'total', 1)} as negative_pct from t {where}""")


@register("aspect_sentiment_split_open", "F11,E8", _open_split_sql(False))
def q_aspect_split_open(spark, d):
    return M.aspect_sentiment_split_open(_p(spark, d), include_others=False)


@register("top_aspects", "F13", with_posts(f"""
with g as (select aspect_dominant as aspect, count(*) as count, count_if({SKEY} = 'positive') as pos,
  count_if({SKEY} = 'negative') as neg, count_if({SKEY} = 'neutral') as neu from posts group by 1),
r as (select *, cast(row_number() over (order by count desc, aspect) as integer) as rank from g)
select * from r where rank <= 6 and {ADISP.replace('aspect_dominant', 'aspect')} <> 'Other'
"""))
def q_top_aspects(spark, d):
    return M.top_aspects(_p(spark, d), k=6)


@register("sentiment_counts_row", "F14", with_posts(f"""
select count(*) as total, count_if({SKEY} = 'positive') as positive, count_if({SKEY} = 'negative') as negative,
  count_if({SKEY} = 'neutral') as neutral, round(avg(sentiment_score), 6) as avg_sentiment from posts
"""))
def q_counts_row(spark, d):
    return M.sentiment_counts_row(_p(spark, d))


@register("basic_stats", "F15,H7", with_posts("""
with s as (select 'n_tweets' as metric, '' as key, count(*) as value, 0 as rank from posts
  union all select 'sentiment', coalesce(sentiment_label, 'null'), count(*), 0 from posts group by 2
  union all select * from (select 'aspect', aspect_dominant, count(*) as value,
      cast(row_number() over (order by count(*) desc, aspect_dominant) as integer) as rank
      from posts where aspect_dominant is not null group by 2) a where rank <= 10)
select metric, key, value, rank from s
"""))
def q_basic_stats(spark, d):
    return M.basic_stats(_p(spark, d), aspect_col="aspect_dominant")


@register("date_range", "F16", with_posts("select min(date) as min_date, max(date) as max_date from posts"))
def q_date_range(spark, d):
    return M.date_range(_p(spark, d))


@register("theme_sizes", "F17,H9", with_posts(
    "select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1"))
def q_theme_sizes(spark, d):
    return M.theme_sizes(_p(spark, d))


@register("theme_sentiment", "F18", with_posts(
    f"select cast(theme as integer) as id, count(*) as tweet_count, {counts3()} from posts group by 1"))
def q_theme_sentiment(spark, d):
    return M.theme_sentiment(_p(spark, d))


@register("day_drilldown", "F19,E10", with_posts(f"""
with g as (select {ADISP} as aspect, {counts3()} from posts where date = date '{DAY}' group by 1),
s as (select aspect, 'all' as section, positive + neutral + negative as count from g
  union all select aspect, 'positive', positive from g union all select aspect, 'neutral', neutral from g
  union all select aspect, 'negative', negative from g),
z as (select * from s where count > 0)
select aspect, section, count, cast(sum(count) over (partition by section) as bigint) as section_total,
  {pct('count', 'sum(count) over (partition by section)', 4)} as percent from z
"""))
def q_day_drilldown(spark, d):
    return M.day_drilldown(_p(spark, d), DAY)


@register("daily_label_counts", "F20", with_posts(
    f"select date, {counts3()}, count(*) as total from posts group by date"))
def q_daily_label_counts(spark, d):
    return M.daily_label_counts(_p(spark, d))


@register("aspect_split_negative", "F21", with_posts("with " + _OPEN_SPLIT + f"""
select upper(substr(aspect, 1, 1)) || substr(aspect, 2) as aspect,
  negative as count, {pct('negative', 'total', 1)} as percentage, 'negative' as sentiment from t
"""))
def q_split_negative(spark, d):
    return M.aspect_split_for_sentiment(_p(spark, d), "negative")


@register("theme_share", "F22,H14", with_posts("""
with g as (select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1),
t as (select * from g order by tweet_count desc, id limit 8)
select id, tweet_count, cast(case when sum(tweet_count) over () > 0
  then round(tweet_count / (sum(tweet_count) over ()) * 100) else 0 end as integer) as share from t
"""))
def q_theme_share(spark, d):
    return M.theme_share(M.theme_sizes(_p(spark, d)), n=8)


@register("aspect_stacked_totals", "F23", with_posts("with " + _OPEN_SPLIT + """
select upper(aspect) as label, positive, neutral, negative, total,
  cast(case when total > 0 then round(positive / total * 100) else 0 end as integer) as positive_share,
  cast(case when total > 0 then round(neutral / total * 100) else 0 end as integer) as neutral_share,
  cast(case when total > 0 then round(negative / total * 100) else 0 end as integer) as negative_share from t
"""))
def q_stacked(spark, d):
    return M.aspect_stacked_totals(_p(spark, d))


@register("grand_total", "F24", with_posts("with " + _OPEN_SPLIT + " select cast(sum(total) as bigint) as total from t"))
def q_grand_total(spark, d):
    return M.grand_total(_p(spark, d))
