"""Registered brief queries (C14, C17, K1-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.operators import briefs as K
from postlens.plans.q_text import _BASIC, norm_sql
from postlens.plans.registry import register
from postlens.plans.sqlbits import ADISP, SKEY
from postlens.sources.fixtures import posts, read_table, with_posts

START, END = "2024-01-05", "2024-01-20"
_W = f"w as (select * from posts where date >= date '{START}' and date <= date '{END}')"
_PRETTY1 = "upper(substr({x}, 1, 1)) || regexp_replace(substr({x}, 2), '^([^_]*)_', '\\1 ')"


def _pct1(n: str, t: str) -> str:
    return f"printf('%.1f', round({n} / {t} * 100, 1))"


@register("executive_summary", "K1,F3,F13,H5,C5", with_posts(f"""
with {_W},
c as (select count(*) as total, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'neutral', 'negative'))} from w),
ta as (select aspect_dominant as aspect, count(*) as n from w group by 1 order by n desc, aspect limit 6),
tf as (select *, row_number() over (order by n desc, aspect) as rk from ta where {ADISP.replace('aspect_dominant', 'aspect')} <> 'Other'),
a as (select coalesce(string_agg(aspect, ', ' order by rk) filter (where rk <= 4), '') as aspects from tf),
s as (select text from w where sentiment_label in ('negative', 'positive', 'neutral')),
n as (select {norm_sql('text')} as norm from s),
tk as (select unnest(case when norm = '' then [] else string_split(norm, ' ') end) as token from n),
g as (select token, count(*) as count from tk where {_BASIC} group by 1 order by count desc, token limit 12),
k as (select coalesce(string_agg(token, ', ' order by rk) filter (where rk <= 6), '') as keywords
      from (select *, row_number() over (order by count desc, token) as rk from g))
select '{START}' as start, '{END}' as "end", false as used_llm,
  case when total = 0 then '{W.EMPTY_PERIOD_SUMMARY}' else
  'Between {START} and {END}, customers discussed ' || (case when aspects <> '' then aspects else 'various areas' end)
  || '. Sentiment shows ' || negative || ' negative, ' || neutral || ' neutral, and ' || positive || ' positive posts. '
  || 'Prominent phrases included ' || (case when keywords <> '' then keywords else 'common customer concerns' end)
  || '. Focus next on resolving key negative drivers and reinforcing positive experiences.' end as summary,
  total, positive, neutral, negative, aspects, keywords
from c, a, k
""", text=True))
def q_exec_summary(spark, d):
    return K.executive_summary(posts(spark, d, with_text=True), START, END)


_NL = "chr(10)"


@register("executive_summary_prompt", "K1,C17,H5,F3,F13,C5", with_posts(f"""
with {_W},
c as (select count(*) as total, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'neutral', 'negative'))} from w),
ta as (select aspect_dominant as aspect, count(*) as n, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'neutral', 'negative'))}
       from w group by 1 order by n desc, aspect limit 6),
tf as (select * from ta where {ADISP.replace('aspect_dominant', 'aspect')} <> 'Other'),
a as (select coalesce(string_agg('{{"aspect":"' || aspect || '","count":' || n || ',"pos":' || positive || ',"neg":' || negative || ',"neu":' || neutral || '}}',
      ',' order by n desc, aspect), '') as listed from tf),
n as (select {norm_sql('text')} as norm from w where sentiment_label in ('negative', 'positive', 'neutral')),
tk as (select unnest(case when norm = '' then [] else string_split(norm, ' ') end) as token from n),
g as (select token, count(*) as n from tk where {_BASIC} group by 1 order by n desc, token limit 10),
k as (select coalesce(string_agg('"' || token || '"', ',' order by n desc, token), '') as listed from g),
e as (select coalesce(text, '') as text, list_position(['negative', 'positive', 'neutral'], sentiment_label) as lo,
        row_number() over (partition by sentiment_label order by createdat, id) as rn from w where sentiment_label in ('negative', 'positive', 'neutral')),
f as (select text, row_number() over (order by lo, rn) as r from e where rn <= 120),
x as (select count(*) as n, string_agg('- ' || text, {_NL} order by r) as listed from f where r <= 120),
p as (select {', '.join(f"regexp_replace(printf('%.2f', round({s} / total * 100, 2)), '0$', '') as {s}" for s in ('positive', 'neutral', 'negative'))} from c)
select total, 'Date window: {START} to {END}' || {_NL} || 'Grounding (JSON): {{"sentiment":{{"total":' || total || ',"counts":{{"positive":' || c.positive
  || ',"neutral":' || c.neutral || ',"negative":' || c.negative || '}},"percent":{{"positive":' || p.positive || ',"neutral":' || p.neutral
  || ',"negative":' || p.negative || '}}}},"top_aspects":[' || a.listed || '],"keywords":[' || k.listed || ']}}' || {_NL} || 'Examples (' || x.n || ' tweets):' || {_NL}
  || x.listed || {_NL} || {_NL} || '{K.SUMMARY_PROMPT_TAIL}' as prompt
from c, a, k, x, p
""", text=True))
def q_exec_prompt(spark, d):
    return K.executive_summary(posts(spark, d, with_text=True), START, END, with_prompt=True).select("total", "prompt")


@register("rule_based_summary", "K2,F14,F8", with_posts(f"""
with {_W},
c as (select count(*) as total, count_if(sentiment_label = 'positive') as positive,
      count_if(sentiment_label = 'negative') as negative, count_if(sentiment_label = 'neutral') as neutral,
      avg(sentiment_score) as avg_raw from w),
t5 as (select aspect_dominant as a, count(*) as n from w group by 1 order by n desc, a limit 5),
t3 as (select * from (select *, row_number() over (order by n desc, a) as r from
        (select *, {ADISP.replace('aspect_dominant', 'a')} as d from t5) where d <> 'Other') where r <= 3),
a as (select coalesce(string_agg(r || '. ' || {_PRETTY1.format(x='d')} || ' - A primary area of discussion among users' || {_NL}, '' order by r), '') as focus_lines,
      max(case when r = 1 then d end) as top0, coalesce(string_agg(d, ', ' order by r), '') as top_aspects from t3),
x as (select *, coalesce(avg_raw, 0.0e0) as av,
      case when total > 0 then round(positive / total * 100, 1) else 0.0e0 end as pp,
      case when total > 0 then round(negative / total * 100, 1) else 0.0e0 end as np,
      case when total > 0 then round(neutral / total * 100, 1) else 0.0e0 end as up from c, a)
select 'Executive Summary: Analysis of ' || format('{{:,}}', total) || ' social media conversations from {START} to {END}.' || {_NL} || {_NL}
  || 'Sentiment Overview:' || {_NL} || 'The data reveals a '
  || (case when np > 40 then 'predominantly negative' when up > 40 then 'largely neutral' else 'mixed' end)
  || ' sentiment landscape. '
  || (case when total > 0 then {_pct1('negative', 'total')} else '0' end) || '% of conversations express negative sentiment, while '
  || (case when total > 0 then {_pct1('positive', 'total')} else '0' end) || '% are positive and '
  || (case when total > 0 then {_pct1('neutral', 'total')} else '0' end) || '% are neutral. '
  || 'The average sentiment score of ' || printf('%.2f', round(av, 2)) || ' indicates '
  || (case when av > 0.7 then 'moderately positive' when av > 0.5 then 'neutral' else 'negative' end)
  || ' overall sentiment.' || {_NL} || {_NL}
  || (case when focus_lines <> '' then 'Key Focus Areas:' || {_NL} || focus_lines || {_NL} else '' end)
  || 'Recommendations:' || {_NL}
  || (case when np > 40 then '• Address negative sentiment concerns proactively, particularly in ' || coalesce(top0, 'key areas')
      || {_NL} || '• Monitor trending topics and respond to customer pain points' || {_NL} else '' end)
  || '• Leverage positive sentiment in ' || coalesce(top0, 'identified areas') || ' to strengthen brand positioning' || {_NL}
  || '• Continue monitoring sentiment trends to identify emerging patterns' as summary,
  false as used_llm, total, positive, negative, neutral, pp as positive_pct, np as negative_pct, up as neutral_pct,
  round(av, 6) as average_sentiment_score, top_aspects
from x
"""))
def q_rule_summary(spark, d):
    return K.rule_based_summary(posts(spark, d, with_text=False), START, END)


@register("rule_based_brief", "K4,F11", with_posts(f"""
with {_W},
c as (select count(*) as total, count_if(sentiment_label = 'positive') as positive,
      count_if(sentiment_label = 'negative') as negative, count_if(sentiment_label = 'neutral') as neutral from w),
g0 as (select {ADISP} as aspect, {', '.join(f"count_if({SKEY} = '{s}') as {s}" for s in ('positive', 'neutral', 'negative'))} from w group by 1),
g1 as (select *, positive + neutral + negative as t from g0 where aspect <> 'Other' order by t desc, aspect limit 5),
g as (select *, row_number() over (order by t desc, aspect) as r, {_PRETTY1.format(x='aspect')} as name from g1),
ra as (select r as o, 'High negative sentiment (' || {_pct1('negative', 't')} || '%) in ' || name
       || ' indicates customer dissatisfaction requiring urgent intervention' as text from g where t > 0 and negative / t * 100 > 50),
rall as (select 100 as o, 'Overall negative sentiment exceeds 40%, suggesting systemic issues that need comprehensive review' as text
         from c where negative > total * 0.4e0),
risks as (select * from ra union all select * from rall),
oa as (select r as o, 'Strong positive sentiment (' || {_pct1('positive', 't')} || '%) in ' || name
       || ' presents an opportunity to amplify and leverage customer satisfaction' as text from g where t > 0 and positive / t * 100 > 30),
oall as (select 100 as o, 'Significant positive sentiment base (' || {_pct1('positive', 'total')}
         || '%) can be leveraged for brand advocacy and marketing initiatives' as text from c where positive > total * 0.25e0),
opps as (select * from oa union all select * from oall),
opps_f as (select * from opps union all select 1, 'Focus on improving customer experience to increase positive sentiment across all aspects'
           where (select count(*) from opps) = 0),
risks_f as (select * from risks union all select 1, 'Monitor sentiment trends closely for emerging issues'
            where (select count(*) from risks) = 0),
themes as (select r as o, name as text from g where r <= 4),
bul as (select 1 as o, 'Analyzed ' || format('{{:,}}', total) || ' social media conversations from {START} to {END}' as text from c
        union all select 2, 'Sentiment distribution: ' || {_pct1('positive', 'total')} || '% positive, ' || {_pct1('negative', 'total')}
          || '% negative, ' || {_pct1('neutral', 'total')} || '% neutral' from c
        union all select 3, name || ' is the most discussed topic with ' || format('{{:,}}', t) || ' mentions' from g where r = 1
        union all select 4, 'Negative sentiment significantly outweighs positive, indicating areas requiring immediate attention'
          from c where negative > positive * 1.5e0),
ex as (select 1 as o, 'Executive Brief: ' || format('{{:,}}', total) || ' conversations analyzed from {START} to {END}. '
       || 'Sentiment analysis reveals ' || {_pct1('negative', 'total')} || '% negative, ' || {_pct1('positive', 'total')}
       || '% positive, and ' || {_pct1('neutral', 'total')} || '% neutral sentiment. '
       || 'Key focus areas include ' || coalesce((select string_agg(text, ', ' order by o) from themes where o <= 3), '') || '. '
       || coalesce((select 'Primary risks: ' || text || '. ' from risks order by o limit 1), '')
       || (select 'Key opportunities: ' || text || '.' from opps_f order by o limit 1) as text from c),
u as (select 'executive_text' as section, o, text from ex union all select 'executive_bullets', o, text from bul
      union all select 'themes', o, text from themes union all select 'risks', o, text from risks_f
      union all select 'opportunities', o, text from opps_f)
select section, cast(row_number() over (partition by section order by o, text) as integer) as rank, text from u
"""))
def q_rule_brief(spark, d):
    return K.rule_based_brief(posts(spark, d, with_text=False), START, END)


@register("structured_brief_prompt", "K3,C17,H4,F15,E4,C14")
def q_structured_brief(spark, d):
    return K.structured_brief(posts(spark, d, with_text=True), START, END, keyword="the", sample_size=50)


def brief_writer(prompt: str) -> str:
    """An answer that tells the length of a prompt with posts, in a fenced block between prose."""
    posts = prompt.split("\n- ")[1:]
    return 'Brief.\n```json\n{"executive_bullets": ["%d characters"], "themes": ["Pricing", "Delivery"], "risks": []}\n```\nEnd.' % len(prompt) if posts else ""


def _structured_sql() -> str:
    head, tail = K.BRIEF_PROMPT_HEAD.format(start=START, end=END, keyword="the", stats="%s").split("%s")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return with_posts(f"""
with w as (select * from posts where createdat >= timestamp '{START}' and createdat < timestamp '{END}' + interval 1 day and regexp_matches(coalesce(text, ''), '(?i)the')),
n as (select count(*) as n from w),
l as (select sentiment_label as key, count(*) as value from w group by 1),
j as (select coalesce(string_agg(',{{"metric":"sentiment","rank":0,"key":"' || key || '","value":' || value || '}}', '' order by key), '') as listed from l),
e as (select id, text from w where text is not null order by md5('42|' || cast(id as varchar)), id limit 50),
x as (select string_agg(text, {_NL} || '- ' order by id) as listed from e),
p as (select n, {text(head)} || '[{{"metric":"n_tweets","rank":0,"key":"","value":' || n || '}}' || j.listed || ']' || {text(tail)} || coalesce(x.listed, '')
      || {text(K.BRIEF_PROMPT_TAIL)} as prompt from n, j, x)
select false as generated, n as n_tweets, prompt, cast(null as varchar) as executive_text, '' as bullets, '' as themes, 0 as n_risks from p
union all select true, n, prompt, 'Brief.' || {_NL} || '```json' || {_NL} || '{{"executive_bullets": ["' || length(prompt) || ' characters"], "themes": ["Pricing", "Delivery"], "risks": []}}'
  || {_NL} || '```' || {_NL} || 'End.', length(prompt) || ' characters', 'Pricing,Delivery', 0 from p
""", text=True)


@register("structured_briefs", "K3,C17,D10,C14,H4,F15,E4", _structured_sql)
def q_structured_briefs(spark, d):
    """K3 of a window and a keyword, without a generator and with one."""
    p = posts(spark, d, with_text=True)
    made = [K.structured_brief(p, START, END, keyword="the", sample_size=50, generate_fn=g).withColumn("generated", F.lit(g is not None)) for g in (None, brief_writer)]
    s = F.col("structured")
    return made[0].unionByName(made[1]).select("generated", "n_tweets", "prompt", "executive_text", F.array_join(s["executive_bullets"], ",").alias("bullets"),
                                               F.array_join(s["themes"], ",").alias("themes"), F.size(s["risks"]).alias("n_risks"))


@register("extract_json_pages", "C14")
def q_extract_json(spark, d):
    pages = read_table(spark, d, "pages")
    return pages.select("page_id", K.extract_brief_json(F.col("html")).alias("s")).select(
        "page_id", F.size("s.executive_bullets").alias("n_bullets"), F.size("s.themes").alias("n_themes"),
        F.size("s.risks").alias("n_risks"), F.size("s.opportunities").alias("n_opportunities"))


@register("extract_json_turns", "C14", """
select conv_id, turn, k, case when k = 3 or text is null then 0 else 1 end as n_bullets, case when k = 3 or text is null then 0 else 2 end as n_themes,
  case when k in (3, 4) or text is null then 0 else 1 end as n_risks, case when k in (3, 4) or text is null then 0 else 2 end as n_opportunities,
  case when k <> 3 then text end as first_bullet, case when k <> 3 and text is not null then role end as last_theme
from (select *, cast((conv_id * 3 + turn) % 5 as integer) as k from conversations)
""")
def q_extract_turns(spark, d):
    """C14 over an answer made of each turn: its text and role as lists in JSON, which stands in a fenced block, in the last
    of two, between braces in prose, broken off, or in a fenced block without two of its lists."""
    k = ((F.col("conv_id") * 3 + F.col("turn")) % 5).cast("int")
    lists = [F.array("text").alias("executive_bullets"), F.array(F.lit("theme"), F.col("role")).alias("themes")]
    whole = F.to_json(F.struct(*lists, F.array(F.lit("r")).alias("risks"), F.array("role", "text").alias("opportunities")))
    fenced = lambda j: F.concat(F.lit("Some words.\n```json\n"), j, F.lit("\n```\nMore words."))
    answer = F.when(k == 0, fenced(whole)).when(k == 1, F.concat(fenced(F.lit('{"themes": ["old"]}')), fenced(whole))) \
        .when(k == 2, F.concat(F.lit("The brief: "), whole, F.lit(" and no more"))).when(k == 3, F.substring(whole, 1, 20)) \
        .otherwise(fenced(F.to_json(F.struct(*lists))))
    rows = read_table(spark, d, "conversations").withColumn("answer", F.when(F.col("text").isNotNull(), answer))
    rows = rows.select("conv_id", "turn", k.alias("k"), K.extract_brief_json(F.col("answer")).alias("s"))
    size = lambda c, n: F.size(f"s.{c}").alias(n)
    return rows.select("conv_id", "turn", "k", size("executive_bullets", "n_bullets"), size("themes", "n_themes"), size("risks", "n_risks"),
                       size("opportunities", "n_opportunities"), F.try_element_at("s.executive_bullets", F.lit(1)).alias("first_bullet"),
                       F.try_element_at("s.themes", F.lit(-1)).alias("last_theme"))
