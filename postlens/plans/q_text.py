"""Registered text queries (C1-C8, G6, H13) over ``documents``,
``conversations`` and the posts text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.text import is_noise, jaccard, normalize_text, tokens
from postlens.operators import keywords as K
from postlens.plans.registry import register
from postlens.sources.fixtures import posts, read_table, with_posts


def _q(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def norm_sql(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({col}, '')), "
            r"'https?://\S+|[@#][A-Za-z0-9_]+', ' ', 'g'), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g'))")


def noise_sql(t: str) -> str:
    return (f"(lower({t}) in {_q(W.THEME_STOPWORDS)} or contains({t}, '_') or "
            f"({t} = lower({t}) and {t} <> upper({t}) and regexp_matches({t}, '[0-9]') and length({t}) > 5) or "
            f"lower({t}) in {_q(W.PROFANITY)} or lower({t}) in {_q(W.KNOWN_HANDLES)} or length({t}) < 3 or "
            f"lower({t}) in {_q(W.GENERIC_WORDS)})")


_TOKENS = f"""
n as (select doc_id, {norm_sql('text')} as norm from documents),
t as (select doc_id, unnest(case when norm = '' then [] else string_split(norm, ' ') end) as token from n)
"""
_BASIC = f"length(token) >= 3 and token not in {_q(W.SUMMARY_STOPWORDS)} and not regexp_full_match(token, '[0-9]+')"


def _docs(spark, d):
    return read_table(spark, d, "documents")


@register("normalized_documents", "C1", f"select doc_id, {norm_sql('text')} as norm from documents")
def q_normalized(spark, d):
    return _docs(spark, d).select("doc_id", normalize_text("text").alias("norm"))


@register("token_counts", "C2,C3", f"with {_TOKENS} select token, count(*) as count from t where {_BASIC} group by 1")
def q_token_counts(spark, d):
    toks = K.explode_tokens(_docs(spark, d), "text")
    return toks.where(K.basic_token_filter(F.col("token"))).groupBy("token").agg(F.count("*").alias("count"))


@register("stopword_anti_join", "G6", f"""
with {_TOKENS}
select token, count(*) as count from t where token not in {_q(W.SUMMARY_STOPWORDS)} group by 1
""")
def q_stopword_anti(spark, d):
    stop = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in W.SUMMARY_STOPWORDS])).alias("word"))
    toks = K.remove_stopwords(K.explode_tokens(_docs(spark, d), "text"), stop)
    return toks.groupBy("token").agg(F.count("*").alias("count"))


@register("top_keywords", "C5,H7", f"""
with {_TOKENS},
g as (select token, count(*) as count from t where {_BASIC} group by 1),
top as (select * from g order by count desc, token limit 12)
select cast(row_number() over (order by count desc, token) as integer) as rank, token as keyword, count from top
""")
def q_top_keywords(spark, d):
    return K.top_keywords(_docs(spark, d), "text", k=12)


_K = 8


def _weighted_sql(business) -> str:
    bus = _q(business)
    return f"""
with {_TOKENS},
f as (select token from t where length(token) >= 3 and token not in {_q(W.THEME_STOPWORDS)}
      and not regexp_full_match(token, '[0-9]+')),
w as (select token, sum(case when token in {bus} then 2 else 1 end) as weight from f group by 1),
c as (select token, weight, row_number() over (order by weight desc, token) as pos from w
      order by weight desc, token limit {5 * _K}),
c2 as (select *, (pos <= {3 * _K} and not {noise_sql('token')} and (token in {bus} or
        (length(token) > 4 and regexp_full_match(token, '\\p{{L}}+') and token <> upper(token)))) as keep,
        (token in {bus} and not {noise_sql('token')}) as bus from c),
c3 as (select *, sum(case when keep then 1 else 0 end) over (order by pos rows between unbounded preceding and current row) as keep_rank,
        sum(case when bus then 1 else 0 end) over (order by pos rows between unbounded preceding and current row) as bus_rank,
        least({_K}, sum(case when keep then 1 else 0 end) over ()) as n_keep from c2),
picked as (select token, keep_rank as r from c3 where keep and keep_rank <= {_K}
           union all select token, {_K} + bus_rank from c3 where bus and bus_rank <= {_K} - n_keep),
dflt as (select * from (values {', '.join(f"('{w}', {10 * _K + 1 + i})" for i, w in enumerate(W.DEFAULT_KEYWORDS))}) v(token, r)),
allr as (select token, r, 1 as real from picked union all select token, r, 0 from dflt),
fin as (select *, sum(real) over () as n_real from allr)
select cast(row_number() over (order by r) as integer) as rank, token as keyword from fin where real = 1 or n_real = 0
"""


@register("weighted_keywords", "C6,C4", lambda: _weighted_sql(W.BUSINESS_TERMS))
def q_weighted_keywords(spark, d):
    return K.weighted_keywords(_docs(spark, d), "text", k=_K)


#: Frequent words of the corpus, most of them among the first 3k by weight, one a noise word.
CORPUS_TERMS = ["tion", "ment", "from", "that", "ther", "thon", "vers", "pour", "sich"]


@register("weighted_keywords_corpus", "C6,C4", lambda: _weighted_sql(CORPUS_TERMS))
def q_weighted_keywords_corpus(spark, d):
    """C6 with terms that the corpus has: the weight of 2, the first 3k and the back-fill act.  The
    back-fill starts again at the first business term, so a term can come twice (the defined behaviour)."""
    return K.weighted_keywords(_docs(spark, d), "text", k=_K, business=CORPUS_TERMS)


def _weighted_by_theme_sql(business) -> str:
    bus = _q(business)
    return with_posts(f"""
with n as (select theme, {norm_sql('text')} as norm from posts),
t as (select theme, unnest(case when norm = '' then [] else string_split(norm, ' ') end) as token from n),
f as (select theme, token from t where length(token) >= 3 and token not in {_q(W.THEME_STOPWORDS)}
      and not regexp_full_match(token, '[0-9]+')),
w as (select theme, token, sum(case when token in {bus} then 2 else 1 end) as weight from f group by 1, 2),
c as (select * from (select *, row_number() over (partition by theme order by weight desc, token) as pos from w) where pos <= {5 * _K}),
c2 as (select *, (pos <= {3 * _K} and not {noise_sql('token')} and (token in {bus} or
        (length(token) > 4 and regexp_full_match(token, '\\p{{L}}+') and token <> upper(token)))) as keep,
        (token in {bus} and not {noise_sql('token')}) as bus from c),
c3 as (select *, sum(case when keep then 1 else 0 end) over (partition by theme order by pos rows between unbounded preceding and current row) as keep_rank,
        sum(case when bus then 1 else 0 end) over (partition by theme order by pos rows between unbounded preceding and current row) as bus_rank,
        least({_K}, sum(case when keep then 1 else 0 end) over (partition by theme)) as n_keep from c2),
picked as (select theme, token, keep_rank as r from c3 where keep and keep_rank <= {_K}
           union all select theme, token, {_K} + bus_rank from c3 where bus and bus_rank <= {_K} - n_keep)
select theme, cast(row_number() over (partition by theme order by r) as integer) as rank, token as keyword from picked
""", text=True)


@register("weighted_keywords_per_theme", "C6,C4,J5", lambda: _weighted_by_theme_sql(CORPUS_TERMS))
def q_weighted_per_theme(spark, d):
    return K.weighted_keywords_per_group(posts(spark, d, with_text=True), "theme", "text", k=_K, business=CORPUS_TERMS)


@register("noise_words", "C4", f"""
with {_TOKENS} select distinct token, {noise_sql('token')} as noise from t
""")
def q_noise(spark, d):
    toks = K.explode_tokens(_docs(spark, d), "text").distinct()
    return toks.select("token", is_noise(F.col("token")).alias("noise"))


def _grams_sql(src: str, keys: str, stop) -> str:
    """Unigrams + bigrams per document after stop-word removal (DuckDB)."""
    return f"""
a as (select {keys}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') as ws from {src}),
w as (select {keys}, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from a),
s as (select {keys}, w, row_number() over (partition by {keys} order by pos) as pos from w where w not in {_q(stop)}),
g as (select {keys}, w as term from s
      union all select {keys}, w || ' ' || nxt from
        (select {keys}, w, lead(w) over (partition by {keys} order by pos) as nxt from s) where nxt is not null),
tf as (select {keys}, term, count(*) as tf from g group by all)
"""


def _stop():
    return W.ENGLISH_STOPWORDS


@register("tfidf_documents", "C7", f"""
with d as (select doc_id, text from documents),
{_grams_sql('d', 'doc_id', _stop())},
nd as (select count(*) as n_docs from d),
st as (select term, sum(tf) as total, count(*) as df from tf group by 1),
vocab as (select * from st order by total desc, term limit 3000),
x as (select tf.doc_id, tf.term, tf.tf * (ln((1 + n_docs) / (1 + df)) + 1) as raw
      from tf join vocab on tf.term = vocab.term, nd)
select doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from x
""")
def q_tfidf(spark, d):
    rows = K.tfidf(_docs(spark, d), "doc_id", "text", max_features=3000)
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_DROP = tuple(W.THEME_STOPWORDS) + tuple(W.KEYWORD_EXTRA_DROP)


@register("theme_keywords", "C8", with_posts(f"""
with d as (select theme, id as doc, text from posts),
{_grams_sql('d', 'theme, doc', _stop())},
nd as (select theme, count(*) as n_docs from d group by 1),
st as (select theme, term, sum(tf) as total, count(*) as df from tf group by 1, 2),
vocab as (select * from (select *, row_number() over (partition by theme order by total desc, term) as rk from st)
          where rk <= 500),
x as (select tf.theme, tf.doc, tf.term, tf.tf * (ln((1 + n_docs) / (1 + df)) + 1) as raw, n_docs
      from tf join vocab on tf.theme = vocab.theme and tf.term = vocab.term join nd on nd.theme = tf.theme),
y as (select theme, doc, term, raw / sqrt(sum(raw * raw) over (partition by theme, doc)) as weight, n_docs from x),
m as (select theme, term, round(sum(weight) / first(n_docs), 9) as score from y group by 1, 2),
top as (select * from (select *, row_number() over (partition by theme order by score desc, term) as rk from m)
        where rk <= 10),
kept as (select *, row_number() over (partition by theme order by rk) as rank from top
         where lower(split_part(term, ' ', 1)) not in {_q(_DROP)})
select theme, cast(rank as integer) as rank, term as keyword, round(score, 6) as score from kept where rank <= 6
""", text=True))
def q_theme_keywords(spark, d):
    return K.theme_keywords(posts(spark, d, with_text=True))


@register("turn_jaccard", "H13", f"""
with n as (select conv_id, turn, {norm_sql('text')} as norm from conversations),
t as (select conv_id, turn, case when norm = '' then [] else string_split(norm, ' ') end as toks from n),
p as (select conv_id, turn, toks, lead(toks) over (partition by conv_id order by turn) as nxt from t)
select conv_id, turn, case when len(list_distinct(list_concat(toks, nxt))) > 0
  then round(len(list_intersect(toks, nxt)) / len(list_distinct(list_concat(toks, nxt))), 6) else 0.0e0 end as jaccard
from p where nxt is not null
""")
def q_turn_jaccard(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", tokens("text").alias("toks"))
    c = c.withColumn("nxt", F.lead("toks").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("nxt").isNotNull()).select(
        "conv_id", "turn", F.round(jaccard("toks", "nxt"), 6).alias("jaccard"))
