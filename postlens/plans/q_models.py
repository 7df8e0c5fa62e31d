"""Registered scoring and theme queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.text import prompt_keywords, with_fallback_title, with_generated_title
from postlens.operators import scoring as S
from postlens.operators import themes as J
from postlens.operators.keywords import explode_tokens, basic_token_filter
from postlens.plans.q_text import _grams_sql, _q, norm_sql
from postlens.plans.registry import register
from postlens.sources.fixtures import posts, read_table, with_posts

# Corpus-word lexicons: the test prose has no retail vocabulary, so frequent
# corpus words stand in for sentiment and aspect cue words.
POSITIVE = ["that", "with", "this"]
NEGATIVE = ["from", "than", "ther"]
ASPECT_LEXICONS = {"pricing": ["that", "than"], "delivery": ["with", "from"], "returns": ["this", "ther"],
                   "staff": ["tion", "then"], "app_ux": ["thin", "thor"]}

_DOC_TOKENS = f"""
n as (select doc_id, {norm_sql('text')} as norm from documents),
t as (select doc_id, case when norm = '' then [] else string_split(norm, ' ') end as toks from n),
u as (select doc_id, unnest(toks) as tok from t)
"""


def _docs(spark, d):
    return read_table(spark, d, "documents")


@register("sentiment_lexicon", "D1,D2,P2", f"""
with {_DOC_TOKENS},
h as (select doc_id, count(case when tok in {_q(POSITIVE)} then 1 end) as p,
        count(case when tok in {_q(NEGATIVE)} then 1 end) as n from u group by 1),
x as (select t.doc_id, coalesce(h.p, 0) as p, coalesce(h.n, 0) as n from t left join h on t.doc_id = h.doc_id)
select doc_id, case when p > n then 'positive' when n > p then 'negative' else 'neutral' end as sentiment_label,
  round(case when p = n then 1.0e0 / (p + n + 1.0e0) else 0.5e0 + abs(p - n) / (2.0e0 * (p + n + 1.0e0)) end, 6)
    as sentiment_score
from x
""")
def q_sentiment_lexicon(spark, d):
    out = S.run_sentiment(_docs(spark, d).select("doc_id", "text"), "text", positive=POSITIVE, negative=NEGATIVE)
    return out.select("doc_id", "sentiment_label", F.round("sentiment_score", 6).alias("sentiment_score"))


@register("model_label_mapping", "D2", """
select event_id, case event_id % 4 when 0 then 'negative' when 1 then 'neutral' when 2 then 'positive'
  else 'label_3' end as label from events
""")
def q_label_map(spark, d):
    ev = read_table(spark, d, "events").select(
        "event_id", F.concat(F.lit("LABEL_"), (F.col("event_id") % 4).cast("string")).alias("raw"))
    return ev.select("event_id", S.map_model_label("raw").alias("label"))


def _aspect_sql() -> str:
    scores = ",\n  ".join(
        f"count(distinct case when tok in {_q(w)} then tok end) / {float(len(w))} as aspect_{a}"
        for a, w in ASPECT_LEXICONS.items())
    cols = [f"aspect_{a}" for a in ASPECT_LEXICONS]
    top = "greatest(" + ", ".join(cols) + ")"
    dom = f"case when {top} < 0.5 then 'Other' " + " ".join(
        f"when {c} = {top} then '{a}'" for a, c in zip(ASPECT_LEXICONS, cols)) + " end"
    return f"""
with {_DOC_TOKENS},
h as (select doc_id, {scores} from u group by 1),
x as (select t.doc_id, {', '.join(f'coalesce(h.{c}, 0.0e0) as {c}' for c in cols)} from t left join h on t.doc_id = h.doc_id)
select *, {dom} as aspect_dominant from x
"""


@register("aspects_lexicon", "D3,D4,P3", _aspect_sql())
def q_aspects_lexicon(spark, d):
    out = S.run_aspects(_docs(spark, d).select("doc_id", "text"), "text", lexicons=ASPECT_LEXICONS)
    return out.drop("text")


@register("aspects_fast_preview", "D5", """
select doc_id, 0.0e0 as aspect_pricing, 0.0e0 as aspect_delivery, 0.0e0 as aspect_returns, 0.0e0 as aspect_staff,
  0.0e0 as aspect_app_ux, 'Other' as aspect_dominant from documents
""")
def q_fast_preview(spark, d):
    return S.run_aspects(_docs(spark, d).select("doc_id"), fast_preview=True)


_EMB = """
ex as (select vec_id, label, unnest(embedding) as v, unnest(range(0, len(embedding))) as dim from embeddings),
proto as (select label, dim, avg(v::double) as value from ex group by 1, 2),
pn as (select label, sqrt(sum(value * value)) as pnorm from proto group by 1),
rn as (select vec_id, sqrt(sum(v::double * v::double)) as rnorm from ex group by 1),
dots as (select ex.vec_id, proto.label, sum(ex.v::double * proto.value) as dot
         from ex join proto on ex.dim = proto.dim group by 1, 2),
cos as (select dots.vec_id, dots.label, dot / (rnorm * pnorm) as cosine
        from dots join rn on dots.vec_id = rn.vec_id join pn on dots.label = pn.label)
"""


def _cos(spark, d):
    emb = read_table(spark, d, "embeddings")
    return S.cosine_scores(emb, S.prototype_vectors(emb))


@register("aspect_cosine_scores", "D3,D6", f"with {_EMB} select vec_id, label, round(cosine, 6) as cosine from cos")
def q_cosine(spark, d):
    return _cos(spark, d).select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@register("nearest_centroid", "D8", f"""
with {_EMB},
r as (select *, row_number() over (partition by vec_id order by cosine desc, label) as rk from cos)
select vec_id, label as assigned, round(cosine, 6) as cosine from r where rk = 1
""")
def q_nearest(spark, d):
    emb = read_table(spark, d, "embeddings")
    return S.nearest_prototype(emb, S.prototype_vectors(emb)).select("vec_id", "assigned", F.round("cosine", 6).alias("cosine"))


@register("sentiment_logistic", "D1")
def q_logistic(spark, d):
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lab = read_table(spark, d, "labels").select("doc_id", "quality")
    model = S.train_logistic_sentiment(docs.join(lab, "doc_id"), "text", "quality")
    return S.apply_logistic_sentiment(model, docs, {0: "negative", 1: "positive"}).select(
        "doc_id", "sentiment_label", "sentiment_score")


@register("kmeans_themes", "D6,D7,D8,D9,J4,J5,C8,C12,D10,J6")
def q_kmeans_themes(spark, d):
    return J.compute_themes(posts(spark, d, with_text=True), n_clusters=12)["themes"]


@register("empty_window_themes", "J7", """
select cast(null as integer) as id, cast(null as varchar) as name, cast(null as varchar) as summary,
  cast(null as bigint) as tweet_count, cast(null as bigint) as positive, cast(null as bigint) as negative,
  cast(null as bigint) as neutral from events where false
""")
def q_empty_themes(spark, d):
    return J.compute_themes(posts(spark, d, with_text=True), n_clusters=12, start="2030-01-01")["themes"]


def _token_named_themes(spark, d):
    """Theme table whose names are the three most frequent tokens of each
    theme's posts (posts' theme = event id mod 12)."""
    p = posts(spark, d, with_text=True)
    toks = explode_tokens(p, "text", keep=["theme"]).where(basic_token_filter(F.col("token")))
    cnt = toks.groupBy("theme", "token").agg(F.count("*").alias("n"))
    rk = F.row_number().over(Window.partitionBy("theme").orderBy(F.col("n").desc(), "token"))
    top = cnt.withColumn("rk", rk).where(F.col("rk") <= 4)
    names = top.groupBy("theme").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "token"))), lambda s: s["token"]).alias("kw"))
    sizes = p.groupBy("theme").agg(F.count("*").alias("tweet_count"),
                                   *[F.count_if(F.col("sentiment_label") == s).alias(s)
                                     for s in ("positive", "negative", "neutral")])
    t = sizes.join(names, "theme").select(
        F.col("theme").alias("id"), F.array_join(F.slice("kw", 1, 3), " ").alias("name"),
        F.concat(F.lit("About "), F.array_join("kw", ", ")).alias("summary"), "tweet_count",
        "positive", "negative", "neutral", "kw")
    return t.withColumn("pos", F.row_number().over(Window.orderBy(F.col("tweet_count").desc(), "id")))


#: Names of themes 0 to 11: shared words, a synonym within a longer name, two synonyms, one shared word only, none.
THEME_NAMES = ["Delivery Delays", "Late Delivery Delays", "Pricing", "Pricing Tariff Concern", "Refund Request",
               "Return Request Refund", "Store Staff", "Store Checkout", "App Login", "Stock Availability",
               "Stock Shortage Availability", "Gift Cards"]


def _named_themes(spark, d):
    """The posts' themes (event id mod 12) with the names above."""
    names = F.array(*[F.lit(n) for n in THEME_NAMES])
    t = posts(spark, d, with_text=False).groupBy(F.col("theme").alias("id")).agg(
        F.count("*").alias("tweet_count"), *[F.count_if(F.col("sentiment_label") == s).alias(s) for s in ("positive", "negative", "neutral")])
    t = t.withColumn("name", F.element_at(names, F.col("id") + 1)).withColumn("summary", F.concat(F.lit("About "), "name"))
    return t.withColumn("pos", F.row_number().over(Window.orderBy(F.col("tweet_count").desc(), "id")))


def _named_sql(rest: str) -> str:
    """The named themes ``th``, their name tokens and all pairs scored."""
    syn = " or ".join(f"(list_contains(a.s, '{x}') and list_contains(b.s, '{y}')) or (list_contains(a.s, '{y}') and list_contains(b.s, '{x}'))"
                      for x, y in W.SYNONYM_PAIRS)
    names = ", ".join(f"'{n}'" for n in THEME_NAMES)
    return with_posts(f"""
with g as (select cast(theme as integer) as id, count(*) as tweet_count, count_if(sentiment_label = 'positive') as positive,
        count_if(sentiment_label = 'negative') as negative, count_if(sentiment_label = 'neutral') as neutral from posts group by 1),
h as (select *, [{names}][id + 1] as name, row_number() over (order by tweet_count desc, id) as pos from g),
th as (select *, list_filter(string_split({norm_sql('name')}, ' '), lambda w: length(w) > 2 and w not in {_q(W.THEME_STOPWORDS)}) as s from h),
j as (select a.id as a_id, b.id as b_id, a.pos as a_pos, b.pos as b_pos, len(list_intersect(a.s, b.s)) as i, len(a.s) + len(b.s) as total,
        ({syn}) as syn, contains(array_to_string(a.s, ' '), array_to_string(b.s, ' '))
          or contains(array_to_string(b.s, ' '), array_to_string(a.s, ' ')) as sub
      from th a join th b on a.pos < b.pos),
sc as (select *, greatest(i / cast(total - i as double),
        cast(case when syn then 3 else 0 end + case when sub then 4 else 0 end + case when i >= 2 then 3 else 0 end as double) / 10) as score from j),
{rest}
""")


@register("theme_similarity_pairs", "G5,J1", lambda: _named_sql(
    "out as (select a_id, b_id, round(score, 6) as score from sc where score >= 0.5) select * from out"))
def q_similar_pairs(spark, d):
    t = _named_themes(spark, d)
    return J.similar_pairs(t, threshold=0.5).select("a_id", "b_id", F.round("score", 6).alias("score"))


# the names' similar pairs are disjoint, so a theme's root is the first one it is similar to, or itself
@register("merge_similar_themes", "J2", lambda: _named_sql("""
r as (select th.*, coalesce((select min(sc.a_pos) from sc where sc.b_id = th.id and sc.score >= 0.5), th.pos) as root from th)
select arg_max(id, tweet_count * 1000 - pos) as id, arg_max(name, tweet_count * 1000 - pos) as name,
  'About ' || arg_max(name, tweet_count * 1000 - pos) as summary, cast(sum(tweet_count) as bigint) as tweet_count,
  cast(sum(positive) as bigint) as positive, cast(sum(negative) as bigint) as negative, cast(sum(neutral) as bigint) as neutral,
  string_agg(cast(id as varchar), ',' order by id) as components from r group by root"""))
def q_merge(spark, d):
    out = J.merge_similar_themes(_named_themes(spark, d), threshold=0.5)
    return out.withColumn("components", F.array_join(F.col("component_ids").cast("array<string>"), ",")).drop("component_ids")


def _mmr_sql(n: int = 6, lam: float = 0.65) -> str:
    picks = ["p1 as (select id, tweet_count, cast(1 as integer) as mmr_rank from sz order by tweet_count desc, id limit 1)"]
    for j in range(2, n + 1):
        taken = " union all ".join(f"select id from p{i}" for i in range(1, j))
        picks.append(f"""t{j} as ({taken}),
q{j} as (select sz.id, sz.tweet_count, {lam}e0 * sz.tweet_count / (select max(tweet_count) from sz)
    - {round(1 - lam, 9)}e0 * greatest(0.0e0, coalesce((select max(cosine) from cs where cs.a = sz.id and cs.b in (select id from t{j})), 0.0e0)) as score
    from sz where sz.id not in (select id from t{j})),
p{j} as (select id, tweet_count, cast({j} as integer) as mmr_rank from q{j} order by score desc, tweet_count desc, id limit 1)""")
    return with_posts(f"""
with d as (select theme, id as doc, text from posts),
{_grams_sql('d', 'theme, doc', W.ENGLISH_STOPWORDS)},
tt as (select theme, term, sum(tf) as tf from tf group by 1, 2),
nd as (select count(distinct theme) as n_docs from d),
vocab as (select term, sum(tf) as total, count(*) as df from tt group by 1 order by total desc, term limit 4000),
x as (select tt.theme, tt.term, tt.tf * (ln((1 + n_docs) / (1 + df)) + 1) as raw from tt join vocab on tt.term = vocab.term, nd),
v as (select theme, term, raw / sqrt(sum(raw * raw) over (partition by theme)) as w from x),
cs as (select a.theme as a, b.theme as b, sum(a.w * b.w) as cosine from v a join v b on a.term = b.term and a.theme <> b.theme group by 1, 2),
sz as (select theme as id, count(*) as tweet_count from posts group by 1),
{', '.join(picks)}
{' union all '.join(f'select * from p{i}' for i in range(1, n + 1))}
""", text=True)


@register("mmr_theme_selection", "J3", _mmr_sql)
def q_mmr(spark, d):
    t = _token_named_themes(spark, d).drop("kw")
    return J.mmr_select(t, posts(spark, d, with_text=True), n=6).select("id", "tweet_count", "mmr_rank")


# fewer than twelve are left when similar themes merge, so the twelve come back as they were; five are left when five are asked for
@register("final_theme_sets", "J4,J2", lambda: _named_sql("""
r as (select th.*, coalesce((select min(sc.a_pos) from sc where sc.b_id = th.id and sc.score >= 0.5), th.pos) as root from th),
m as (select arg_max(id, tweet_count * 1000 - pos) as id, arg_max(name, tweet_count * 1000 - pos) as name, cast(sum(tweet_count) as bigint) as tweet_count,
  cast(sum(positive) as bigint) as positive, cast(sum(negative) as bigint) as negative, cast(sum(neutral) as bigint) as neutral from r group by root),
f as (select * from m order by tweet_count desc, id limit 5)
select 5 as n, id, name, 'About ' || name as summary, tweet_count, positive, negative, neutral from f
union all select 12, id, name, 'About ' || name, tweet_count, positive, negative, neutral from th where (select count(*) from m) < 12"""))
def q_final_sets(spark, d):
    t = _named_themes(spark, d)
    sets = [J.final_theme_set(t, n, threshold=0.5).select(F.lit(n).alias("n"), "*") for n in (5, 12)]
    return sets[0].unionByName(sets[1])


@register("fallback_titles", "C12,C16,J6,C11")
def q_fallback_titles(spark, d):
    t = _token_named_themes(spark, d)
    t = with_fallback_title(t.select("id", "kw", prompt_keywords("kw").alias("prompt_kws")), "kw", "title")
    return t.select("id", "prompt_kws", "title", J.template_summary("title", "prompt_kws").alias("summary"))


#: For themes 0 to 11: keywords, a generated title, what C12 makes of the first and what C13 and C11 make of the second
#: (null: C12's title).  Two terms; one that gets Concerns, Issues, nothing or an experience; two that mean nothing;
#: doubled and unmapped words, short and noisy ones, none.
TITLE_CASES = [
    (["delivery", "tariff"], '"Theme: pricing concerns tariff impact"', "Delivery Challenges and Tariff Impact", "Pricing Concerns Tariff Impact"),
    (["service"], "ok", W.DEFAULT_TITLE, None),
    (["quality"], "Title: **product quality feedback**", "Product Quality Issues", "Product Quality Feedback"),
    (["pricing"], "Shopping Cart", W.DEFAULT_TITLE, None),
    (["app"], "Digital Experience school motif", W.DEFAULT_TITLE, None),
    (["tariff"], None, "Tariff Impact and Customer Experience", None),
    (["waterproof", "cables"], None, W.DEFAULT_TITLE, None),
    (["refund", "exchange", "stock"], None, "Returns and Product Availability", None),
    (["fulfillment", "tariffs"], None, "Order Fulfillment and Tariff Impact", None),
    (["fulfillment", "website"], None, "Order Fulfillment Issues", None),
    (["ab12cd34", "shipping", "availability"], None, "Shipping Issues and Product Availability", None),
    ([], None, W.DEFAULT_TITLE, None),
]


def _title_cases_sql() -> str:
    def text(x):
        return "null" if x is None else "'" + x.replace("'", "''") + "'"

    rows = ", ".join(
        f"({i}, {text(fallback)}, {text(generated or fallback)}, "
        f"{text(fallback + ': This theme focuses on ' + ', '.join(k for k in kws if len(k) > 3 and k.isalpha() and k not in W.GENERIC_WORDS + W.THEME_STOPWORDS + W.KNOWN_HANDLES) + '. ' + W.THEME_SUMMARY_TAIL)})"
        for i, (kws, _, fallback, generated) in enumerate(TITLE_CASES))
    return with_posts(f"""
with v as (select * from (values {rows}) v(id, title, generated, summary)),
g as (select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1)
select g.id, tweet_count, title, generated, summary from g join v on g.id = v.id
""")


@register("title_cases", "C9,C10,C11,C12,C13,C16,J6", _title_cases_sql)
def q_title_cases(spark, d):
    """The posts' themes with the keywords and generated titles above."""
    kws = F.array(*[F.array(*[F.lit(k) for k in c[0]]).cast("array<string>") for c in TITLE_CASES])
    gen = F.array(*[F.lit(c[1]).cast("string") for c in TITLE_CASES])
    t = posts(spark, d, with_text=False).groupBy(F.col("theme").alias("id")).agg(F.count("*").alias("tweet_count"))
    t = t.withColumn("kw", F.element_at(kws, F.col("id") + 1)).withColumn("gen", F.element_at(gen, F.col("id") + 1))
    t = with_generated_title(with_fallback_title(t, "kw", "title"), "gen", "title", "generated")
    return t.select("id", "tweet_count", "title", "generated", J.template_summary("title", prompt_keywords("kw")).alias("summary"))


def stub_generator(prompt: str) -> str:
    """Answers for themes about delivery, fails for pricing, is empty for others."""
    asked = re.search(r"^(?:K|Top k)eywords \(filtered.*?\): (.*)$", prompt, re.MULTILINE).group(1)
    if "pricing" in asked.lower():
        raise RuntimeError("no answer")
    if "delivery" not in asked.lower():
        return ""
    return "Posts tell of late parcels." if "\nTheme name: " in prompt else "Delivery Challenges Tariff Impact"


def _generated_sql() -> str:
    def summary(i):
        kws, _, fallback, _ = TITLE_CASES[i]
        if "delivery" in kws:
            return "Posts tell of late parcels."
        noise = W.GENERIC_WORDS + W.THEME_STOPWORDS + W.KNOWN_HANDLES
        kept = [k for k in kws if len(k) > 3 and k.isalpha() and k not in noise]
        kept = [k for k in kept if k in W.SUMMARY_BUSINESS_TERMS or len(k) > 5] or W.SUMMARY_DEFAULT_TERMS
        return f"{fallback}: This theme focuses on {', '.join(kept)}. {W.THEME_SUMMARY_TAIL_LONG}"

    rows = ", ".join(f"({i}, '{'Delivery Challenges Tariff Impact' if 'delivery' in c[0] else c[2]}', '{summary(i)}', {'delivery' in c[0]})"
                     for i, c in enumerate(TITLE_CASES))
    return with_posts(f"""
with v as (select * from (values {rows}) v(id, name, summary, used_generator)),
g as (select cast(theme as integer) as id, count(*) as tweet_count from posts group by 1)
select g.id, tweet_count, name, summary, used_generator from g join v on g.id = v.id
""")


@register("generated_themes", "D10,C16,C17,J6", _generated_sql)
def q_generated_themes(spark, d):
    """Names and summaries of the posts' themes from a generator that answers, fails or is empty."""
    kws = F.array(*[F.array(*[F.lit(k) for k in c[0]]).cast("array<string>") for c in TITLE_CASES])
    t = posts(spark, d, with_text=False).groupBy(F.col("theme").alias("id")).agg(F.count("*").alias("tweet_count"))
    t = t.withColumn("keywords", F.element_at(kws, F.col("id") + 1)).withColumn("samples", F.array().cast("array<string>"))
    return J.with_names_and_summaries(t, stub_generator).select("id", "tweet_count", "name", "summary", "used_generator")
