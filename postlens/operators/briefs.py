"""Period summaries and briefs (C14, C17, K1-K4).

Every brief is a small table computed from aggregates of the post table:
one-row aggregates are combined by broadcast joins on a constant key, text
is assembled with ``concat``/``format_string`` in the JVM, and an optional
user generator runs in the executors through ``mapInPandas`` (D10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import wordlists as W
from postlens.functions.columns import aspect_display, pretty_label, resolve, sentiment_key
from postlens.operators.filters import date_window, keyword_filter, timestamp_window
from postlens.functions.text import split_tokens
from postlens.operators.keywords import basic_token_filter, top_keywords
from postlens.operators.metrics import basic_stats, label_counts
from postlens.operators.sampling import balanced_sample, seeded_sample
from postlens.operators.themes import generate_text

BRIEF_SCHEMA = T.StructType([T.StructField(k, T.ArrayType(T.StringType()))
                             for k in ("executive_bullets", "themes", "risks", "opportunities")])


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(0))


def _join_rows(*dfs: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side; each side has exactly one row,
    so the join that is left of the constant key makes one."""
    out = _one(dfs[0])
    for d in dfs[1:]:
        out = out.join(F.broadcast(_one(d)), "_k")
    return out.drop("_k")


def _fmt1(x: Column) -> Column:
    """``toFixed(1)`` of a percentage: round half-up to 1 dp, then print."""
    return F.format_string("%.1f", F.round(x, 1))


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def aspect_facts(sub: DataFrame, aspect: Column, key: Column, top: int, order: Column | None = None,
                 counts: dict[str, Column] | None = None, means: dict[str, Column] | None = None) -> DataFrame:
    """One row from one pass: ``total``, what else is counted (``counts``) or averaged (``means``) over all rows, and
    ``aspects``, the ``top`` first aspects by ``order`` (default their rows, most first) as structs ``rank, aspect, n,
    positive, neutral, negative``.

    Grouping sets count each aspect and everything in one aggregate; the cut to ``top`` is a ranking that Spark limits
    within tasks too; what is left, at most ``top`` + 1 rows, is folded into one.  An empty input gives zeros."""
    counts, means = counts or {}, means or {}
    rows = sub.select(aspect.alias("_aspect"), key.alias("_key"), *[c.alias(f"_{n}") for n, c in {**counts, **means}.items()])
    g = rows.groupingSets([[F.col("_aspect")], []], "_aspect").agg(
        F.count(F.lit(1)).alias("n"), *label_counts(F.col("_key")), *[F.count_if(F.col(f"_{n}")).alias(f"_{n}") for n in counts],
        *[F.avg(f"_{n}").alias(f"_{n}") for n in means], F.grouping("_aspect").alias("_all"))
    first = Window.partitionBy("_all").orderBy((F.col("n") if order is None else order).desc(), F.col("_aspect"))
    g = g.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    every = F.col("_all") == 1
    whole = [F.coalesce(F.max(F.when(every, F.col(c))), F.lit(0)).alias(n) for n, c in [("total", "n"), *((n, f"_{n}") for n in counts)]]
    found = F.array_sort(F.collect_list(F.when(~every, F.struct("rank", F.col("_aspect").alias("aspect"), "n", *W.SENTIMENTS))))
    return g.agg(*whole, *[F.max(F.when(every, F.col(f"_{n}"))).alias(n) for n in means], found.alias("aspects"))


# ---------------------------------------------------------------------------
# C14 JSON extraction, C17 prompts
# ---------------------------------------------------------------------------
def extract_brief_json(text: Column | str) -> Column:
    """C14: the last fenced ```json block, else the span from the first ``{``
    to the last ``}``; parsed into four string lists (empty when there is
    nothing to parse or it does not parse)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(r"```json\s*(\{[\s\S]*?\})\s*```"), 1)
    last_block = F.try_element_at(blocks, F.lit(-1))
    first = F.instr(t, "{")
    last = F.length(t) - F.instr(F.reverse(t), "}") + 1
    span = F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substring(t, first, last - first + 1))
    cand = F.coalesce(last_block, span)
    parsed = F.from_json(cand, BRIEF_SCHEMA, {"mode": "PERMISSIVE"})
    empty = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(parsed[k], empty).alias(k) for k in BRIEF_SCHEMA.fieldNames()])


# FIXED VALUES — the structured-brief prompt (C17); the sentence templates of
# K1, K2 and K4 below are likewise the reference's output texts, kept verbatim
# inside the Column expressions that fill them.
BRIEF_PROMPT_HEAD = (
    "You are an analytics copilot generating an **executive brief** of Twitter/X chatter about Walmart.\n\n"
    "TIME WINDOW: {start} → {end}\nKEYWORD FILTER: {keyword}\n\n"
    "BASIC STATS (from analytics pipeline):\n{stats}\n\n"
    "SAMPLE TWEETS (cleaned, representative subset):\n- "
)
BRIEF_PROMPT_TAIL = (
    "\n\nWrite:\n"
    "1) 5–8 bullet executive brief (impactful, business-ready).\n"
    "2) A short paragraph on key drivers and pain points.\n"
    "3) 4–6 concise theme labels (Title Case).\n"
    "4) A strict JSON object with keys: executive_bullets (list[str]), themes (list[str]), risks (list[str]), "
    "opportunities (list[str]).\n\n"
    "Rules:\n"
    "- Be specific but avoid hallucinating numbers not present in data.\n"
    "- Use neutral tone; no fluff.\n"
    "- If the data is thin, say so explicitly.\n"
)


def brief_prompt(stats: Column, examples: Column, start: str | None, end: str | None,
                 keyword: str | None) -> Column:
    """C17: the structured-brief prompt from a stats text and an array of
    sample texts."""
    head = BRIEF_PROMPT_HEAD.format(start=start, end=end, keyword=keyword or "None", stats="%s")
    return F.concat(F.format_string(head, stats), F.array_join(examples, "\n- "), F.lit(BRIEF_PROMPT_TAIL))


# ---------------------------------------------------------------------------
# K1 period summary (template path, optional generator)
# ---------------------------------------------------------------------------
#: FIXED VALUES — posts in the prompt of K1, and its closing sentences
PROMPT_POSTS = 120
SUMMARY_PROMPT_TAIL = ("Write 1–2 short paragraphs summarizing the period, citing the main issues/opportunities, "
                       "and finish with 2–3 actionable focus areas. Do not invent numeric metrics.")


def period_facts(posts: DataFrame, text_col: str | None, top_aspects: int, keywords: int) -> DataFrame:
    """One row of K1's counts, top dominant aspects (F13: ``aspect, n, pos, neg, neu``, the fallback removed after the
    cut) and most frequent tokens (C5) from one pass over the posts: each post gives one row for itself, one for its
    aspect and one for each of its tokens, all are counted in one aggregate, and at most ``keywords`` of a kind go on.
    Without a text column there are no keywords."""
    key = sentiment_key(F.col("sentiment_label"))
    # tokens have no capitals: P is the post itself, A its aspect, N the lack of one
    facts = F.array(F.lit("P"), F.coalesce(F.concat(F.lit("A"), F.col("aspect_dominant")), F.lit("N")))
    if text_col:
        facts = F.concat(facts, F.when(F.col("sentiment_label").isin(*W.SENTIMENTS), split_tokens(text_col)).otherwise(F.array().cast("array<string>")))
    fact = F.col("fact")
    rows = posts.select(key.alias("_key"), F.explode(facts).alias("fact"))
    rows = rows.where(((fact >= "A") & (fact < "Z")) | basic_token_filter(fact)) if text_col else rows
    g = rows.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), *label_counts(F.col("_key")))
    kind = F.when(fact == "P", F.lit("post")).when(fact.startswith("A") | (fact == "N"), F.lit("aspect")).otherwise(F.lit("token"))
    g = g.select(kind.alias("kind"), F.when(kind == "aspect", F.when(fact != "N", F.substring(fact, 2, 1 << 30))).otherwise(fact).alias("key"), "n", *W.SENTIMENTS)
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), F.col("key"))
    cut = F.when(F.col("kind") == "aspect", F.lit(top_aspects)).otherwise(F.lit(keywords))
    g = g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(top_aspects, keywords)).where(F.col("rank") <= cut)
    post = F.col("kind") == "post"
    counts = [F.coalesce(F.max(F.when(post, F.col(c))), F.lit(0)).alias(n) for c, n in [("n", "total"), *((s, s) for s in W.SENTIMENTS)]]
    aspects = F.array_sort(F.collect_list(F.when(F.col("kind") == "aspect", F.struct("rank", F.col("key").alias("aspect"), "n", "positive", "negative", "neutral"))))
    aspects = F.filter(aspects, lambda a: aspect_display(a["aspect"]) != W.ASPECT_FALLBACK)
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("rank", "key")))), lambda t: t["key"])
    return g.agg(*counts, aspects.alias("top_aspects"), words.alias("words"))


def period_prompt(start: str, end: str, examples: Column) -> Column:
    """K1/C17: what a generator is asked for a period: the window, its counts, aspects and first ten keywords as JSON, and
    example posts."""
    total = F.col("total")
    share = lambda s: F.when(total > 0, F.round(F.col(s) / total * 100, 2)).otherwise(F.lit(0.0))
    grounding = F.to_json(F.struct(
        F.struct(total.alias("total"), F.struct(*W.SENTIMENTS).alias("counts"), F.struct(*[share(s).alias(s) for s in W.SENTIMENTS]).alias("percent")).alias("sentiment"),
        F.transform("top_aspects", lambda a: F.struct(a["aspect"].alias("aspect"), a["n"].alias("count"), a["positive"].alias("pos"),
                                                      a["negative"].alias("neg"), a["neutral"].alias("neu"))).alias("top_aspects"),
        F.slice("words", 1, 10).alias("keywords")))
    listed = F.array_join(F.transform(examples, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat(F.lit(f"Date window: {start} to {end}\nGrounding (JSON): "), grounding, F.lit("\nExamples ("), F.size(examples).cast("string"),
                    F.lit(" tweets):\n"), listed, F.lit("\n\n" + SUMMARY_PROMPT_TAIL))


def example_posts(sub: DataFrame, text_col: str, per_sentiment: int, limit: int = PROMPT_POSTS) -> DataFrame:
    """One row: ``examples``, the first ``limit`` texts of a balanced sample (H5): negative, then positive, then neutral
    posts, each by date and id."""
    rows = balanced_sample(sub, min(per_sentiment, limit)).select("label_order", "pos", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = F.array_sort(F.collect_list(F.struct("label_order", "pos", "_text")))
    return rows.agg(F.slice(F.transform(found, lambda r: r["_text"]), 1, limit).alias("examples"))


def executive_summary(df: DataFrame, start: str, end: str, aspects_df: DataFrame | None = None,
                      sample_per_sentiment: int | None = None, generate_fn: Callable[[str], str] | None = None,
                      top_k_aspects: int = 6, with_prompt: bool = False) -> DataFrame:
    """K1: window counts (F3), top dominant aspects (F13), keywords (C5) of all
    labelled posts of the window, or of a balanced sample (H5) if
    ``sample_per_sentiment`` is given → one-row summary, from one pass over the
    posts (the sample, and the example posts that a generator is given, are
    read apart).  Without a generator, the template text; an empty window gives
    the empty-period message."""
    sub = date_window(df, start, end)
    text_col = resolve(df, W.TEXT_THEMES, "text")
    row = period_facts(sub, None if sample_per_sentiment else text_col, top_k_aspects, 12)
    if sample_per_sentiment:
        kw = top_keywords(balanced_sample(sub, sample_per_sentiment), text_col, k=12)
        kw = kw.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("words"))
        row = _join_rows(row.drop("words"), kw)
    if aspects_df is not None:
        row = _join_rows(row.drop("top_aspects"), period_facts(date_window(aspects_df, start, end), None, top_k_aspects, 12).select("top_aspects"))
    row = row.withColumn("aspects", F.array_join(F.transform(F.slice("top_aspects", 1, 4), lambda a: a["aspect"]), ", ")) \
        .withColumn("keywords", F.array_join(F.slice("words", 1, 6), ", "))
    aspects_txt = F.when(F.col("aspects") != "", F.col("aspects")).otherwise(F.lit("various areas"))
    kw_txt = F.when(F.col("keywords") != "", F.col("keywords")).otherwise(F.lit("common customer concerns"))
    template = F.concat(
        F.lit(f"Between {start} and {end}, customers discussed "), aspects_txt, F.lit(". "),
        F.lit("Sentiment shows "), F.col("negative").cast("string"), F.lit(" negative, "),
        F.col("neutral").cast("string"), F.lit(" neutral, and "), F.col("positive").cast("string"),
        F.lit(" positive posts. "), F.lit("Prominent phrases included "), kw_txt, F.lit(". "),
        F.lit("Focus next on resolving key negative drivers and reinforcing positive experiences."))
    row = row.withColumn("template", F.when(F.col("total") == 0, F.lit(W.EMPTY_PERIOD_SUMMARY)).otherwise(template))
    if generate_fn is not None or with_prompt:
        row = _join_rows(row, example_posts(sub, text_col, sample_per_sentiment or 250))
        row = row.withColumn("prompt", period_prompt(start, end, F.col("examples")))
    row = generate_text(row, "prompt", generate_fn, "template", "summary")
    return row.select(F.lit(start).alias("start"), F.lit(end).alias("end"),
                      (F.col("used_generator") & (F.col("total") > 0)).alias("used_llm"), "summary", "total",
                      "positive", "neutral", "negative", "aspects", "keywords", *(["prompt"] if with_prompt else []))


# ---------------------------------------------------------------------------
# K2 rule-based period summary
# ---------------------------------------------------------------------------
def rule_based_summary(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """K2: tone from the label shares (negative > 40 → predominantly
    negative, else neutral > 40 → largely neutral, else mixed), score band
    (> 0.7 moderately positive, > 0.5 neutral, else negative), up to three
    focus aspects from the five most frequent, and recommendations."""
    from postlens.operators.filters import where_clause

    exact = {s: F.col("sentiment_label") == s for s in W.SENTIMENTS}
    row = aspect_facts(where_clause(df, start, end), F.col("aspect_dominant"), F.col("sentiment_label"), 5, counts=exact,
                       means={"avg_raw": F.col("sentiment_score")})
    shown = F.transform("aspects", lambda a: aspect_display(a["aspect"]))
    row = row.withColumn("shown", F.slice(F.filter(shown, lambda x: x != W.ASPECT_FALLBACK), 1, 3))
    lines = F.transform("shown", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), pretty_label(x, "first"),
                                                       F.lit(" - A primary area of discussion among users\n")))
    row = row.withColumn("focus_lines", F.array_join(lines, "")).withColumn("top0", F.try_element_at("shown", F.lit(1))) \
        .withColumn("top_aspects", F.array_join("shown", ", "))
    tot = F.col("total")
    p = {s: F.when(tot > 0, F.round(F.col(s) / tot * 100, 1)).otherwise(F.lit(0.0)) for s in W.SENTIMENTS}
    txt = {s: F.when(tot > 0, _fmt1(F.col(s) / tot * 100)).otherwise(F.lit("0")) for s in W.SENTIMENTS}
    avg = F.coalesce(F.col("avg_raw"), F.lit(0.0))
    tone = F.when(p["negative"] > 40, "predominantly negative").when(p["neutral"] > 40, "largely neutral") \
        .otherwise("mixed")
    band = F.when(avg > 0.7, "moderately positive").when(avg > 0.5, "neutral").otherwise("negative")
    top0 = F.col("top0")
    text = F.concat(
        F.lit("Executive Summary: Analysis of "), _thousands(tot), F.lit(f" social media conversations from {start} "
                                                                         f"to {end}.\n\n"),
        F.lit("Sentiment Overview:\n"), F.lit("The data reveals a "), tone, F.lit(" sentiment landscape. "),
        txt["negative"], F.lit("% of conversations express negative sentiment, while "), txt["positive"],
        F.lit("% are positive and "), txt["neutral"], F.lit("% are neutral. "),
        F.lit("The average sentiment score of "), F.format_string("%.2f", F.round(avg, 2)), F.lit(" indicates "),
        band, F.lit(" overall sentiment.\n\n"),
        F.when(F.col("focus_lines") != "", F.concat(F.lit("Key Focus Areas:\n"), F.col("focus_lines"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.lit("Recommendations:\n"),
        F.when(p["negative"] > 40, F.concat(
            F.lit("• Address negative sentiment concerns proactively, particularly in "),
            F.coalesce(top0, F.lit("key areas")),
            F.lit("\n• Monitor trending topics and respond to customer pain points\n"))).otherwise(F.lit("")),
        F.lit("• Leverage positive sentiment in "), F.coalesce(top0, F.lit("identified areas")),
        F.lit(" to strengthen brand positioning\n"),
        F.lit("• Continue monitoring sentiment trends to identify emerging patterns"))
    return row.select(text.alias("summary"), F.lit(False).alias("used_llm"), "total", "positive", "negative",
                      "neutral", p["positive"].alias("positive_pct"), p["negative"].alias("negative_pct"),
                      p["neutral"].alias("neutral_pct"), F.round(avg, 6).alias("average_sentiment_score"),
                      F.coalesce(F.col("top_aspects"), F.lit("")).alias("top_aspects"))


# ---------------------------------------------------------------------------
# K3 structured brief (prompt; generated text optional)
# ---------------------------------------------------------------------------
def structured_brief(df: DataFrame, start: str | None = None, end: str | None = None, keyword: str | None = None,
                     sample_size: int = 50, generate_fn: Callable[[str], str] | None = None) -> DataFrame:
    """K3: window (whole end day) + keyword filter + basic stats (F15) +
    seeded sample (H4) → prompt (C17) → generated text → JSON (C14)."""
    date_col = resolve(df, W.DATE_BRIEF + W.DATE_API, "date")
    text_col = resolve(df, W.TEXT_BRIEF, "text")
    sub = timestamp_window(df, start, end, date_col)
    sub = keyword_filter(sub, keyword, text_col)
    stats = basic_stats(sub, aspect_col="aspect", keywords_col="topic_keywords")
    stats_row = stats.agg(F.to_json(F.sort_array(F.collect_list(F.struct("metric", "rank", "key", "value"))))
                          .alias("stats"), F.max(F.when(F.col("metric") == "n_tweets", F.col("value"))).alias("n"))
    sample = seeded_sample(sub.where(F.col(text_col).isNotNull()), sample_size)
    ex_row = sample.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(text_col).cast("string")
                                                                          .alias("t")))), lambda s: s["t"])
                        .alias("examples"))
    row = _join_rows(stats_row, ex_row)
    row = row.withColumn("prompt", brief_prompt(F.col("stats"), F.col("examples"), start, end, keyword))
    empty_msg = F.lit(f"No tweets found for {start} to {end} keyword={keyword}")
    row = row.withColumn("fallback", F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, empty_msg))
    row = generate_text(row, "prompt", generate_fn, "fallback", "executive_text")
    return row.select(F.coalesce(F.col("n"), F.lit(0)).alias("n_tweets"), "prompt", "executive_text",
                      extract_brief_json(F.col("executive_text")).alias("structured"))


# ---------------------------------------------------------------------------
# K4 rule-based brief
# ---------------------------------------------------------------------------
def rule_based_brief(df: DataFrame, start: str | None, end: str | None, top_n: int = 5) -> DataFrame:
    """K4: ``(section, rank, text)`` rows — executive text, bullets, themes
    (top 4 aspects), risks (aspect negative share > 50 %, overall > 40 %),
    opportunities (aspect positive share > 30 %, overall > 25 %), with the
    default sentences when a list is empty."""
    from postlens.operators.filters import where_clause

    # labels count as they are in the totals, and by their key (case, null) in the aspects
    three = F.col("positive") + F.col("neutral") + F.col("negative")
    row = aspect_facts(where_clause(df, start, end), aspect_display(F.col("aspect_dominant")), sentiment_key(F.col("sentiment_label")),
                       top_n + 1, three, counts={s: F.col("sentiment_label") == s for s in W.SENTIMENTS})  # the fallback may be one of them
    g = F.transform(F.slice(F.filter("aspects", lambda a: a["aspect"] != W.ASPECT_FALLBACK), 1, top_n), lambda a: F.struct(
        pretty_label(a["aspect"], "first").alias("name"), (a["positive"] + a["neutral"] + a["negative"]).alias("t"),
        a["positive"].alias("positive"), a["negative"].alias("negative")))
    row = row.withColumn("g", g).withColumn("names", F.transform("g", lambda a: a["name"])).withColumn("top_t", F.try_element_at("g", F.lit(1))["t"])
    of = lambda n, t: F.coalesce(F.try_divide(n, t) * 100, F.lit(0.0))
    tot = F.col("total")
    share = {s: _fmt1(of(F.col(s), tot)) for s in W.SENTIMENTS}
    none = F.array().cast("array<string>")
    risks = F.transform(F.filter("g", lambda a: of(a["negative"], a["t"]) > 50), lambda a: F.concat(
        F.lit("High negative sentiment ("), _fmt1(of(a["negative"], a["t"])), F.lit("%) in "), a["name"],
        F.lit(" indicates customer dissatisfaction requiring urgent intervention")))
    risk_all = F.array(F.lit("Overall negative sentiment exceeds 40%, suggesting systemic issues that need comprehensive review"))
    opps = F.transform(F.filter("g", lambda a: of(a["positive"], a["t"]) > 30), lambda a: F.concat(
        F.lit("Strong positive sentiment ("), _fmt1(of(a["positive"], a["t"])), F.lit("%) in "), a["name"],
        F.lit(" presents an opportunity to amplify and leverage customer satisfaction")))
    opp_all = F.array(F.concat(F.lit("Significant positive sentiment base ("), share["positive"],
                               F.lit("%) can be leveraged for brand advocacy and marketing initiatives")))
    row = row.withColumn("risks", F.concat(risks, F.when(F.col("negative") > tot * 0.4, risk_all).otherwise(none))) \
        .withColumn("opps", F.concat(opps, F.when(F.col("positive") > tot * 0.25, opp_all).otherwise(none)))
    opps_final = F.when(F.size("opps") > 0, F.col("opps")).otherwise(
        F.array(F.lit("Focus on improving customer experience to increase positive sentiment across all aspects")))
    risks_final = F.when(F.size("risks") > 0, F.col("risks")).otherwise(
        F.array(F.lit("Monitor sentiment trends closely for emerging issues")))
    themes = F.slice(F.col("names"), 1, 4)
    bullets = F.filter(F.array(
        F.concat(F.lit("Analyzed "), _thousands(tot), F.lit(f" social media conversations from {start} to {end}")),
        F.concat(F.lit("Sentiment distribution: "), share["positive"], F.lit("% positive, "), share["negative"],
                 F.lit("% negative, "), share["neutral"], F.lit("% neutral")),
        F.when(F.size("names") > 0, F.concat(F.try_element_at(F.col("names"), F.lit(1)),
                                             F.lit(" is the most discussed topic with "),
                                             _thousands(F.col("top_t")), F.lit(" mentions"))),
        F.when(F.col("negative") > F.col("positive") * 1.5,
               F.lit("Negative sentiment significantly outweighs positive, indicating areas requiring immediate "
                     "attention"))), lambda x: x.isNotNull())
    exec_text = F.concat(
        F.lit("Executive Brief: "), _thousands(tot), F.lit(f" conversations analyzed from {start} to {end}. "),
        F.lit("Sentiment analysis reveals "), share["negative"], F.lit("% negative, "), share["positive"],
        F.lit("% positive, and "), share["neutral"], F.lit("% neutral sentiment. "),
        F.lit("Key focus areas include "), F.array_join(F.slice(themes, 1, 3), ", "), F.lit(". "),
        F.when(F.size("risks") > 0, F.concat(F.lit("Primary risks: "), F.try_element_at(F.col("risks"), F.lit(1)),
                                             F.lit(". "))).otherwise(F.lit("")),
        F.concat(F.lit("Key opportunities: "), F.try_element_at(opps_final, F.lit(1)), F.lit(".")))
    sections = F.array(
        F.struct(F.lit("executive_text").alias("section"), F.array(exec_text).alias("items")),
        F.struct(F.lit("executive_bullets").alias("section"), bullets.alias("items")),
        F.struct(F.lit("themes").alias("section"), themes.alias("items")),
        F.struct(F.lit("risks").alias("section"), risks_final.alias("items")),
        F.struct(F.lit("opportunities").alias("section"), opps_final.alias("items")))
    ex = row.select(F.inline(sections))
    return ex.select("section", F.posexplode("items").alias("rank", "text")) \
        .select("section", (F.col("rank") + 1).alias("rank"), "text")

