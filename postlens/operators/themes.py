"""Themes (D7-D9, G5, J1-J7).

Distributed parts: features (TF-IDF, ML form), KMeans fit/transform over all
posts, per-theme keywords and counts, theme-by-theme similarity (token
equi-joins, sparse dot products).  Only the theme table (≤ n_clusters rows)
and its pair scores (≤ n_clusters² rows) reach the driver, for the two greedy
walks (merge, MMR) that are inherently sequential.
"""

from __future__ import annotations

import datetime as _dt
import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import wordlists as W
from postlens.functions.columns import resolve, sentiment_key
from postlens.functions.text import (normalize_text, summary_terms, title_prompt_terms, with_fallback_title,
                                     with_generated_title)
from postlens.operators.cleaning import drop_repeated_posts
from postlens.operators.filters import timestamp_window
from postlens.operators.clustering import coreset, dense_themes, with_embeddings
from postlens.operators.keywords import (CodedTexts, coded_theme_keywords, keywords_per_group, theme_keywords, tfidf,
                                         weighted_keywords_per_group)
from postlens.operators.metrics import label_counts
from postlens.operators.sampling import first_n_per_group, newest_rows
from postlens.operators.scoring import tfidf_features
from postlens.session import cut_lineage, stored

THEME_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("tweet_count", T.LongType()),
    T.StructField("positive", T.LongType()), T.StructField("negative", T.LongType()),
    T.StructField("neutral", T.LongType()),
])


# ---------------------------------------------------------------------------
# D7-D9 clustering
# ---------------------------------------------------------------------------
def kmeans_assign(features: DataFrame, k: int, seed: int = 42, features_col: str = "features",
                  fit_sample: int | None = None, id_col: str = "id", max_iter: int = 300,
                  retry_if_short: bool = True, out_col: str = "theme", n_init: int = 1):
    """KMeans with ``k = max(2, k)`` and a fixed seed, fitted on all
    rows (or on a weighted coreset of about ``fit_sample``); when fewer than k clusters
    are non-empty, refit once on all rows with the next seed.  ``n_init``
    runs that many seeds and keeps the fit with the lowest cost.  Returns the
    fitted model; ``model.transform`` assigns every row (D8)."""
    from pyspark.ml.clustering import KMeans

    k = max(2, int(k))
    # fixed row order inside each (hash-determined) partition keeps the
    # seeded k-means|| initialisation reproducible without a global sort
    data = features.select(id_col, features_col).sortWithinPartitions(id_col).persist()
    try:
        train = coreset(data, fit_sample, seed, id_col, features_col).persist() if fit_sample else data
        # n_init > 1: several seeded fits, keep the lowest within-cluster cost
        model = None
        for i in range(max(1, int(n_init))):
            km = KMeans(k=k, seed=seed + i, featuresCol=features_col, predictionCol=out_col, maxIter=max_iter)
            m = (km.setWeightCol("weight") if fit_sample else km).fit(train)
            if model is None or m.summary.trainingCost < model.summary.trainingCost:
                model = m
        if retry_if_short:
            used = model.transform(data).select(out_col).distinct().count()
            if used < k:
                km2 = KMeans(k=k, seed=seed + 1, featuresCol=features_col, predictionCol=out_col, maxIter=max_iter)
                model = km2.fit(data)
        return model
    finally:
        data.unpersist(blocking=False)


# ---------------------------------------------------------------------------
# J1 name similarity and G5 candidate pairs
# ---------------------------------------------------------------------------
def similarity_tokens(name: Column | str, stopwords: Sequence[str] = W.THEME_STOPWORDS) -> Column:
    """C1 tokens of a theme name without stopwords and words of ≤ 2 letters."""
    toks = F.filter(F.split(normalize_text(name), " "), lambda w: w != "")
    return F.filter(toks, lambda w: ~w.isin(*stopwords) & (F.length(w) > 2))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """max(Jaccard, 0.3·synonym pair + 0.4·substring + 0.3·(≥2 common))."""
    n1, n2 = similarity_tokens(a), similarity_tokens(b)
    s1, s2 = F.array_distinct(n1), F.array_distinct(n2)
    inter = F.size(F.array_intersect(s1, s2))
    union = F.size(F.array_union(s1, s2))
    jac = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    pairs = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in W.SYNONYM_PAIRS])
    syn = F.exists(pairs, lambda p: (F.array_contains(s1, p[0]) & F.array_contains(s2, p[1]))
                   | (F.array_contains(s1, p[1]) & F.array_contains(s2, p[0])))
    j1, j2 = F.array_join(n1, " "), F.array_join(n2, " ")
    sub = (F.instr(j2, j1) > 0) | (F.instr(j1, j2) > 0)
    sem = F.lit(0.0)
    sem = sem + F.when(syn, F.lit(0.3)).otherwise(F.lit(0.0))
    sem = sem + F.when(sub, F.lit(0.4)).otherwise(F.lit(0.0))
    sem = sem + F.when(inter >= 2, F.lit(0.3)).otherwise(F.lit(0.0))
    return F.when((F.size(n1) == 0) | (F.size(n2) == 0), F.lit(0.0)).otherwise(F.greatest(jac, sem))


def similar_pairs(themes: DataFrame, threshold: float = 0.7, order_col: str = "pos") -> DataFrame:
    """Theme pairs (a before b in ``order_col``) with similarity ≥
    threshold.  Candidates come from an equi-join on shared name tokens or
    synonym links — every pair scoring above 0.4 shares one of the two — so
    no all-pairs product is built.  Thresholds ≤ 0.4 are rejected."""
    if threshold <= 0.4:
        raise ValueError("threshold must be above 0.4 (pairs below it need no shared token)")
    spark = themes.sparkSession
    toks = themes.select("id", order_col, "name", F.explode(F.array_distinct(similarity_tokens("name"))).alias("tok"))
    syn_rows = [F.struct(F.lit(w).alias("tok"), F.lit(f"syn:{i}").alias("key"))
                for i, (x, y) in enumerate(W.SYNONYM_PAIRS) for w in (x, y)]
    syn = spark.range(1).select(F.inline(F.array(*syn_rows)))
    keys = toks.select("id", order_col, "name", F.col("tok").alias("key")).unionByName(
        toks.join(F.broadcast(syn), "tok").select("id", order_col, "name", "key"))
    a = keys.select(*[F.col(c).alias(f"a_{c}") for c in ["id", order_col, "name", "key"]])
    b = keys.select(*[F.col(c).alias(f"b_{c}") for c in ["id", order_col, "name", "key"]])
    cand = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col(f"a_{order_col}") < F.col(f"b_{order_col}"))) \
        .select("a_id", f"a_{order_col}", "a_name", "b_id", f"b_{order_col}", "b_name").distinct()
    scored = cand.withColumn("score", name_similarity(F.col("a_name"), F.col("b_name")))
    return scored.where(F.col("score") >= threshold)


# ---------------------------------------------------------------------------
# J2 greedy merge, J3 MMR, J4 final set (driver walks over ≤ k rows)
# ---------------------------------------------------------------------------
def _theme_rows(themes: DataFrame) -> list[dict]:
    return [r.asDict() for r in themes.orderBy("pos").collect()]


def merge_similar_themes(themes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Walk themes in ``pos`` order; each unabsorbed theme absorbs every
    later unabsorbed theme whose similarity to it is ≥ threshold; counts are
    summed, id/name/summary come from the biggest member; result by size.
    ``themes`` is the small theme table (id, pos, name, summary, counts)."""
    spark = themes.sparkSession
    rows = _theme_rows(themes)
    pairs = {(r["a_id"], r["b_id"]) for r in similar_pairs(themes, threshold).select("a_id", "b_id").collect()}
    root: dict[int, int] = {}
    for i, t in enumerate(rows):
        if t["id"] in root:
            continue
        root[t["id"]] = t["id"]
        for t2 in rows[i + 1:]:
            if t2["id"] not in root and (t["id"], t2["id"]) in pairs:
                root[t2["id"]] = t["id"]
    mapping = spark.createDataFrame([(k, v) for k, v in root.items()], "id int, root int")
    m = themes.join(F.broadcast(mapping), "id")
    best = F.max_by(F.struct("id", "name", "summary"), F.struct(F.col("tweet_count"), -F.col("pos")))
    g = m.groupBy("root").agg(best.alias("b"), F.sum("tweet_count").alias("tweet_count"),
                              F.sum("positive").alias("positive"), F.sum("negative").alias("negative"),
                              F.sum("neutral").alias("neutral"), F.sort_array(F.collect_list("id")).alias("component_ids"))
    return g.select(F.col("b.id").alias("id"), F.col("b.name").alias("name"), F.col("b.summary").alias("summary"),
                    "tweet_count", "positive", "negative", "neutral", "component_ids") \
        .orderBy(F.col("tweet_count").desc(), "id")


def theme_vectors(posts: DataFrame, theme_col: str = "theme", text_col: str = "text", doc_col: str = "id",
                  max_features: int = 4000, max_docs_per_theme: int | None = None) -> DataFrame:
    """J3 helper: the normalised TF-IDF vectors of themes (a theme's term counts
    are the sums over its posts) as rows ``theme, term, weight``, at most
    ``max_features`` a theme, in a table in the shared folder."""
    src = posts.select(F.col(theme_col).alias("theme"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    if max_docs_per_theme:
        src = src.withColumn("_r", F.row_number().over(Window.partitionBy("theme").orderBy("doc"))) \
            .where(F.col("_r") <= max_docs_per_theme)
    # every theme is one "document": reuse the TF-IDF job with the theme as doc
    rows = tfidf(src.select("theme", "text"), "theme", "text", max_features=max_features, docs_are_groups=True)
    return stored(rows.select("theme", "term", "weight"), "theme-vectors")


def cosines(vectors: DataFrame, left: Sequence[int] | None = None, right: Sequence[int] | None = None) -> DataFrame:
    """Cosines ``(a, b, cosine)`` of the themes ``left`` with the themes
    ``right`` (default: all with all) that share a term, a ≠ b; a sparse dot
    product joined on the term."""
    of = lambda ids: vectors if ids is None else vectors.where(F.col("theme").isin(list(ids)))
    a = of(left).select(F.col("theme").alias("a"), "term", F.col("weight").alias("wa"))
    b = of(right).select(F.col("theme").alias("b"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def theme_cosines(posts: DataFrame, theme_col: str = "theme", text_col: str = "text", doc_col: str = "id",
                  max_features: int = 4000, max_docs_per_theme: int | None = None) -> DataFrame:
    """J3 helper: the cosines of all themes."""
    return cosines(theme_vectors(posts, theme_col, text_col, doc_col, max_features, max_docs_per_theme))


#: Theme pairs that are looked up at once in J3, and candidates of a look-up beyond that.
PAIRS, BLOCK = 65_536, 256


def mmr_order(sizes: dict[int, int], lookup: Callable[[list[int], list[int]], dict[tuple[int, int], float]] | dict[tuple[int, int], float],
              n: int, lam: float = 0.65, block: int = BLOCK) -> list[int]:
    """The order in which themes are taken, each the one with the largest
    λ·relative size − (1−λ)·penalty among those left; equal scores go by size,
    then id.  A theme's penalty is its largest cosine to a taken theme, 0 at
    least.

    Penalties only rise, so a score from some of the taken themes bounds the
    score from all.  Themes wait in a heap by their bounds; the first one is
    taken if its bound counts all taken themes, else it and the next ones, up
    to ``block``, are looked up against the taken themes that their bounds lack
    (``lookup(candidates, taken)`` gives cosines; missing ones are 0).  Most
    themes of a long tail are never looked up."""
    if isinstance(lookup, dict):
        known = lookup
        lookup = lambda left, right: {(a, b): known.get((a, b), 0.0) for a in left for b in right}
    largest = max(sizes.values(), default=0) or 1
    place = {i: p for p, i in enumerate(sorted(sizes, key=lambda i: (-sizes[i], i)))}
    penalty, seen = dict.fromkeys(sizes, 0.0), dict.fromkeys(sizes, 0)

    def entry(i: int) -> tuple[float, int, int]:
        return (-(lam * sizes[i] / largest - (1 - lam) * penalty[i]), place[i], i)

    heap = [entry(i) for i in sizes]
    heapq.heapify(heap)
    order: list[int] = []
    while heap and len(order) < n:
        first = heapq.heappop(heap)[2]
        if seen[first] == len(order):
            order.append(first)
            continue
        behind = [first]
        while heap and len(behind) < block and seen[heap[0][2]] < len(order):
            behind.append(heapq.heappop(heap)[2])
        found = lookup(behind, order[min(seen[i] for i in behind):])
        for i in behind:
            penalty[i] = max([penalty[i], *(found.get((i, t), 0.0) for t in order[seen[i]:])])
            seen[i] = len(order)
            heapq.heappush(heap, entry(i))
    return order


def mmr_select(themes: DataFrame, posts: DataFrame, n: int, lam: float = 0.65, **kw) -> DataFrame:
    """Diversity-aware choice of n themes; adds ``mmr_rank``.  The driver
    holds the themes' sizes, and cosines of pairs that the choice asks for; up
    to ``PAIRS`` pairs are looked up in one job."""
    themes = cut_lineage(themes)  # a small table, whose names may be counted from all posts; it is read twice
    sizes = {r["id"]: r["tweet_count"] for r in themes.select("id", "tweet_count").collect()}
    vectors = theme_vectors(posts, **kw)
    if len(sizes) ** 2 <= PAIRS:
        lookup = {(r["a"], r["b"]): r["cosine"] for r in cosines(vectors).collect()}
    else:
        def lookup(left: list[int], right: list[int]) -> dict[tuple[int, int], float]:
            return {(r["a"], r["b"]): r["cosine"] for r in cosines(vectors, left, right).collect()}
    order = mmr_order(sizes, lookup, n, lam)
    ranks = themes.sparkSession.createDataFrame(list(zip(order, range(1, len(order) + 1))), "id int, mmr_rank int")
    return themes.join(F.broadcast(ranks), "id").orderBy("mmr_rank")


def final_theme_set(themes: DataFrame, n: int, merge_similar: bool = True, keep_merged: bool = False,
                    threshold: float = 0.85) -> DataFrame:
    """Merge at ``threshold``; unless ``keep_merged``, revert to the
    unmerged themes when merging cannot keep n themes (observed behaviour);
    drop empty themes, sort by size, keep n."""
    base = themes.where(F.col("tweet_count") > 0)
    if merge_similar:
        merged = merge_similar_themes(base, threshold)
        n_merged = merged.count()
        n_base = base.count()
        if keep_merged or n_merged >= min(n, n_base):
            out = merged.drop("component_ids")
        else:
            out = base
    else:
        out = base
    return out.select("id", "name", "summary", "tweet_count", "positive", "negative", "neutral") \
        .orderBy(F.col("tweet_count").desc(), "id").limit(int(n))


# ---------------------------------------------------------------------------
# J6 template summary, J7 empty result, D10 generation
# ---------------------------------------------------------------------------
def template_summary(title: Column | str, keywords: Column | str, long: bool = False) -> Column:
    """``{title}: This theme focuses on {first 4 keywords}. …``."""
    t = F.col(title) if isinstance(title, str) else title
    k = F.col(keywords) if isinstance(keywords, str) else keywords
    tail = W.THEME_SUMMARY_TAIL_LONG if long else W.THEME_SUMMARY_TAIL
    return F.concat(t, F.lit(": This theme focuses on "), F.array_join(F.slice(k, 1, 4), ", "),
                    F.lit(". " + tail))


def empty_themes(spark: SparkSession) -> DataFrame:
    """No themes."""
    return spark.createDataFrame([], THEME_SCHEMA)


def generate_text(df: DataFrame, prompt_col: str, generate_fn: Callable[[str], str] | None, fallback_col: str,
                  out_col: str = "generated") -> DataFrame:
    """Run ``generate_fn`` on every prompt (in the executors, through
    ``mapInPandas``); an exception or an empty answer falls back to
    ``fallback_col``.  ``None`` → the fallback everywhere.  Adds
    ``<out_col>`` and ``used_generator``."""
    if generate_fn is None:
        return df.withColumn(out_col, F.col(fallback_col)).withColumn("used_generator", F.lit(False))
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                               T.StructField("used_generator", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            outs, used = [], []
            for prompt, fb in zip(pdf[prompt_col], pdf[fallback_col]):
                try:
                    g = generate_fn(prompt)
                except Exception:
                    g = None
                ok = isinstance(g, str) and g.strip() != ""
                outs.append(g if ok else fb)
                used.append(ok)
            yield pdf.assign(**{out_col: outs, "used_generator": used})

    return df.mapInPandas(run, schema)


def _filled(request: str, **values: Column) -> Column:
    """A request with columns in the places of their names, in the order they stand in."""
    parts, rest = [], request
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def title_prompt(keywords: Column | str, samples: Column | str) -> Column:
    """C17: what a generator is asked for a theme's name: the instruction with
    the taxonomy, the rules, the theme's business terms (C16) and the first 150
    characters of up to two of its posts.  Null posts are empty."""
    lines = F.transform(F.slice(F.col(samples) if isinstance(samples, str) else samples, 1, 2),
                        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(F.coalesce(x, F.lit("")), 1, 150), F.lit("...")))
    listed = F.when(F.size(lines) > 0, F.concat(F.lit(W.TITLE_SAMPLES_HEAD), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    request = _filled(W.TITLE_REQUEST, kws=F.array_join(F.slice(title_prompt_terms(keywords), 1, 8), ", "))
    return F.concat(F.lit(W.TITLE_INSTRUCTION + "\n"), request, listed, F.lit(W.TITLE_REQUEST_TAIL))


def summary_prompt(title: str, keywords: Column | str, samples: Column | str) -> Column:
    """C17: what a generator is asked for a theme's summary: the instruction,
    its name, terms (C16) and up to two whole posts as a JSON list."""
    posts = F.transform(F.slice(F.col(samples) if isinstance(samples, str) else samples, 1, 2), lambda x: F.coalesce(x, F.lit("")))
    request = _filled(W.SUMMARY_REQUEST, title=F.coalesce(F.col(title), F.lit("")),
                      kws=F.array_join(summary_terms(keywords, 6, W.SUMMARY_PROMPT_DEFAULT_TERMS), ", "), examples=F.to_json(posts))
    return F.concat(F.lit(W.SUMMARY_INSTRUCTION + "\n\n"), request)


def with_names_and_summaries(t: DataFrame, generate_fn: Callable[[str], str] | None, keywords: str = "keywords",
                             samples: str = "samples") -> DataFrame:
    """D10 for a theme table: ``name``, ``summary`` and ``used_generator``.
    Without a generator both come from the templates (C12, J6); with one, a
    name that fails, is empty or is rejected (C13) is the fallback title, and
    a summary that fails or is empty is the long template."""
    t = with_fallback_title(t, keywords, "fallback").withColumn("prompt", title_prompt(keywords, samples))
    t = generate_text(t, "prompt", generate_fn, "fallback", "raw_name").withColumnRenamed("used_generator", "named")
    t = with_generated_title(t, "raw_name", "fallback", "cleaned_name")
    t = t.withColumn("name", F.when(F.col("named"), F.col("cleaned_name")).otherwise(F.col("fallback")))
    if generate_fn is None:
        return t.withColumn("summary", template_summary("name", keywords)).withColumn("used_generator", F.lit(False)).drop("named")
    t = t.withColumn("template", template_summary("name", summary_terms(keywords, 4, W.SUMMARY_DEFAULT_TERMS), long=True))
    t = t.withColumn("prompt", summary_prompt("name", keywords, samples))
    t = generate_text(t, "prompt", generate_fn, "template", "summary")
    return t.withColumn("used_generator", F.col("named") | F.col("used_generator")).withColumn("summary", F.trim("summary")).drop("named", "template")


# ---------------------------------------------------------------------------
# J5 whole theme job
# ---------------------------------------------------------------------------
def compute_themes(df: DataFrame, n_clusters: int = 12, start=None, end=None, max_rows: int | None = None,
                   fit_sample: int | None = None, merge_similar: bool = True, keep_merged: bool = False,
                   generate_fn: Callable[[str], str] | None = None, seed: int = 42,
                   vocab_size: int = 3000, features: DataFrame | None = None, n_init: int = 1,
                   embedder: Callable | None = None) -> dict:
    """Dedupe → window → newest rows → vectors → KMeans → keywords →
    counts → names/summaries → final set.  Vectors are TF-IDF unless
    ``features`` (id, features) or an ``embedder`` is given: a factory of a
    text encoder, loaded once per worker (D6).  A ``fit_sample`` is a weighted
    coreset of about so many rows.  Themes without keywords of their own (C8)
    get weighted ones (C6).  Returns ``{"themes": DataFrame, "posts": DataFrame
    (with theme), "run": one-row DataFrame}``; nothing stays in executors'
    storage.  Texts are read twice and stored as codes of words alone, on which
    fits and keywords work; ``posts`` are the input's rows with the theme that
    the model gives them, by text, or by id with an embedder."""
    spark = df.sparkSession
    if "theme" in df.columns:
        df = df.drop("theme")  # this job assigns the themes
    id_col = resolve(df, W.ID_DEDUPE, "id", required=False)
    data = drop_repeated_posts(df) if id_col else df
    text_col = resolve(data, W.TEXT_THEMES, "text")
    date_col = resolve(data, W.DATE_THEMES, "date", required=False)
    if date_col:
        data = timestamp_window(data, start, end, date_col)
        if max_rows:
            data = newest_rows(data, max_rows, date_col, id_col or date_col)
    elif max_rows:
        data = data.orderBy(F.xxhash64(*data.columns), *data.columns).limit(int(max_rows))
    if id_col is None:
        # an id that every run gives again: the row's hash, and its number among equal rows
        row = F.xxhash64(*data.columns)
        again = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
        data = data.withColumn("_row", row).withColumn("id", F.concat_ws("-", "_row", again)).drop("_row")
        id_col = "id"
    data = data.withColumnRenamed(id_col, "id") if id_col != "id" else data
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    if data.isEmpty():
        run = spark.createDataFrame([(now, False, 0)], "updated_at timestamp_ntz, used_llm boolean, "
                                                        "source_row_count long")
        return {"themes": empty_themes(spark), "posts": data.withColumn("theme", F.lit(None).cast("int")),
                "run": run}
    label = ["sentiment_label"] if "sentiment_label" in data.columns else []
    if features is not None:
        scored, _ = dense_themes(data.join(features.select("id", "features"), "id"), n_clusters, seed, fit_sample=fit_sample, n_init=n_init)
        assigned = themed = stored(scored.drop("features"), "themed-posts")
        texts = None
    else:
        if embedder is not None:
            texts = CodedTexts(with_embeddings(data, text_col, embedder), ["id", *label, "features"], text_col, W.ENGLISH_STOPWORDS)
            themed, _ = dense_themes(texts.table, n_clusters, seed, fit_sample=fit_sample, n_init=n_init)
            of = stored(themed.select(F.col("id").alias("_id"), "theme"), "themes-of-posts")
            assigned = data.join(of, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
        else:
            texts = CodedTexts(data, ["id", *label], text_col, W.ENGLISH_STOPWORDS)
            featurize, feats = tfidf_features(data, text_col, vocab_size=vocab_size, texts=texts)
            model = kmeans_assign(feats, n_clusters, seed=seed, fit_sample=fit_sample, n_init=n_init)
            themed, assigned = [model.transform(featurize(frame)).drop("features").withColumn("theme", F.col("theme").cast("int")) for frame in (texts.table, data)]
            themed = stored(themed, "themed-codes")  # the model runs once for the passes that follow
    key = sentiment_key(F.col("sentiment_label")) if label else F.lit(None)
    counts = cut_lineage(themed.groupBy("theme").agg(F.count("*").alias("tweet_count"), *label_counts(key)))
    sizes = {r["theme"]: r["tweet_count"] for r in counts.select("theme", "tweet_count").collect()}
    kws = coded_theme_keywords(texts, themed, sizes) if texts is not None else None
    kws = keywords_per_group(theme_keywords(assigned, "theme", "id", text_col) if kws is None else kws)
    t = cut_lineage(counts.join(kws, "theme", "left"))
    bare = t.where(F.col("keywords").isNull()).select(F.col("theme").alias("_theme"))
    if not bare.isEmpty():  # themes whose terms are all dropped
        own = weighted_keywords_per_group(assigned.join(F.broadcast(bare), F.col("theme") == F.col("_theme"), "left_semi"), "theme", text_col)
        own = keywords_per_group(own).select(F.col("theme").alias("_theme"), F.col("keywords").alias("_own"))
        t = t.join(own, F.col("theme") == F.col("_theme"), "left").withColumn("keywords", F.coalesce("keywords", "_own")).drop("_theme", "_own")
    t = t.withColumn("keywords", F.coalesce(F.col("keywords"),
                                            F.array(*[F.lit(w) for w in W.DEFAULT_KEYWORDS])))
    if generate_fn is None:
        t = t.withColumn("samples", F.array().cast("array<string>"))
    else:  # two posts of each theme for the prompts
        own = assigned.select("theme", "id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        own = first_n_per_group(own, "theme", 2, [F.col("id")]).groupBy(F.col("theme").alias("_theme")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("id", "_text"))), lambda x: x["_text"]).alias("samples"))
        t = t.join(own, F.col("theme") == F.col("_theme"), "left").drop("_theme")
    t = with_names_and_summaries(t, generate_fn)
    themes = t.select(F.col("theme").alias("id"), "name", "summary", "tweet_count", "positive", "negative",
                      "neutral", "used_generator")
    themes = themes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("tweet_count").desc(), "id")))
    themes = cut_lineage(themes)
    used_llm = bool(themes.where(F.col("used_generator")).limit(1).count())
    final = final_theme_set(themes.drop("used_generator"), n_clusters, merge_similar, keep_merged)
    n_rows = sum(sizes.values())
    run = spark.createDataFrame([(now, used_llm, n_rows)],
                                "updated_at timestamp_ntz, used_llm boolean, source_row_count long")
    return {"themes": final, "posts": assigned, "run": run}
