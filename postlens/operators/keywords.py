"""Token-level operators.

Exploded tokens are the widest intermediate of the library, so every
operator aggregates them as early as possible: counts are pre-aggregated per
(document, token) map-side, word lists are literal ``IN`` sets or broadcast
joins of bounded lists, and top-k cuts use ``orderBy().limit()``
(per-partition top-k, then a merge) rather than a global window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import wordlists as W
from postlens.functions.text import is_noise, split_tokens
from postlens.operators import coded as C
from postlens.operators.cutting import Cutter
from postlens.session import cut_lineage, stored

# Unicode words of two or more characters (the sklearn default token pattern)
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]+"


#: Bytes of text in a partition of text-heavy stages: its n-grams are some twenty times that.
TEXT_BYTES = 16 << 20


def text_partitions(df: DataFrame, text_col: str) -> int:
    """Partitions for text-heavy stages, by the bytes of all texts (one pass
    that reads this column alone), at least the cluster's default parallelism.
    An array of terms counts by its elements' bytes."""
    size = F.octet_length(text_col) if df.schema[text_col].dataType.simpleString() == "string" else \
        F.aggregate(text_col, F.lit(0), lambda n, x: n + F.octet_length(x))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(-(-total // TEXT_BYTES), df.sparkSession.sparkContext.defaultParallelism)


# ---------------------------------------------------------------------------
# C2 / C3 / G6
# ---------------------------------------------------------------------------
def explode_tokens(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per whitespace token of the normalised text."""
    return df.select(*keep, F.explode(split_tokens(text_col)).alias("token")).where(F.col("token") != "")


def basic_token_filter(tok: Column, stopwords: Sequence[str] = W.SUMMARY_STOPWORDS) -> Column:
    """Length ≥ 3, not a stopword, not all digits."""
    return (F.length(tok) >= 3) & ~tok.isin(*stopwords) & ~_all_digits(tok)


def _all_digits(tok: Column) -> Column:
    """Whether a token is a number; the pattern is tried on those that don't begin with a letter."""
    return (tok < "a") & tok.rlike(r"^[0-9]+$")


def remove_stopwords(tokens_df: DataFrame, stopwords: DataFrame, token_col: str = "token",
                     max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Anti-join against a stop-word table.  The table is broadcast only
    when its row count is under ``max_broadcast_rows``; otherwise a shuffled
    anti-join is planned."""
    words = stopwords.select(F.col(stopwords.columns[0]).alias(token_col)).distinct()
    n = words.count()
    right = F.broadcast(words) if n <= max_broadcast_rows else words
    return tokens_df.join(right, token_col, "left_anti")


# ---------------------------------------------------------------------------
# C5 / C6 top keywords
# ---------------------------------------------------------------------------
def top_keywords(df: DataFrame, text_col: str = "text", k: int = 12,
                 stopwords: Sequence[str] = W.SUMMARY_STOPWORDS) -> DataFrame:
    """The k most frequent tokens after the basic filter → ``(rank, keyword,
    count)``; ties by token."""
    toks = explode_tokens(df, text_col).where(basic_token_filter(F.col("token"), stopwords))
    top = toks.groupBy("token").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "token").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.col("count").desc(), "token")).alias("rank"),
                      F.col("token").alias("keyword"), "count")


def weighted_keywords(df: DataFrame, text_col: str = "text", k: int = 8,
                      business: Sequence[str] = W.BUSINESS_TERMS,
                      stopwords: Sequence[str] = W.THEME_STOPWORDS,
                      defaults: Sequence[str] = W.DEFAULT_KEYWORDS) -> DataFrame:
    """Business terms weigh 2, other tokens 1 (stoplist applied first);
    from the top 3k keep business terms or alphabetic words longer than 4 that
    are not noise, up to k; back-fill with business terms of the top 5k;
    the default list when nothing survives.  → ``(rank, keyword)``."""
    tok = F.col("token")
    toks = explode_tokens(df, text_col).where(
        (F.length(tok) >= 3) & ~tok.isin(*stopwords) & ~_all_digits(tok))
    weighted = toks.groupBy("token").agg(
        F.sum(F.when(tok.isin(*business), F.lit(2)).otherwise(F.lit(1))).alias("weight"))
    # at most 5k candidates leave the aggregate (per-partition top-k + merge);
    # everything below runs on those ≤ 5k rows
    cand = weighted.orderBy(F.col("weight").desc(), "token").limit(5 * k)
    by_pos = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    is_bus = tok.isin(*business)
    cand = cand.withColumn("pos", F.row_number().over(Window.orderBy(F.col("weight").desc(), "token")))
    cand = cand.withColumn("keep", (F.col("pos") <= 3 * k) & ~is_noise(tok) & (
        is_bus | ((F.length(tok) > 4) & tok.rlike(r"^\p{L}+$") & (tok != F.upper(tok)))))
    cand = cand.withColumn("bus", is_bus & ~is_noise(tok))
    cand = cand.withColumn("keep_rank", F.sum(F.col("keep").cast("int")).over(by_pos))
    cand = cand.withColumn("bus_rank", F.sum(F.col("bus").cast("int")).over(by_pos))
    cand = cand.withColumn("n_keep", F.least(F.lit(k), F.sum(F.col("keep").cast("int")).over(whole)))
    kept = cand.where(F.col("keep") & (F.col("keep_rank") <= k)).select("token", F.col("keep_rank").alias("r"))
    back = cand.where(F.col("bus") & (F.col("bus_rank") <= F.lit(k) - F.col("n_keep"))) \
        .select("token", (F.lit(k) + F.col("bus_rank")).alias("r"))
    spark = df.sparkSession
    dflt = spark.range(1).select(F.posexplode(F.array(*[F.lit(w) for w in defaults])).alias("r", "token")) \
        .select("token", (F.col("r") + 10 * k + 1).alias("r"))
    allrows = kept.withColumn("real", F.lit(1)).unionByName(back.withColumn("real", F.lit(1))) \
        .unionByName(dflt.withColumn("real", F.lit(0)))
    allrows = allrows.withColumn("n_real", F.sum("real").over(whole))
    out = allrows.where((F.col("real") == 1) | (F.col("n_real") == 0))
    return out.select(F.row_number().over(Window.orderBy("r")).alias("rank"), F.col("token").alias("keyword"))


def weighted_keywords_per_group(df: DataFrame, group_col: str = "theme", text_col: str = "text", k: int = 8,
                                business: Sequence[str] = W.BUSINESS_TERMS, stopwords: Sequence[str] = W.THEME_STOPWORDS,
                                defaults: Sequence[str] = W.DEFAULT_KEYWORDS) -> DataFrame:
    """C6 for each group at once → ``(group, rank, keyword)``.  Weights are
    added up by (group, token), partly before the shuffle; a group's best 5k are
    cut by a ranking that Spark limits within map tasks too, and stand in one
    array of at most 5k, on which the rules of C6 work.  A group none of whose
    words survive gets the defaults, a null group is one of its own."""
    tok = F.col("token")
    toks = explode_tokens(df, text_col, keep=[group_col]).where((F.length(tok) >= 3) & ~tok.isin(*stopwords) & ~_all_digits(tok))
    weighted = toks.groupBy(group_col, "token").agg(F.sum(F.when(tok.isin(*business), F.lit(2)).otherwise(F.lit(1))).alias("weight"))
    best = F.row_number().over(Window.partitionBy(group_col).orderBy(F.col("weight").desc(), "token"))
    cand = weighted.withColumn("pos", best).where(F.col("pos") <= 5 * k)
    # groups without a token have an empty array
    groups = df.select(group_col).distinct()
    found = cand.groupBy(F.col(group_col).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("cand"))
    rows = groups.join(found, F.col(group_col).eqNullSafe(F.col("_group")), "left").drop("_group")
    rows = rows.withColumn("cand", F.coalesce("cand", F.array().cast("array<struct<pos:int,token:string>>")))

    def wanted(t: Column) -> Column:
        return t.isin(*business) | ((F.length(t) > 4) & t.rlike(r"^\p{L}+$") & (t != F.upper(t)))

    words = lambda c: F.transform(c, lambda x: x["token"])
    kept = F.slice(words(F.filter("cand", lambda x: (x["pos"] <= 3 * k) & ~is_noise(x["token"]) & wanted(x["token"]))), 1, k)
    back = words(F.filter("cand", lambda x: x["token"].isin(*business) & ~is_noise(x["token"])))
    rows = rows.withColumn("kept", kept).withColumn("back", back)
    all_ = F.concat("kept", F.when(F.size("kept") < k, F.slice("back", F.lit(1), F.lit(k) - F.size("kept"))).otherwise(F.array().cast("array<string>")))
    all_ = F.when(F.size(all_) > 0, all_).otherwise(F.array(*[F.lit(w) for w in defaults]))
    return rows.select(group_col, F.posexplode(all_).alias("rank", "keyword")).select(group_col, (F.col("rank") + 1).alias("rank"), "keyword")


# ---------------------------------------------------------------------------
# C7 / C8 TF-IDF
# ---------------------------------------------------------------------------
def split_words(text: Column) -> Column:
    """Lower-cased text cut at runs of other than word characters; words of one
    character, and an empty one at an end, are still among them."""
    # splitting on non-word runs is cheaper than extracting matches (same tokens as WORD_PATTERN)
    return F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD_PATTERN)


def words_cutter(df: DataFrame) -> Cutter:
    """What cuts texts as :func:`split_words` does, without its empty words."""
    return Cutter.of(df.sparkSession, NON_WORD_PATTERN)


def with_bigrams(words: Column) -> Column:
    """An array of words, then its 2-grams; null where a word is null."""
    return F.concat(words, F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))


def ngram_terms(text: Column, stopwords: Sequence[str], ngram_max: int = 2) -> Column:
    """Word 1..n-grams of lower-cased text after stop-word removal."""
    words = F.filter(split_words(text), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))
    return F.filter(with_bigrams(words), lambda g: g.isNotNull()) if ngram_max >= 2 else words


#: Terms of all groups that the driver holds, and words that an expression holds, at most; beyond that, terms are joined.
VOCABULARY, LITERALS = 1 << 18, 20_000


def _one_of(words: Sequence[str]) -> str:
    """SQL: whether ``w`` is one of these words."""
    return "w in (" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in words) + ")" if words else "false"


def marked_words(df: DataFrame, text_col: str, words: Sequence[str], stopwords: Sequence[str], out_col: str = "__words") -> DataFrame:
    """Add the array of a text's words after stop-word removal, null in place of those that are not among ``words``."""
    df = df.withColumn(out_col, split_words(F.col(text_col)))
    return df.withColumn(out_col, F.expr(f"array_remove(transform({out_col}, w -> case when {_one_of(words)} then w "
                                         f"when length(w) < 2 or {_one_of(stopwords)} then '' end), '')"))


def word_counts(df: DataFrame, key: str, text_col: str, stopwords: Sequence[str]) -> DataFrame:
    """``key``, ``term``, ``tf``: the words of all texts after stop-word removal, counted, in a table in the shared folder."""
    parts = C.counted_words(df, key, text_col, words_cutter(df), C.other_than(stopwords))
    return stored(parts.groupBy(key, "term").agg(F.sum("tf").alias("tf")), "word-counts")


def _commonest(counts: DataFrame, n: int, grouped: bool) -> DataFrame:
    """The ``n`` rows with the highest ``total`` (of each ``g``), ties by term."""
    if not grouped:
        return counts.orderBy(F.col("total").desc(), "term").limit(n)
    rk = F.row_number().over(Window.partitionBy("g").orderBy(F.col("total").desc(), "term"))
    return counts.withColumn("_rk", rk).where(F.col("_rk") <= n).drop("_rk")


def common_words(counts: DataFrame, max_features: int, grouped: bool = False) -> list | None:
    """Of counts ``g, term, total`` of words the rows ``(g, term, total)`` that
    can matter to a vocabulary of the ``max_features`` commonest 1- and 2-grams:
    words as common as the word of that rank.  No 2-gram is commoner than its
    words, so a 2-gram of a rarer word is not in the vocabulary.  None if there
    are too many for an expression (long ties)."""
    least = _commonest(counts, max_features, grouped).groupBy("g").agg(
        F.when(F.count("*") < max_features, F.lit(0)).otherwise(F.min("total")).alias("_least"))
    rows = counts.join(F.broadcast(least), "g").where(F.col("total") >= F.col("_least")).select("g", "term", "total")
    rows = [tuple(r) for r in rows.limit(VOCABULARY + 1).collect()]
    return None if len(rows) > VOCABULARY or len({w for _, w, _ in rows}) > LITERALS else rows


class Vocabulary:
    """The ``max_features`` commonest 1- and 2-grams of texts (of each group),
    ties by term, with what TF-IDF needs of them.

    Words are counted first.  Texts are then rows of codes of the common
    words alone (``rows``, by the order of their ``words``), on which 2-grams and documents are counted; neither all
    2-grams nor the texts are shuffled or kept.  Groups without a value have no terms."""

    def __init__(self, rows: DataFrame, keep: Sequence[str], words: Sequence[str], common: list, max_features: int,
                 stopwords: Sequence[str], n_docs: dict, grouped: bool = False, ngram_max: int = 2):
        self.words, self.stopwords = list(words), list(stopwords)
        found: dict = {}
        for key, term, total in common:
            found.setdefault(key, []).append((-total, term))
        if ngram_max >= 2:
            grams = C.bigram_counts(rows.where(F.col("g").isNotNull()), "g", len(self.words))
            grams = grams.select("g", C.pair_term(self.words).alias("term"), "total")
            for r in _commonest(grams, max_features, grouped).collect():
                found.setdefault(r["g"], []).append((-r["total"], r["term"]))
        #: terms by falling count, by group
        self.by_group = {key: [t for _, t in sorted(terms)[:max_features]] for key, terms in found.items()}
        self.terms = sorted({t for terms in self.by_group.values() for t in terms})
        self._terms = C.Terms(self.words, self.terms)
        #: ``keep``, ``g`` and ``__tf``, the vector of the counts of ``terms``
        self.table = C.with_counts(rows, [*keep, "g"], self._terms)
        self.df = {(r["g"], r["i"]): r["n"] for r in C.document_counts(rows, "g", self._terms).collect()}
        self.n_docs = n_docs

    def counted(self, df: DataFrame, text_col: str) -> DataFrame:
        """Add ``__tf`` to a table with texts."""
        return C.text_counts(df, text_col, words_cutter(df), self.words, self.stopwords, self._terms)

    def counted_codes(self, table: DataFrame, words: Sequence[str]) -> DataFrame:
        """Add ``__tf`` to a table of coded texts (:class:`CodedTexts`)."""
        return C.recoded_counts(table, words, self.words, self._terms)

    def idf(self, key) -> list[float]:
        """ln((1+N)/(1+df)) + 1 of a group's terms in the order of ``terms``, 0 for those it lacks."""
        own = set(self.by_group.get(key, ()))
        return [math.log((1.0 + self.n_docs[key]) / (1.0 + self.df.get((key, i), 0))) + 1.0 if t in own else 0.0
                for i, t in enumerate(self.terms)]


def vocabulary(df: DataFrame, keep: Sequence[str], text_col: str, max_features: int, stopwords: Sequence[str],
               group_col: str | None = None, ngram_max: int = 2) -> Vocabulary | None:
    """The vocabulary of texts, whose table has the columns ``keep``; None if it is too much for the driver."""
    if ngram_max > 2:
        return None
    n_groups = df.select(group_col).distinct().count() if group_col else 1
    if n_groups * max_features > VOCABULARY:
        return None
    g = F.col(group_col) if group_col else F.lit(0)
    counts = word_counts(df.select(g.alias("g"), text_col).where(F.col("g").isNotNull()), "g", text_col, stopwords)
    common = common_words(counts.withColumnRenamed("tf", "total"), max_features, group_col is not None)
    if common is None or n_groups * len(common) > VOCABULARY * 16:
        return None
    words = sorted({w for _, w, _ in common})
    rows = C.coded(df.select(*keep, text_col, g.alias("g")), [*keep, "g"], text_col, words_cutter(df), words, stopwords)
    rows = stored(rows, "words")
    n_docs = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    return Vocabulary(rows, keep, words, common, max_features, stopwords, n_docs, group_col is not None, ngram_max)


#: Words with a code of their own in :class:`CodedTexts`.
CODED_WORDS = 50_000


class CodedTexts:
    """Texts as codes of the ``CODED_WORDS`` commonest words, and their other words as they are, in a table in the shared
    folder with the columns ``keep``: whatever is counted by words or 2-grams, of all texts or of groups that are found
    later, comes from it, and texts are read twice in all."""

    def __init__(self, df: DataFrame, keep: Sequence[str], text_col: str, stopwords: Sequence[str]):
        self.stopwords = list(stopwords)
        self.counts = word_counts(df.select(F.lit(0).alias("g"), text_col), "g", text_col, stopwords).withColumnRenamed("tf", "total")
        self.words = [r["term"] for r in _commonest(self.counts, CODED_WORDS, False).collect()]
        self.table = stored(C.coded(df, keep, text_col, words_cutter(df), self.words, stopwords, rare=True), "coded-texts")

    def vocabulary(self, keep: Sequence[str], max_features: int) -> Vocabulary | None:
        """As :func:`vocabulary`, of all texts."""
        return self._vocabulary(self.table.withColumn("g", F.lit(0)), keep, self.counts, max_features, {0: self.table.count()}, False)

    def vocabulary_by(self, table: DataFrame, keep: Sequence[str], group_col: str, n_docs: dict, max_features: int) -> Vocabulary | None:
        """As :func:`vocabulary`, of each group; ``table`` is this one's with a column of groups, ``n_docs`` their rows."""
        table = table.withColumnRenamed(group_col, "g")
        counts = C.coded_word_counts(table.where(F.col("g").isNotNull()), "g", self.words)
        return self._vocabulary(table, keep, stored(counts.groupBy("g", "term").agg(F.sum("tf").alias("total")), "word-counts"), max_features, n_docs, True)

    def _vocabulary(self, table: DataFrame, keep: Sequence[str], counts: DataFrame, max_features: int, n_docs: dict, grouped: bool) -> Vocabulary | None:
        common = common_words(counts, max_features, grouped) if len(n_docs) * max_features <= VOCABULARY else None
        if common is None or len(n_docs) * len(common) > VOCABULARY * 16:
            return None
        words = sorted({w for _, w, _ in common})
        rows = C.recoded(table, [*keep, "g"], self.words, words)
        # groups come from a model: it runs once for the passes that follow
        return Vocabulary(stored(rows, "words") if grouped else rows, keep, words, common, max_features, self.stopwords, n_docs, grouped)


def _common_tf(df: DataFrame, doc_col: str, text_col: str, max_features: int, stopwords: Sequence[str]) -> DataFrame | None:
    """``doc, term, tf`` of documents of several rows, for all terms that can be
    among the ``max_features`` commonest; None if there are too many of them."""
    counts = word_counts(df.select(F.lit(0).alias("g"), text_col), "g", text_col, stopwords)
    common = common_words(counts.withColumnRenamed("tf", "total"), max_features)
    if common is None:
        return None
    words = sorted(w for _, w, _ in common)
    if not words:
        return counts.select(F.lit(None).cast(df.schema[doc_col].dataType).alias(doc_col), "term", "tf")
    rows = stored(C.text_term_counts(df, doc_col, text_col, words_cutter(df), words, stopwords), "pair-counts")
    totals = rows.groupBy("pair").agg(F.sum("total").alias("total")).withColumn("term", C.pair_term(words)).withColumn("g", F.lit(0))
    single = F.col("pair") % (len(words) + 1) == 0
    best = _commonest(totals.where(~single), max_features, False).unionByName(totals.where(single))  # no other 2-gram is in the vocabulary
    return stored(rows.withColumnRenamed("total", "tf").join(F.broadcast(best.select("pair", "term")), "pair").select(doc_col, "term", "tf"), "term-counts")


def _repeated(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()


def tfidf(df: DataFrame, doc_col: str, text_col: str, group_col: str | None = None,
          max_features: int = 3000, stopwords: Sequence[str] | None = None, ngram_max: int = 2,
          docs_are_groups: bool = False, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """C7 (SQL form) / C8 building block: L2-normalised TF-IDF rows
    ``(group?, doc, term, weight, n_docs)`` with tf = raw count and
    idf = ln((1+N)/(1+df)) + 1, vocabulary = the ``max_features`` terms with
    the highest total count (per group when ``group_col`` is given; ties by
    term).  N counts every document, including ones without a term.  With
    ``docs_are_groups`` several rows form one document (their counts add up)."""
    stop = list(W.ENGLISH_STOPWORDS if stopwords is None else stopwords)
    keys = ([group_col] if group_col else []) + [doc_col]
    if not docs_are_groups and not _repeated(df, keys):
        voc = vocabulary(df, [doc_col], text_col, max_features, stop, group_col, ngram_max)
        if voc is not None:
            return _weights(voc, doc_col, group_col, df.schema[group_col].dataType if group_col else None)
    tf = _common_tf(df, doc_col, text_col, max_features, stop) if docs_are_groups and not group_col and ngram_max == 2 else None
    return _joined_tfidf(df, doc_col, text_col, group_col, max_features, stop, ngram_max, docs_are_groups, max_broadcast_rows, tf)


def _weights(voc: Vocabulary, doc_col: str, group_col: str | None, group_type) -> DataFrame:
    """TF-IDF rows: a document's weights come from its vector of counts alone."""
    rows = voc.table.select(doc_col, "g", F.unwrap_udt("__tf").alias("tf"))
    if group_col:
        schema = T.StructType([T.StructField("g", group_type), T.StructField("idf", T.ArrayType(T.DoubleType())), T.StructField("n_docs", T.LongType())])
        groups = [(key, voc.idf(key), voc.n_docs[key]) for key in voc.by_group]
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(groups, schema)), "g")
    else:
        idf = F.split(F.lit(",".join(map(repr, voc.idf(0) if voc.terms else [0.0]))), ",").cast("array<double>")
        rows = rows.withColumn("idf", idf).withColumn("n_docs", F.lit(voc.n_docs.get(0, 0)).cast("long"))
    rows = rows.withColumn("raw", F.expr("zip_with(tf.indices, tf.values, (i, n) -> n * get(idf, i))"))
    rows = rows.withColumn("norm", F.sqrt(F.expr("aggregate(raw, 0D, (s, x) -> s + x * x)")))
    rows = rows.select("g", doc_col, "norm", "n_docs", F.expr("inline(arrays_zip(tf.indices, raw))").alias("i", "raw")).where(F.col("raw") > 0)
    term = F.get(F.split(F.lit("\n".join(voc.terms)), "\n"), F.col("i"))
    return rows.select(*([F.col("g").alias(group_col)] if group_col else []), doc_col, term.alias("term"), (F.col("raw") / F.col("norm")).alias("weight"), "n_docs")


def _joined_tfidf(df: DataFrame, doc_col: str, text_col: str, group_col: str | None, max_features: int, stop: Sequence[str],
                  ngram_max: int, docs_are_groups: bool, max_broadcast_rows: int, tf: DataFrame | None) -> DataFrame:
    """The rows of :func:`tfidf` for any vocabulary and documents of several rows, by joins; ``tf`` has the counts
    of terms by document if they are there."""
    keys = ([group_col] if group_col else []) + [doc_col]
    gkey = [group_col] if group_col else []
    docs = df.select(*keys, text_col)
    if not docs_are_groups:
        # partitioned by document before the text is exploded: counts and norms need no further exchange; an explicit
        # partition count keeps AQE from coalescing this (small in bytes, heavy in CPU) shuffle into a few tasks
        docs = docs.repartition(text_partitions(docs, text_col), doc_col)
    n_expr = F.countDistinct(doc_col) if docs_are_groups else F.count("*")
    n_docs = docs.groupBy(*gkey).agg(n_expr.alias("n_docs")) if gkey else docs.agg(n_expr.alias("n_docs"))
    if tf is None:
        tf = (docs.select(*keys, F.explode(ngram_terms(F.col(text_col), stop, ngram_max)).alias("term"))
              .groupBy(*keys, "term").agg(F.count("*").alias("tf")))
    stats = tf.groupBy(*gkey, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if gkey:
        rk = F.row_number().over(Window.partitionBy(*gkey).orderBy(F.col("total").desc(), "term"))
        vocab = stats.withColumn("rk", rk).where(F.col("rk") <= max_features)
        vocab = vocab.join(n_docs, gkey)
        # the vocabulary has at most max_features rows per group: broadcast it
        # (keeping tf partitioned by document) when that bound is small enough
        n_groups = n_docs.count()
        if n_groups * max_features <= max_broadcast_rows:
            vocab = F.broadcast(vocab)
    else:
        # per-partition top-k + merge; the result is bounded by max_features
        vocab = stats.orderBy(F.col("total").desc(), "term").limit(max_features).withColumn("_g", F.lit(0))
        vocab = F.broadcast(vocab.join(n_docs.withColumn("_g", F.lit(0)), "_g").drop("_g"))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    w = tf.join(vocab.select(*gkey, "term", idf.alias("idf"), "n_docs"), gkey + ["term"]) \
        .withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", (F.col("raw") / norm).alias("weight"), "n_docs")


def theme_keywords(df: DataFrame, theme_col: str = "theme", doc_col: str = "id", text_col: str = "text",
                   max_features: int = 500, top: int = 10, keep: int = 6,
                   max_docs_per_theme: int | None = None, order_col: str | None = None,
                   drop_first_words: Sequence[str] = tuple(W.THEME_STOPWORDS) + tuple(W.KEYWORD_EXTRA_DROP),
                   stopwords: Sequence[str] | None = None, eager: bool = True) -> DataFrame:
    """TF-IDF fitted inside each theme; mean weight over the theme's
    documents; top ``top`` terms, drop those whose first word is a stop or
    extra-drop word, keep ``keep`` → ``(theme, rank, keyword, score)``.
    ``max_docs_per_theme`` (off by default) keeps the first documents by
    ``order_col``.  ``eager`` (default) runs the job now and returns the small
    checkpointed result."""
    src = df.select(F.col(theme_col).alias("theme"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text"),
                    *([F.col(order_col).alias("_o")] if order_col else []))
    if max_docs_per_theme:
        o = F.col("_o") if order_col else F.col("doc")
        src = src.withColumn("_r", F.row_number().over(Window.partitionBy("theme").orderBy(o, "doc"))) \
            .where(F.col("_r") <= max_docs_per_theme)
    rows = tfidf(src, "doc", "text", group_col="theme", max_features=max_features, stopwords=stopwords)
    out = _top_terms(rows, top, keep, drop_first_words)
    # a few rows per theme, in the shared checkpoint folder (lineage cut, survives executor loss)
    return cut_lineage(out) if eager else out


def coded_theme_keywords(texts: CodedTexts, table: DataFrame, n_docs: dict, theme_col: str = "theme", doc_col: str = "id", max_features: int = 500,
                         top: int = 10, keep: int = 6,
                         drop_first_words: Sequence[str] = tuple(W.THEME_STOPWORDS) + tuple(W.KEYWORD_EXTRA_DROP)) -> DataFrame | None:
    """C8 on coded texts with a column of themes of so many documents; None if the vocabulary is too much for the driver."""
    voc = texts.vocabulary_by(table, [doc_col], theme_col, n_docs, max_features)
    if voc is None:
        return None
    rows = _weights(voc, doc_col, theme_col, table.schema[theme_col].dataType).withColumnRenamed(theme_col, "theme")
    return cut_lineage(_top_terms(rows, top, keep, drop_first_words))


def _top_terms(rows: DataFrame, top: int, keep: int, drop_first_words: Sequence[str]) -> DataFrame:
    """The keywords of C8 from TF-IDF rows."""
    # rounded before ranking so equal scores tie exactly in any summation order
    mean = rows.groupBy("theme", "term").agg(F.round(F.sum("weight") / F.first("n_docs"), 9).alias("score"))
    rk = Window.partitionBy("theme").orderBy(F.col("score").desc(), F.col("term"))
    top_t = mean.withColumn("rk", F.row_number().over(rk)).where(F.col("rk") <= top)
    first = F.split(F.col("term"), " ").getItem(0)
    kept = top_t.where(~F.lower(first).isin(*drop_first_words))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("theme").orderBy("rk"))) \
        .where(F.col("rank") <= keep)
    return kept.select("theme", "rank", F.col("term").alias("keyword"), F.round("score", 6).alias("score"))


def keywords_per_group(kw: DataFrame, group_col: str = "theme") -> DataFrame:
    """Keyword rows → one ordered ``array<string>`` per group."""
    return kw.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"])
        .alias("keywords"))

