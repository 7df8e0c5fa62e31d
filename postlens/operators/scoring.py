"""Scoring as Spark jobs.

Three kinds of backends share one output shape:

* lexicon scorers — pure Column expressions (JVM, codegen), reproducible;
* ``pyspark.ml`` models (logistic regression on labelled rows, KMeans in
  ``themes``) — distributed fit and transform;
* a user callable — loaded once per Python worker and fed Arrow batches of
  ``batch_size`` texts through an iterator ``pandas_udf``; a missing backend
  raises instead of silently falling back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import wordlists as W
from postlens.functions.columns import dominant_aspect
from postlens.functions.text import tokens
from postlens.operators import keywords as K
from postlens.operators.coded import CODES
from postlens.operators.cutting import found_tokens
from postlens.session import stored

# FIXED VALUES — class index → label of the three-class sentiment models
SENTIMENT_ID2LABEL = {0: "negative", 1: "neutral", 2: "positive"}

#: FIXED VALUE — tokens that the sentiment and aspect models read of a text
MAX_LENGTH = 256
#: Sparse vectors in a partition of a fit.
VECTORS = 8192
SCORE_SCHEMA = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


# ---------------------------------------------------------------------------
# D2 label mapping
# ---------------------------------------------------------------------------
def map_model_label(c: Column | str, id2label: Mapping[int, str] = SENTIMENT_ID2LABEL) -> Column:
    """``LABEL_i`` → ``id2label[i]``; anything else unchanged; lower-cased."""
    c = F.col(c) if isinstance(c, str) else c
    idx = F.regexp_extract(c, r"_(\d+)$", 1)
    m = F.create_map(*[x for k, v in id2label.items() for x in (F.lit(str(k)), F.lit(v))])
    return F.lower(F.coalesce(F.when(idx != "", F.try_element_at(m, idx)), c))


# ---------------------------------------------------------------------------
# D1 sentiment
# ---------------------------------------------------------------------------
def lexicon_sentiment(text: Column | str, positive: Sequence[str], negative: Sequence[str], toks: Column | None = None) -> Column:
    """D1 (lexicon backend): p positive and n negative token hits →
    label by the sign of p−n (neutral on a tie); score = 0.5 + |p−n|/(2(p+n+1))
    for a polar label and 1/(p+n+1) for neutral.  Returns struct<label, score>.
    ``toks`` is a column of the tokens, or of those that the lexicons hold, if
    there is one."""
    toks = tokens(text) if toks is None else toks
    p = F.size(F.filter(toks, lambda t: t.isin(*positive))).cast("double")
    n = F.size(F.filter(toks, lambda t: t.isin(*negative))).cast("double")
    total = p + n + F.lit(1.0)
    label = F.when(p > n, F.lit("positive")).when(n > p, F.lit("negative")).otherwise(F.lit("neutral"))
    score = F.when(p == n, F.lit(1.0) / total).otherwise(F.lit(0.5) + F.abs(p - n) / (F.lit(2.0) * total))
    return F.struct(label.alias("label"), score.alias("score"))


def lexicon_tokens(df: DataFrame, text_col: str, *lexicons: Sequence[str]) -> Column:
    """The array of a text's tokens (C2) that any of the word lists holds, cut once for all of them on whole Arrow batches."""
    return found_tokens(df.sparkSession, [w for words in lexicons for w in words])(F.col(text_col).cast("string"))


def run_sentiment(df: DataFrame, text_col: str = "clean_tweet", scorer: Column | Callable | None = None,
                  batch_size: int = 16, max_length: int | None = MAX_LENGTH, toks: Column | None = None, **lexicon) -> DataFrame:
    """Add ``sentiment_label`` and ``sentiment_score``.

    ``scorer`` is a Column (e.g. :func:`lexicon_sentiment`), or a factory
    ``() -> predict(list[str]) -> list[(label, score)]`` run per worker, or
    None with ``positive``/``negative`` word lists for the lexicon backend, which
    takes ``toks`` (:func:`lexicon_tokens`) if they are cut already."""
    if scorer is None:
        if not lexicon:
            raise ValueError("no sentiment backend: pass scorer= or positive=/negative= word lists")
        # a projection of its own: the text is cut once for all that counts its words
        df = df.withColumn("__toks", toks if toks is not None else F.filter(tokens(text_col), lambda t: t.isin(*lexicon["positive"], *lexicon["negative"])))
        s = lexicon_sentiment(F.col(text_col), lexicon["positive"], lexicon["negative"], F.col("__toks"))
    elif isinstance(scorer, Column):
        s = scorer
    else:
        s = callable_scorer(scorer, batch_size, max_length=max_length)(F.col(text_col))
    out = df.withColumn("__s", s)
    return out.withColumn("sentiment_label", map_model_label(F.col("__s.label"))) \
        .withColumn("sentiment_score", F.col("__s.score")).drop("__s", "__toks")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first_words(text: str, limit: int) -> str:
    """The beginning of a text up to its ``limit``-th word."""
    end = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i == limit:
            return text[:end]
        end = m.end()
    return text


def n_words(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass").split())  # bytes are split at the blanks that no word has


def length_batches(lengths: Sequence[int], batch_size: int, waste: float = 2.0, room: int = 8) -> list[list[int]]:
    """The places of texts in batches for a model that pads a batch to its longest text: longest texts first, none more
    than ``batch_size`` together, and no text padded to more than ``waste`` times its length and ``room``."""
    out: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if out and len(out[-1]) < batch_size and longest <= waste * lengths[i] + room:
            out[-1].append(i)
        else:
            out.append([i])
            longest = lengths[i]
    return out


def predict_all(predict: Callable[[list[str]], list], texts: list[str], batch_size: int, max_length: int | None = MAX_LENGTH,
                clip: Callable[[str, int], str] = first_words, length: Callable[[str], int] = n_words) -> list:
    """``predict`` on batches of texts of like length, none beyond ``max_length``; results in the order of the texts."""
    if max_length is not None:
        texts = [clip(t, max_length) for t in texts]
    out: list = [None] * len(texts)
    for batch in length_batches([length(t) for t in texts], batch_size):
        for i, result in zip(batch, predict([texts[i] for i in batch]), strict=True):
            out[i] = result
    return out


def callable_scorer(factory: Callable[[], Callable[[list[str]], list]], batch_size: int = 16,
                    schema: T.StructType = SCORE_SCHEMA, max_length: int | None = MAX_LENGTH,
                    clip: Callable[[str, int], str] = first_words, length: Callable[[str], int] = n_words):
    """Wrap a per-worker model factory as an iterator ``pandas_udf``: the model
    is built once per task and called on batches of up to ``batch_size`` texts
    of like length.  It reads ``max_length`` tokens of a text; ``clip`` and
    ``length`` are by words unless the model's tokeniser is given."""

    @F.pandas_udf(schema)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for s in batches:
            texts = s.fillna("").astype(str).tolist()
            rows = predict_all(predict, texts, batch_size, max_length, clip, length)
            yield pd.DataFrame(list(rows), columns=[f.name for f in schema.fields])

    return _score


def callable_aspects(factory: Callable[[], Callable[[list[str]], list]], aspects: Sequence[str] = W.ASPECT_KEYS, batch_size: int = 8,
                     max_length: int | None = MAX_LENGTH, **tokens) -> Callable[[Column | str], dict[str, Column]]:
    """D3 (user backend): ``factory() -> predict(list[str]) -> list of one score for each aspect``, run as in
    :func:`callable_scorer`; returns a function from a text column to the scores that :func:`run_aspects` takes."""
    schema = T.StructType([T.StructField(a, T.DoubleType()) for a in aspects])
    score = callable_scorer(factory, batch_size, schema, max_length, **tokens)

    def scores(text: Column | str) -> dict[str, Column]:
        all_ = score(F.col(text) if isinstance(text, str) else text)
        return {a: all_[a] for a in aspects}

    return scores


def train_logistic_sentiment(labelled: DataFrame, text_col: str, label_col: str, num_features: int = 1 << 18,
                             max_iter: int = 50, seed: int = 42):
    """D1 (ML backend): HashingTF → IDF → multinomial logistic regression,
    fitted distributed on labelled rows.  Returns the fitted PipelineModel.

    Labelled texts are read once; their counts are a table in the shared folder.
    Each round of the fit sends one gradient a partition (classes times features
    values), so there are as many partitions as cores, however many rows there are."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol="__feat")
    lr = LogisticRegression(featuresCol="__feat", labelCol=label_col, maxIter=max_iter, family="multinomial")
    counts = tf.transform(tok.transform(labelled.withColumn(label_col, F.col(label_col).cast("double")))).select(label_col, "__tf")
    counts = stored(counts, "labelled-counts").coalesce(labelled.sparkSession.sparkContext.defaultParallelism)
    weights = idf.fit(counts)
    return PipelineModel(stages=[tok, tf, weights, lr.fit(weights.transform(counts))])


def apply_logistic_sentiment(model, df: DataFrame, id2label: Mapping[int, str]) -> DataFrame:
    """D1 (ML backend, transform): best class → label, its probability → score."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    probs = vector_to_array(F.col("probability"))
    best = F.array_max(probs)
    idx = F.array_position(probs, best) - 1
    m = F.create_map(*[x for k, v in id2label.items() for x in (F.lit(k), F.lit(v))])
    keep = [c for c in df.columns]
    return out.select(*keep, F.try_element_at(m, idx.cast("int")).alias("sentiment_label"),
                      best.alias("sentiment_score"))


# ---------------------------------------------------------------------------
# D3-D5 aspects
# ---------------------------------------------------------------------------
def lexicon_aspect_scores(text: Column | str, lexicons: Mapping[str, Sequence[str]], toks: Column | None = None) -> dict[str, Column]:
    """D3 (lexicon backend): per aspect, the share of its lexicon words that
    occur in the text (0.0-1.0).  ``toks`` is a column of the tokens, or of
    those that the lexicons hold, if there is one."""
    toks = F.array_distinct(tokens(text)) if toks is None else toks
    return {a: (F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words))))
            for a, words in lexicons.items()}


def run_aspects(df: DataFrame, text_col: str = "clean_tweet", lexicons: Mapping[str, Sequence[str]] | None = None,
                scores: Mapping[str, Column] | None = None, threshold: float = W.ASPECT_THRESHOLD,
                fallback: str = W.ASPECT_FALLBACK, fast_preview: bool = False,
                aspects: Sequence[str] = W.ASPECT_KEYS, toks: Column | None = None) -> DataFrame:
    """D3 + D4 (+ D5 with ``fast_preview``): ``aspect_<key>`` score columns
    (missing → 0.0) and ``aspect_dominant``; ``toks`` as in :func:`run_sentiment`."""
    if fast_preview:
        out = df
        for a in aspects:
            out = out.withColumn(f"aspect_{a}", F.lit(0.0))
        return out.withColumn("aspect_dominant", F.lit(fallback))
    if scores is None:
        if lexicons is None:
            raise ValueError("no aspect backend: pass lexicons= or scores=")
        words = [w for own in lexicons.values() for w in own]
        df = df.withColumn("__toks", F.array_distinct(toks if toks is not None else F.filter(tokens(text_col), lambda t: t.isin(*words))))
        scores = lexicon_aspect_scores(F.col(text_col), lexicons, F.col("__toks"))
    out = df
    for a in aspects:
        out = out.withColumn(f"aspect_{a}", F.coalesce(scores.get(a, F.lit(0.0)), F.lit(0.0)).cast("double"))
    return out.withColumn("aspect_dominant",
                          dominant_aspect({a: f"aspect_{a}" for a in aspects}, threshold, fallback)).drop("__toks")


def prototype_vectors(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per label → ``(label, dim, value)`` (small: labels × dims)."""
    ex = vectors.select(label_col, F.posexplode(vec_col).alias("dim", "v"))
    return ex.groupBy(label_col, "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


def prototype_cosines(vec: Column, prototypes: DataFrame, label_col: str = "label", max_rows: int = 2_000_000) -> Column:
    """An array of (cosine, label) of a vector column and each
    prototype, labels in order.  Prototypes are a model of labels × dims
    values, checked against ``max_rows``; they become literals, so scoring is
    one projection without a join or an explode."""
    rows = prototypes.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} prototype values")
    by_label: dict = {}
    for r in rows:
        by_label.setdefault(r[label_col], {})[r["dim"]] = float(r["value"])
    kind = prototypes.schema[label_col].dataType
    values = F.transform(vec, lambda x: x.cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(values, values))
    out = []
    for label in sorted(by_label):
        own = [by_label[label].get(i, 0.0) for i in range(max(by_label[label]) + 1)]
        length = sum(x * x for x in own) ** 0.5
        cosine = F.try_divide(dot(values, F.array(*[F.lit(x) for x in own])), norm * F.lit(length))
        out.append(F.struct(cosine.alias("cosine"), F.lit(label).cast(kind).alias("label")))
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("label", kind)])))
    return F.array(*out) if out else empty


def cosine_scores(vectors: DataFrame, prototypes: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """D3 (embedding backend): ``(id, label, cosine)`` rows of :func:`prototype_cosines`."""
    scores = prototype_cosines(F.col(vec_col), prototypes, label_col)
    return vectors.select(id_col, F.inline(scores).alias("cosine", label_col)).select(id_col, label_col, "cosine")


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                      label_col: str = "label") -> DataFrame:
    """D8 (assignment given centroids): the prototype with the highest cosine
    (ties → first label) for each row, ``(id, assigned, cosine)``."""
    scores = prototype_cosines(F.col(vec_col), prototypes, label_col)
    best = F.reduce(scores, F.struct(F.lit(None).cast("double").alias("cosine"), F.element_at(scores, 1)["label"].alias("label")),
                    lambda a, b: F.when(a["cosine"].isNull() | (b["cosine"] > a["cosine"]), b).otherwise(a))
    return vectors.select(id_col, best.alias("b")).select(id_col, F.col("b.label").alias("assigned"), F.col("b.cosine").alias("cosine"))


# ---------------------------------------------------------------------------
# D6 embeddings
# ---------------------------------------------------------------------------
def callable_embedder(factory: Callable[[], Callable[[list[str]], list]], batch_size: int = 32, max_length: int | None = None,
                      clip: Callable[[str, int], str] = first_words, length: Callable[[str], int] = n_words):
    """D6 (user backend): ``factory() -> encode(list[str]) -> list[list[float]]``,
    loaded once per worker and called on batches of texts of like length, whole
    unless ``max_length`` is given; vectors are L2-normalised."""
    import numpy as np

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            texts = s.fillna("").astype(str).tolist()
            vecs = []
            for v in predict_all(encode, texts, batch_size, max_length, clip, length):
                a = np.asarray(v, dtype="float32")
                nrm = float(np.linalg.norm(a))
                vecs.append((a / nrm if nrm > 0 else a).tolist())
            yield pd.Series(vecs)

    return _embed


def tfidf_features(df: DataFrame, text_col: str, vocab_size: int = 3000, id_col: str = "id", out_col: str = "features",
                   stopwords: Sequence[str] = W.ENGLISH_STOPWORDS, texts: K.CodedTexts | None = None):
    """D6 (default backend, ML form of C7) on 1- and 2-grams
    (:func:`postlens.operators.keywords.ngram_terms`).

    The vocabulary is the ``vocab_size`` terms with the highest total count
    (ties by term); only those rows and the words they are made of reach the driver.
    Vectors are term counts over that vocabulary × idf = ln((1+N)/(1+df)) + 1,
    L2-normalised.  Returns ``(featurize, df_with_features)``; ``featurize``
    applies the same vectoriser to any frame with ``text_col`` or, of ``texts`` (the coded texts of ``df``, if they are
    there), to their table, and the frame with features has the ids alone beside them, dealt by id (so that fits are the same again)."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    voc = texts.vocabulary([id_col], vocab_size) if texts is not None else K.vocabulary(df, [id_col], text_col, vocab_size, stopwords)
    if voc is not None:
        idf, n_docs, table = voc.idf(0), voc.n_docs.get(0, 0), voc.table.select(id_col, "__tf")

        def counted(frame: DataFrame) -> DataFrame:
            return voc.counted_codes(frame, texts.words) if texts is not None and CODES in frame.columns else voc.counted(frame, text_col)
    else:
        src = df.select(id_col, K.ngram_terms(F.col(text_col), stopwords).alias("__terms"))
        tf = src.select(id_col, F.explode("__terms").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
        stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        top = stats.orderBy(F.col("total").desc(), "term").limit(int(vocab_size)).collect()
        n_docs = df.count()
        cv = CountVectorizerModel.from_vocabulary([r["term"] for r in top] or ["__empty__"], inputCol="__terms", outputCol="__tf")
        idf = [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in top]

        def counted(frame: DataFrame) -> DataFrame:
            if CODES in frame.columns:  # no texts: by id
                return frame.join(table.withColumnRenamed(id_col, "__id"), F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
            return cv.transform(frame.withColumn("__terms", K.ngram_terms(F.col(text_col), stopwords))).drop("__terms")

        table = counted(df.select(id_col, text_col)).select(id_col, "__tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf or [0.0]), inputCol="__tf", outputCol="__idf")
    norm = Normalizer(inputCol="__idf", outputCol=out_col, p=2.0)

    def weighted(frame: DataFrame) -> DataFrame:
        return norm.transform(scale.transform(frame)).drop("__tf", "__idf")

    table = table.repartition(max(n_docs // VECTORS, df.sparkSession.sparkContext.defaultParallelism), id_col)
    return lambda frame: weighted(counted(frame)), weighted(table)
