"""Tokens of texts."""

from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.operators import scoring as S


def test_classes_by_ranges_are_the_negated_ones(spark):
    """the classes that cut tokens are written as ranges; they hold what the negated ones hold, and take less time."""
    rows = spark.range(0x10000).where(~F.col("id").between(0xD800, 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    for ranges, negated in ((X.NON_TOKEN, r"[^a-z0-9']+"), (X.NON_ALNUM, r"[^a-z0-9\s']")):
        assert "[^" not in ranges
        assert rows.where(char.rlike(f"^(?:{ranges})$") != char.rlike(f"^(?:{negated})$")).count() == 0
    odd = spark.createDataFrame([("Don't  STOP—naïve\t5x\n't http://a.b/c @you #x 😀z",)], "text string")
    assert odd.select(X.tokens("text")).first()[0] == ["don't", "stop", "na", "ve", "5x", "'t", "z"]
    assert odd.select(X.normalize_text("text")).first()[0] == "don't stop na ve 5x 't z"


def test_a_text_is_cut_once_for_all_lexicons(spark):
    """each aspect and each side of the sentiment cut the text again."""
    df = spark.createDataFrame([(1, "late late refund, app"), (2, None), (3, "good, Good! late")], "id int, text string")
    sentiment = S.run_sentiment(df, "text", positive=["good"], negative=["late"])
    aspects = S.run_aspects(df, "text", lexicons={"delivery": ["late", "parcel"], "returns": ["refund"], "app_ux": ["app", "late"], "pricing": ["x"]})
    for out in (sentiment, aspects):
        assert out._jdf.queryExecution().executedPlan().toString().count("split(") == 1 and "__toks" not in out.columns
    assert [r["sentiment_label"] for r in sentiment.orderBy("id").collect()] == ["negative", "neutral", "positive"]
    assert [(r["aspect_delivery"], r["aspect_returns"], r["aspect_app_ux"], r["aspect_staff"]) for r in aspects.orderBy("id").collect()] == [
        (0.5, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.5, 0.0)]


def _odd_texts(spark):
    rows = [(i, i % 3 if i % 7 else None, " ".join(f"w{(i * j) % 23} w{j % 5}x the É{j % 2}'" for j in range(1, 9 + i % 4))) for i in range(60)]
    rows += [(100, 0, None), (101, 1, ""), (102, 2, "a b c"), (103, 5, "solo"), (104, 6, ""), (105, 1, "tie tie tie 't__ 日本 日本")]
    return spark.createDataFrame(rows, "id long, theme int, text string")


def test_tfidf_keeps_common_words_only(spark, monkeypatch):
    """All 1- and 2-grams were shuffled, and kept in executors' storage; what comes out is the same as by joins,
    at cuts within ties and for words that one group alone has."""
    from postlens.operators import keywords as K

    df = _odd_texts(spark)
    monkeypatch.setattr(type(df), "persist", lambda *a: (_ for _ in ()).throw(AssertionError("kept")))
    stop = ["the"]
    for group in (None, "theme"):
        for n in (1, 4, 9, 40, 500):
            new = K.tfidf(df, "id", "text", group, n, stop)
            old = K._joined_tfidf(df, "id", "text", group, n, stop, 2, False, 2_000_000, None)
            assert new.columns == old.columns
            cut = [[tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()] for f in (new, old)]
            assert sorted(cut[0], key=repr) == sorted(cut[1], key=repr) and cut[0]
    before = K.theme_keywords(df, doc_col="id").collect()
    monkeypatch.setattr(K, "VOCABULARY", 1)  # too much for the driver: joins
    assert sorted(K.theme_keywords(df, doc_col="id").collect()) == sorted(before) and before
    assert K.vocabulary(df, ["id"], "text", 5, stop) is None
    again = df.unionByName(df.where("id < 5"))  # documents of several rows
    assert K.tfidf(again, "id", "text", None, 9, stop).groupBy("id", "term").count().where("count > 1").isEmpty()


def test_two_grams_of_rare_words_are_not_counted(spark):
    """Only 2-grams of two common words leave a task."""
    from postlens.operators import keywords as K

    df = spark.createDataFrame([(i, i % 2, f"common word r{i} s{i} common word") for i in range(50)], "id long, theme int, text string")
    tf = K._common_tf(df, "theme", "text", 2, [])
    assert sorted(map(tuple, tf.collect())) == [(i, term, 50) for i in (0, 1) for term in ("common", "common word", "word")]
    marked = K.marked_words(df.limit(1), "text", ["common", "word"], ["s0"]).first()["__words"]
    assert marked == ["common", "word", None, "common", "word"]


def test_terms_are_counted_on_codes(spark):
    """F16: words were strings in every pass, and each pass made the 2-grams again; vectors on codes are those of CountVectorizer."""
    from pyspark.ml.feature import CountVectorizerModel

    from postlens.operators import keywords as K

    df = _odd_texts(spark).coalesce(2)
    voc = K.vocabulary(df, ["id"], "text", 40, ["the"])
    assert "split(" not in voc.table._jdf.queryExecution().toString()
    terms = df.select("id", K.ngram_terms(F.col("text"), ["the"]).alias("t"))
    plain = CountVectorizerModel.from_vocabulary(voc.terms, inputCol="t", outputCol="v").transform(terms)
    expected = {r["id"]: r["v"] for r in plain.select("id", "v").collect()}
    assert {r["id"]: r["__tf"] for r in voc.table.collect()} == expected
    assert {r["id"]: r["__tf"] for r in voc.counted(df, "text").select("id", "__tf").collect()} == expected and len(voc.terms) == 40


def test_coded_texts_hold_all_words(spark, monkeypatch):
    """the theme job kept the posts' texts, and cut them in every pass; counts on codes and rare words are the same."""
    from postlens.operators import keywords as K

    monkeypatch.setattr(K, "CODED_WORDS", 3)
    df = _odd_texts(spark).where(F.col("theme").isNotNull()).coalesce(2)
    texts = K.CodedTexts(df, ["id", "theme"], "text", K.W.ENGLISH_STOPWORDS)
    assert len(texts.words) == 3 and texts.table.columns == ["id", "theme", "__codes", "__rare"]
    sizes = {r["theme"]: r["count"] for r in df.groupBy("theme").count().collect()}
    new = K.coded_theme_keywords(texts, texts.table, sizes).collect()
    assert sorted(new) == sorted(K.theme_keywords(df, doc_col="id").collect()) and new
    frame, feats = S.tfidf_features(df, "text", 9, texts=texts)
    plain = {r["id"]: r["features"] for r in S.tfidf_features(df, "text", 9)[1].collect()}
    assert {r["id"]: r["features"] for r in feats.collect()} == plain
    assert {r["id"]: r["features"] for r in frame(texts.table).collect()} == plain
    monkeypatch.setattr(K, "VOCABULARY", 1)  # too much for the driver: joins
    assert K.coded_theme_keywords(texts, texts.table, sizes) is None
    frame, feats = S.tfidf_features(df, "text", 9, texts=texts)
    joined = {r["id"]: r["features"] for r in feats.collect()}
    assert {r["id"]: r["features"] for r in frame(texts.table).collect()} == joined and len(joined) == df.count()


def test_logistic_fit_sends_a_gradient_a_core(spark, monkeypatch):
    """texts were cut in each pass of the fit, and each partition of the input sent a gradient of all features in each round."""
    from pyspark.ml.classification import LogisticRegression

    cores, seen, fit = spark.sparkContext.defaultParallelism, [], LogisticRegression.fit
    rows = [(i, f"good fine w{i % 7}" if i % 2 else f"late bad w{i % 5}", i % 2) for i in range(3 * cores)]
    df = spark.createDataFrame(rows, "id int, text string, y int").repartition(3 * cores)
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, data: seen.append(data) or fit(self, data))
    model = S.train_logistic_sentiment(df, "text", "y", num_features=64, max_iter=5)
    assert seen[0].rdd.getNumPartitions() <= cores and "RegexTokenizer" not in seen[0]._jdf.queryExecution().toString() and "text" not in seen[0].columns
    out = S.apply_logistic_sentiment(model, df, {0: "negative", 1: "positive"}).collect()
    assert all(r["sentiment_label"] == ("positive" if r["y"] else "negative") for r in out) and len(out) == len(rows)


def test_tfidf_of_texts_without_words(spark):
    """F16: no text has a word; the list of weights was cast from an empty string."""
    from postlens.operators import keywords as K

    df = spark.createDataFrame([(1, None), (2, ""), (3, "the a ! ?")], "id long, text string").coalesce(1)
    assert K.tfidf(df, "id", "text").collect() == []


def test_batches_are_cut_as_the_jvm_cuts(spark):
    """texts were cut by a regular expression in the JVM and went to Python as arrays of strings; all letters, and lower cases of
    other lengths or by what stands around, are cut alike."""
    import pyarrow as pa

    from postlens.operators import keywords as K

    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    every = spark.range(0x110000).where("id not between 55296 and 57343 and id != 65279 and (id < 262144 or id % 97 = 0)")
    every = every.groupBy(F.floor(F.col("id") / 512)).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("aB"), char, F.lit("Cd e")).alias("c")))), lambda x: x["c"])).alias("text"))
    odd = ["Straße ÉCOLE x_1 日本 İstanbul ΣΟΦΟΣ. ΑΣ Σ Kelvin ȺȾ 😀z𝐀 ٣x", None, "", "...", "a", "Tail", "head ", "ÀÉ", "é", " é é"]
    df = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(every.select("text")).select("text", K.split_words(F.col("text")).alias("w")).coalesce(1).toArrow()
    texts = pa.concat_arrays(df["text"].cast(pa.string()).chunks)
    cutter = K.words_cutter(every)
    expected = [[x for x in w if x] for w in df["w"].to_pylist()]
    for part in (texts, texts.slice(3), texts.slice(1, 1), texts.slice(0, 0)):
        words, ends = cutter.cut(part)
        words, first = words.to_pylist(), {3: 3, 1: 1}.get(part.offset, 0)
        assert [words[a:b] for a, b in zip(ends, ends[1:])] == expected[first:first + len(part)]
    broken = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(bytes([0, 0, 0, 0, 4, 0, 0, 0, 6, 0, 0, 0])), pa.py_buffer(b"a\xffb cd")])
    assert cutter.cut(broken)[0].to_pylist() == ["a", "b", "cd"]


def test_words_of_groups_are_counted_once_they_are_common(spark, monkeypatch):
    """all words were counted by theme, and 2-grams were rows of strings; only counts of the vocabulary's terms are kept."""
    from postlens.operators import keywords as K

    df = _odd_texts(spark).where(F.col("theme").isNotNull()).coalesce(2)
    kept = K._common_tf(df, "theme", "text", 4, ["the"])
    assert kept.select("term").distinct().count() < 12 and "split(" not in kept._jdf.queryExecution().toString()
    for n in (1, 4, 40, 500):
        new, old = (K._joined_tfidf(df, "theme", "text", None, n, ["the"], 2, True, 2_000_000, tf) for tf in (K._common_tf(df, "theme", "text", n, ["the"]), None))
        cut = [sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()], key=repr) for f in (new, old)]
        assert cut[0] == cut[1] and cut[0]
    assert K.tfidf(df.where("id = 101 or id = 102"), "theme", "text", None, 5, ["the"], docs_are_groups=True).count() == 0


def test_tokens_of_lexicons_are_cut_once(spark, tmp_path):
    """F8: sentiment and aspects each cut a text in the JVM; all letters, URLs, mentions and hashtags give the same tokens."""
    from postlens.functions.text import NON_TOKEN
    from postlens.operators.cutting import TokenCutter
    from postlens.plans import stages as P
    from postlens.sources.files import read_stage

    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    every = spark.range(0x20000).where("id not between 55296 and 57343 and id != 65279")
    every = every.groupBy(F.floor(F.col("id") / 128)).agg(F.array_join(F.sort_array(F.collect_list(F.concat(char, F.lit(" @aB"), char, F.lit("Cd http://x"), char, F.lit("y HTTPS://"), char))), "").alias("text"))
    odd = ["Don't STOP\t5x\n't http://a.b/c @you #x 😀z", "@Kelvin @xİy #İ z", "HtTp://A b c", "http:/ @ # @é", None, "", "mail a@b.cd e", "İI #ΑΣ Σ"]
    df = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(every.select("text")).select("text", X.tokens("text").alias("t")).coalesce(1).toArrow()
    words, ends = TokenCutter.of(spark, NON_TOKEN).cut(df["text"].combine_chunks())
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(ends, ends[1:])] == [t or [] for t in df["t"].to_pylist()]

    path = f"{tmp_path}/in.parquet"
    rows = [(i, f"2024-01-{1 + i % 28:02d}", ["Good @late app! refund", None, "late, late good APP"][i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "id int, createdat string, text string").write.parquet(path)
    lexicon, aspects = {"positive": ["good"], "negative": ["late"]}, {"delivery": ["late"], "returns": ["refund"], "app_ux": ["app", "late"]}
    out = P.run_all(spark, path, str(tmp_path), lexicon, aspects)
    assert "__found" not in out.columns and out.count() == 60
    plain = S.run_aspects(S.run_sentiment(read_stage(spark, path), "text", **lexicon), "text", lexicons=aspects)
    names = ["id", "sentiment_label", "sentiment_score", "aspect_delivery", "aspect_returns", "aspect_app_ux", "aspect_staff", "aspect_dominant"]
    assert sorted(out.select(names).collect()) == sorted(plain.select(names).collect())


def test_stages_cut_texts_on_batches(spark, tmp_path, monkeypatch):
    """the notebook's sentiment and aspect stages cut texts by a regular expression in the JVM."""
    from postlens.plans import stages as P

    seen, write = [], P.write_stage
    monkeypatch.setattr(P, "write_stage", lambda df, path: seen.append(df._jdf.queryExecution().toString()) or write(df, path))
    rows = [(i, ["Good @late app! refund", None, "late, late good APP"][i % 3]) for i in range(6)]
    spark.createDataFrame(rows, "id int, text string").write.parquet(f"{tmp_path}/s0")
    P.run_stage1(spark, f"{tmp_path}/s0", f"{tmp_path}/s1", "text", positive=["good"], negative=["late"])
    out = P.run_stage2(spark, f"{tmp_path}/s1", f"{tmp_path}/s2", "text", {"delivery": ["late"], "returns": ["refund"]})
    assert len(seen) == 2 and not any("split(" in plan for plan in seen) and "__toks" not in out.columns
    assert [(r["sentiment_label"], r["aspect_delivery"], r["aspect_returns"]) for r in out.orderBy("id").limit(3).collect()] == [
        ("positive", 0.0, 1.0), ("neutral", 0.0, 0.0), ("negative", 1.0, 0.0)]


def test_words_are_counted_without_a_match_each():
    """each word of a text was a match of a regular expression, only to be counted for batches of like length."""
    import re
    import time

    blanks = "".join(map(chr, range(0x40))) + "a\x85b\xa0c d　e\x1cf\ud800 é"
    texts = [blanks, "", " ", " a  b ", *(f"x{chr(i)}y" for i in range(0x3100))]
    plain = lambda t: sum(1 for _ in re.finditer(r"[^\x20\x09-\x0D]+", t))
    assert [S.n_words(t) for t in texts] == [plain(t) for t in texts]
    long, took = "some words " * 100_000, []
    for count in (S.n_words, plain):
        at = time.perf_counter()
        count(long)
        took.append(time.perf_counter() - at)
    assert took[0] < took[1]
