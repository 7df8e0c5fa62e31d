"""The Jaccard join, the mix and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import mixing, ngram_join
from postlens.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)


def shingles(text):
    own = (text or "").encode().split()
    return frozenset([tuple(own)] if 0 < len(own) < 5 else (tuple(own[i:i + 5]) for i in range(len(own) - 4)))


def brute_classes(rows):
    """Least id of the class and number of links of each row, by comparing all pairs that share a token."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    part, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j > i)
        for j, k in common.items():
            if 10 * k >= 8 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                part[top(i)] = top(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)].append(d)
    return Counter((d, min((x for x in low[top(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows))


def got_classes(docs):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(docs).collect())


def test_runs_reach_the_recall():
    assert ngram_join.runs(0.9999) == 6 and ngram_join.runs(0.9) == 2


def test_join_of_all_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert got_classes(docs) == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "s"))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(200 + i, common + " " + " ".join(f"y{rng.randrange(10**9)}" for _ in range(200)), "s") for i in range(150)]
    docs = frame(spark, rows)
    want = brute_classes([(d, t) for d, t, _ in rows])
    assert got_classes(docs) == want
    for name, value in (("SMALL", 8), ("BLOCK", 16)):
        monkeypatch.setattr(ngram_join, name, value)
    assert got_classes(docs) == want


def test_join_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "a b", "s"), (5, "a  b", "s"), (6, text, "s"), (6, text, "s"),
            (None, text, "s"), (None, text + " more", "s"), (7, "t " * 5000, "s"), (8, "t " * 9000, "s")]
    docs = frame(spark, rows)
    got = got_classes(docs)
    assert got == Counter([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 3), (6, 6, 3), (None, 6, 3), (None, 6, 3), (7, 7, 1), (8, 7, 1)])
    assert ngram_join.classes(frame(spark, [])).count() == 0
    kept = ngram_join.deduplicated(docs.withColumn("class_id", F.lit("x")))
    assert kept.columns == [*docs.columns, "class_id"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7])


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    one, two = (" ".join(f"{a}{i}" for i in range(60)) for a in "ab")
    rows = [(1, one + " more", "s"), (5, one, "s"), (5, two, "s"), (5, two, "t"), (6, two + " more", "s"), (7, one, "s")]
    for order in (rows, rows[::-1]):
        kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.deduplicated(frame(spark, order)).collect())
        assert kept == [(1, one + " more"), (5, two)]


def test_connected_parts(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    part = {x: x for e in edges for x in e}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        part[y] = x
    got = {r["a"]: r["b"] for r in ngram_join.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in part if top(x) != x}


# --- mixing -----------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Deal by weight, cap, and deal the excess anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in add:
            target[s] += add[s]
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "z", "c", "empty"][: 3 + seed * 2]
    rows = [(i if rng.random() > 0.05 else None, " ".join("w" * rng.randint(0, 30)), s) for i, s in enumerate(rng.choices(names[:-1], k=300))]
    rows += [(1000, "", names[-1]), (1001, None, names[-1]), (1002, "x y", "dup"), (1002, "x y", "dup")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-3) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-6)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("times", F.lit(1))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows, known = out.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(known[r["doc_id"]] == r["text"] for r in rows)
    taken = {r["doc_id"]: (r["taken"], r["size"], r["source"], r["target"]) for r in mixing.mix(docs).collect()}
    times = Counter(r["doc_id"] for r in rows)
    assert all(abs(times[d] - t[0] / t[1]) <= 0.5 for d, t in taken.items() if t[1])
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


# --- the pipeline -----------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][1:2] == ["n-gram Jaccard join"] and len(p.STAGES) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, at = docs.columns, docs
    for i, (_, stage) in enumerate(p.STAGES):
        before = at
        at = stage(spark, at, SMALL).persist()
        if i < 4:
            assert at.columns == columns
        if i == 0:
            ids = {r["doc_id"] for r in at.collect()}
            assert ids <= {r["doc_id"] for r in before.collect()}
        if i == 1:
            want = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in at.collect()) == sorted({c for _, c, _ in want})
        if i == 2:
            assert at.count() == before.count()
    rows = at.collect()
    assert rows and all(r["restored"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    whole = QUERIES["pipeline"](spark, SMALL).collect()
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert Counter(map(key, rows)) == Counter(map(key, whole))


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    at = frame(spark, [])
    for _, stage in p.STAGES:
        at = stage(spark, at, SMALL)
    assert at.count() == 0


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as p

    at = frame(spark, [(1, None, None), (None, "text " * 20, "s"), (2, "", "s"), (2, "", "s")]).withColumn("size", F.lit(None).cast("string"))
    for i, (_, stage) in enumerate(p.STAGES):
        at = stage(spark, at, SMALL)
        if i < 4:
            assert at.columns[-1] == "size"
    assert np.all([r["restored"] for r in at.collect()])
