"""Runs by suffix trees, against comparing words at every distance."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

from postlens.llm import periodic_runs as P
from postlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(own, least, turns):
    out = []
    for q in range(1, len(own) // turns + 1):
        i = 0
        while i + q < len(own):
            j = i
            while j + q < len(own) and own[j] == own[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= least and n >= turns * q and not any(all(own[x] == own[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    """The row of the query, computed plainly."""
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(own)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    found = brute(own, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(own) if not any(s + q <= i < s + m for s, m, q in found)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("least, turns", [(2, 2), (4, 2), (6, 3), (24, 3), (9, 3), (10, 4)])
def test_runs_of_random_words(least, turns):
    rand = random.Random(least * 10 + turns)
    for _ in range(300):
        n, letters = rand.randint(0, 70), rand.randint(1, 4)
        own = [rand.randrange(letters) for _ in range(n)]
        if n and rand.random() < 0.6:
            p, s = rand.randint(1, 12), rand.randrange(n)
            own = own[:s] + [own[s + i % min(p, n - s)] for i in range(n - s)]
            if rand.random() < 0.5:
                own[rand.randrange(n)] = 99
        assert P.runs(own, least, turns) == brute(own, least, turns)


def test_longest_common_extensions():
    rand = random.Random(2)
    for _ in range(60):
        own = [rand.randrange(3) for _ in range(rand.randint(2, 40))]
        tour, n = P.Tour(own, both=True), len(own)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
        got = tour.common(*map(P.np.array, zip(*pairs))).tolist()
        assert got == [next((k for k in range(n - b) if own[a + k] != own[b + k]), n - b) for a, b in pairs]
        # leaves stand in the order of the suffixes, and of those with the words' order turned round
        assert sorted(range(n + 1), key=lambda i: own[i:]) == P.np.argsort(tour.rank).tolist()
        assert sorted(range(n + 1), key=lambda i: [-x for x in own[i:]]) == P.np.argsort(tour.opposite).tolist()


def test_query_on_the_given_table(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    out = QUERIES["op12_periodic_runs"](spark, SMALL)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(plain(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


ODD = [None, "", " ", "a", "a " * 23, "a " * 24, "a " * 25, "a b " * 12, "a b " * 12 + "a", "x " + "a b c d e f g h i " * 3 + "y",
       "a b c d e f g h i " * 2 + "a b c d e f g h", "ü 中 " * 30, "a b " * 20 + "a c " * 20, "a " * 30 + "b " * 30,
       "p q r " * 9 + "z " + "p q r " * 9, "\x00 \x01 " * 15, "same " * 30000, " ".join(map(str, range(5000))) + " k l" * 3000]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD[:-2])] + [(None, "a " * 30), (None, None), (10**12, "a b " * 20), (10**12, "a b " * 20)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, start int")
    got = P.digest(P.find(df, P.looped))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*r) for r in rows), key=str)
    assert P.digest(P.find(df.where("false"), P.looped)).collect() == []


def test_long_texts_and_general_form(spark):
    df = spark.createDataFrame(list(enumerate(ODD[-2:])), "doc_id long, text string")
    a, b = (r for r in P.find(df).orderBy("doc_id").collect())
    assert [tuple(r) for r in a["runs"]] == [(0, 30000, 1)] and a["collapsed"] == "same"
    assert [tuple(r) for r in b["runs"]] == [(5000, 6000, 2)] and b["collapsed"].endswith(" 4999 k l")


def test_million_words_in_one_run():
    own = [i % 1000 for i in range(400_000)]
    assert P.runs(own) == [(0, 400_000, 1000)] and len(P.collapse(own, P.runs(own))) == 1000


def test_steepest_run_is_exact(spark):
    runs = [(5, 10**9 + 1, 10**9 // 3), (3, 3 * 10**8, 10**8), (2, 9, 3), (1, 9, 3)]
    df = spark.createDataFrame([(runs,), ([],), (runs[2:],)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r[0] and tuple(r[0]) for r in df.select(P.steepest(df["runs"])).collect()]
    assert got == [runs[0], None, runs[3]]
