"""Operators that map texts, against plain forms of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from postlens.llm import bpe, html_template, langid, licenses, pii, quality, repetition, syncmers
from postlens.llm.common import fresh, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


ODD = [None, "", " ", "a", "\n\n", "ünï 中文 \U0001f600", "x " * 3000, "x " * 3000, "a@b.c 1.2.3.4 +1 (310) 555-4510"]


def test_words_and_fresh(spark):
    for t in ODD:
        assert [w.decode() for w in words(t)] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert fresh(spark.createDataFrame([(1, 2)], "a int, A_ int"), "a") == "a__"


# --- byte-level BPE ---------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.PerfectHash(bpe.read_ranks(RANKS)), public.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    entries = bpe.read_ranks(RANKS)
    table = bpe.PerfectHash(entries)
    assert sorted(table.ids.tolist()) == list(range(len(entries)))
    assert [table.find(e) for e in entries] == list(range(len(entries)))
    assert table.find(b"no such entry at all") == -1


def test_bpe_equals_tiktoken(encoder, reference):
    rng = random.Random(4)
    alphabet = "ab cd  \n\t\x0b\x1c\x85\xa0 é中1234'sS'll!?&&%% 　́²½ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [t for t in ODD if t] + ["".join(rng.choice("abcdefgh") for _ in range(20_000))]
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_round_trip_on_all_documents(spark, docs, reference):
    rows = bpe.round_trip(docs, RANKS, public.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_bpe_odd_rows(spark):
    out = bpe.round_trip(frame(spark, ODD).withColumn("ids", F.lit(7)), RANKS, public.PATTERN)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0 and rows[0]["ids"] == 7
    assert rows[6]["ids_sha256"] == rows[7]["ids_sha256"]
    assert bpe.round_trip(frame(spark, []), RANKS, public.PATTERN).count() == 0


# --- quality rules ----------------------------------------------------------
def brute_repeats(own):
    n = len(own)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and own[i + k] == own[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    return longest


def test_longest_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        flat = np.array([ord(x) for t in texts for x in t], np.int64)
        counts = [len(t) for t in texts]
        assert repetition.longest_repeats(flat, np.repeat(np.cumsum(counts), counts)).tolist() == sum(map(brute_repeats, texts), [])


def test_quality_rules_against_plain_rules(spark, docs):
    docs = docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in repetition.rules(docs).collect()}
    alone = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        windows = [tuple(own[i:i + 5]) for i in range(len(own) - 4)]
        often = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        r = got[doc_id]
        assert r["n_repeat_words"] == len(hit)
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(own), sum(map(len, own)), again)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(own) < 10 or 100 * r["n_repeat_words"] > 20 * len(own))
        assert not (r["base_failed"] and r["kept"])

        def said_twice(n):
            at = {}
            for i in range(len(own) - n + 1):
                at.setdefault(tuple(own[i:i + n]), []).append(i)
            return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}

        total = sum(map(len, own))
        fine = all(sum(len(own[i]) for i in said_twice(n)) / max(1, total) <= most for n, most in repetition.MOST_COVERED)
        assert r["kept"] == (not r["base_failed"] and fine and not said_twice(51))
        alone += not r["base_failed"] and not r["kept"]
    assert alone  # the method rejects some that the base rule lets through


def test_each_limit_of_the_method(spark):
    rng = random.Random(6)
    new = lambda n: " ".join(f"w{rng.randrange(10**8, 10**9)}" for _ in range(n))

    def twice(said, rest):
        passage = new(said)
        return f"{passage} {new(rest // 2)} {passage} {new(rest - rest // 2)}"

    # of 1000 words, so many are in a passage of a length that is said twice or in several such passages
    cases = [(twice(50, 2000), True), (twice(51, 2000), False), (twice(5, 90), True), (twice(5, 50), False), (twice(10, 181), True), (twice(10, 170), False),
             (" ".join(twice(5, 60) for _ in range(9)), True), (" ".join(twice(5, 52) for _ in range(9)), False), (" ".join(twice(9, 150) for _ in range(9)), True),
             (" ".join(twice(9, 140) for _ in range(9)), False)]
    rows = {r["doc_id"]: r for r in repetition.rules(frame(spark, [t for t, _ in cases])).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert [rows[i]["kept"] for i in range(len(cases))] == [k for _, k in cases]


def test_quality_rules_limits(spark):
    rng = random.Random(1)
    new = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = new(110)
    rows = {r["doc_id"]: r for r in repetition.rules(frame(spark, [*ODD, new(300), new(800) + " " + passage + " " + new(800) + " " + passage])).collect()}
    assert rows[0]["base_failed"] and rows[0]["n_words"] == 0 and rows[2]["n_words"] == 0
    assert rows[6]["covered"] == 1.0 and rows[6]["n_repeat_words"] == 3000
    clean, long = rows[len(ODD)], rows[len(ODD) + 1]
    assert clean["kept"] and clean["n_repeats"] == 0
    assert not long["base_failed"] and not long["kept"] and long["longest_repeat"] == 110
    assert repetition.rules(frame(spark, [])).count() == 0


# --- fingerprints -----------------------------------------------------------
def brute_anchors(text):
    points = [ord(c) + 1 for c in text]
    base, word = int(syncmers.BASE), (1 << 64) - 1

    def run(at, n):
        h = 0
        for p in points[at:at + n]:
            h = (h * base + p) & word
        return h

    def mixed(h):
        h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & word
        return h ^ (h >> 32)

    out = []
    for i in range(len(points) - syncmers.K + 1):
        inner = [mixed(run(i + j, syncmers.S)) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(mixed(run(i, syncmers.K)) >> 32)
    return out


def test_anchors_against_plain_form():
    rng = random.Random(2)
    for n in (24, 25, 40, 90):
        text = "".join(rng.choice("abcdé ") for _ in range(n))
        with np.errstate(over="ignore"):
            got = syncmers.anchors(text).tolist()
        assert got == brute_anchors(text) or (not brute_anchors(text) and len(got) == 1)


def brute_chain(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_likeness_of_sequences_without_repeats():
    rng = random.Random(5)
    for _ in range(100):
        a, b = (rng.sample(range(30), rng.randint(0, 20)) for _ in range(2))
        want = 2 * brute_chain(a, b) / (len(a) + len(b)) if a and b else float(a == b)
        assert syncmers.likeness(np.array(a, np.uint32), np.array(b, np.uint32)) == pytest.approx(want)


@pytest.mark.parametrize("ids", [None, [5, 5, None, None, 9, 7, 1, 1, -3]])
def test_fingerprints_follow_descending_ids(spark, ids):
    ids = list(range(len(ODD))) if ids is None else ids
    rows = syncmers.fingerprints(frame(spark, ODD, ids)).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
    order = sorted(zip(ids, ODD, strict=True), key=lambda x: (x[0] is None, -(x[0] or 0)))
    for r in rows:
        if ids.count(r["doc_id"]) == 1:
            at = [i for i, (d, _) in enumerate(order) if d == r["doc_id"]][0]
            after = order[(at + 1) % len(order)]
            if ids.count(after[0]) == 1:
                edited = syncmers.edited(order[at][1] or "", after[1] or "")
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_of_documents(spark, docs):
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    rows = docs.select("doc_id", "text").orderBy(F.col("doc_id").desc()).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, (doc_id, text) in enumerate(rows):
        r, after = got[doc_id], rows[(i + 1) % len(rows)]["text"] or ""
        cut = len(text or "") // 3
        edited = (text or "")[:len(text or "") - cut] + after[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text or "")
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert np.median([r["near_edited"] for r in long]) == pytest.approx(2 / 3, abs=0.05)
    assert np.median([r["near_next"] for r in long]) < 0.05
    assert syncmers.fingerprints(frame(spark, [])).count() == 0
    one = syncmers.fingerprints(frame(spark, ["only one"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# --- licences ---------------------------------------------------------------
def test_licence_forms(spark):
    mit = dict(licenses.KNOWN[::-1])
    texts = ["text\nLicenced  under the apache licence, v2.0\nmore", "Copyright (c) 2020 Someone\nReleased under the MIT License.", None, "",
             "This says: released under the MIT License. And more.", "text\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0",
             "© A. Body\n" + [t for n, t in licenses.KNOWN if n == "ISC"][0].upper(), "This work is licensed under the GNU GPL version 3."]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [rows[i]["licenses"] for i in range(len(texts))] == ["Apache-2.0", "MIT", "", "", "", "CC-BY-NC-4.0", "ISC", "GPL-3.0"]
    assert [rows[i]["whole"] for i in range(len(texts))] == [False, True, False, False, False, False, True, True]
    assert rows[5]["n_lines"] == 2 and mit
    twice = licenses.scan(frame(spark, [texts[5], texts[5]], [1, 1])).collect()
    assert [r["n_lines"] for r in twice] == [2, 2]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_first_words_lose_no_licence(spark):
    """A unit that is passed over by its first word has no known canonical form."""
    rnd = random.Random(8)
    pieces = [w for old, new in licenses.SPELLINGS for w in (old, new)] + [w for w in ("v2", "Version 2", "version", "v", "3", "the", "MIT", "Licence", "é", "#", "(c)", "copyright")]
    units = [rnd.choice(["", " ", "* "]) + " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 3))) + " " + rnd.choice(notices)
             for notices in [[t[:60] for _, t in licenses.texts()]] for _ in range(3000)]
    words = licenses.opening_words(spark)
    rows = spark.createDataFrame([(u,) for u in units], "unit string").select(
        licenses.possible(F.col("unit"), words).alias("able"), licenses.canonical(F.col("unit")).alias("form"), F.rlike("unit", F.lit(licenses.EMPTY)).alias("empty")).collect()
    assert all(r["able"] or r["form"].split(" ")[0] not in words for r in rows)
    assert all((r["form"] == "") == r["empty"] for r in rows) and 0 < sum(r["able"] for r in rows) < len(rows)


def test_whole_licences_and_wrapped_notices(spark):
    import textwrap

    body = dict(licenses.texts())
    mit, bsd = [next(t for n, t in licenses.texts() if n == k and len(t) > 500) for k in ("MIT", "BSD-3-Clause")]
    cases = [("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + textwrap.fill(mit, w)) for w in range(20, 100, 7)]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2020 Someone\nAll rights reserved.\n\n" + textwrap.fill(bsd, w)) for w in range(20, 100, 9)]
    for path in sorted(licenses.TEXTS.glob("*.txt")):
        text = path.read_text()
        cases += [(path.stem, text), (path.stem, textwrap.fill(" ".join(x for x in text.split("\n") if not licenses.re.search(licenses.TRUE_COPYRIGHT, x.strip())), 72))]
    cases += [("Unlicense", licenses.UNLICENSE)]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, [t for _, t in cases])).collect()}
    assert [(rows[i]["licenses"], rows[i]["whole"]) for i in range(len(cases))] == [(n, True) for n, _ in cases] and body
    # a paragraph that is a notice and crosses a line; no line of it counts
    row = licenses.scan(frame(spark, ["Some words\n\n# This software is released\n# under the MIT\n#\nx", "Some words\n\n# Released\n# under the MIT license\n#\nmore words"])).collect()
    assert [(r["licenses"], r["n_lines"], r["whole"]) for r in sorted(row, key=lambda r: r["doc_id"])] == [("", 0, False), ("MIT", 0, False)]


# --- personal data ----------------------------------------------------------
def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("0123456789. -+@ab()\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


def test_personal_data_of_documents(spark, docs):
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text or ""))
        assert got[doc_id]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert not want or set(want.split(",")) <= set(got[doc_id]["spans"].split(","))


NODE = re.compile(r"[A-Za-z0-9+(._%-]*[0-9@][A-Za-z0-9._%+@()-]*")


def test_nodes_of_random_texts():
    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice("0123456789. -+@ab()%_\n") for _ in range(rng.randint(0, 40)))
        want = []
        for m in NODE.finditer(t):
            token = m[0].rstrip(".-%_()").lstrip("._%-")
            if token:
                a = m.start() + m[0].find(token)
                want.append((a, a + len(token), token))
        assert [n[:3] for n in pii._nodes(t, pii.base_spans(t))] == want


HARD = {"numbers": " ".join(str(1000 + i) for i in range(60_000)), "letters": "a" * 1_000_000, "digits": "1" * 1_000_000, "dots": "1." * 500_000,
        "signs": "a@" * 400_000, "plus": "+1(" * 300_000, "addresses": " ".join(f"u{i}@h.example" for i in range(30_000)),
        "brackets": "(a)" * 300_000 + "1", "phones": "+1 (310) 555-4510 " * 20_000}


@pytest.mark.parametrize("kind", HARD)
def test_hard_texts_take_linear_time(kind):
    import time

    model = pii.learn(pii.counts(iter(["call +1 (310) 555-4510 or a@b.cd 12 13 1.2.3.4 in 1999"])))
    at = time.perf_counter()
    spans = pii._all_spans(HARD[kind], model)
    assert time.perf_counter() - at < 5
    assert len([s for s in spans if s[3]]) == {"dots": 125_000, "addresses": 30_000, "phones": 20_000}.get(kind, 0)


def test_hard_texts_in_the_query_and_the_stage(spark):
    import corpus_pipeline

    df = frame(spark, [*HARD.values(), "mail a@b.cd", None], [*range(len(HARD)), None, None])
    rows = pii.digest(pii.find(df)).collect()
    assert len(rows) == len(HARD) + 2 and sum(r["n_email"] for r in rows) == 30_001
    out = corpus_pipeline.redact_personal_data(spark, df, SMALL).collect()
    assert {r["text"] for r in out if r["doc_id"] is None} == {"mail [email]", None}
    assert [r["text"] for r in out if r["doc_id"] == 0] == [HARD["numbers"]]


def test_weights_count_all_documents(spark):
    texts = ["call +1 (310) 555-4510 or a@b.cd in 1999"] * 50 + ["1.2.3.4 and 5.6.7.8.9", "none"]
    counted = pii.counts(iter(texts))
    assert all(np.allclose(a, b) for a, b in zip(pii.fitted(frame(spark, texts, [None] * len(texts))), pii.learn(counted), strict=True))
    assert pii.fitted(frame(spark, ["none", None])) is None


def test_propagation_on_small_loops_against_all_labellings():
    rng = np.random.default_rng(2)
    for n, pairs in ((3, [(0, 1), (1, 2), (2, 0)]), (4, [(0, 1), (1, 2), (2, 3), (3, 0)]), (5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (0, 2)])):
        for _ in range(20):
            unary = rng.normal(size=(n, 3))
            pots = [rng.normal(scale=0.3, size=(3, 3)) for _ in pairs]
            total = np.zeros((n, 3))
            for y in np.ndindex(*[3] * n):
                w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(p[y[a], y[b]] for (a, b), p in zip(pairs, pots, strict=True)))
                for i in range(n):
                    total[i, y[i]] += w
            got = pii.marginals(unary, [(a, b, p) for (a, b), p in zip(pairs, pots, strict=True)])
            assert np.abs(got - total / total.sum(1, keepdims=True)).max() < 0.05
    # clamped ends decide a loop that nothing else speaks for
    unary = np.zeros((4, 2))
    unary[0] = [0, -30]
    pot = 2 * np.array([[1.0, -1.0], [-1.0, 1.0]])
    assert pii.marginals(unary, [(0, 1, pot), (1, 2, pot), (2, 3, pot), (3, 0, pot)])[:, 0].min() > 0.95


def test_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary = rng.normal(size=(4, 3))
    pots = [rng.normal(size=(3, 3)) for _ in range(3)]
    edges = [(0, 1, pots[0]), (1, 2, pots[1]), (1, 3, pots[2])]
    total = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(p[y[a], y[b]] for a, b, p in edges))
        for i in range(4):
            total[i, y[i]] += w
    assert np.allclose(pii.marginals(unary, edges, rounds=60), total / total.sum(1, keepdims=True), atol=1e-6)


def test_skip_chain_adds_distant_copies(spark):
    filler = " ".join("word" for _ in range(200))
    texts = [f"call +1 (310) 555-45{i:02d} now 12.5 and 1{i}9 {filler}" for i in range(60)]
    texts.append(f"call +1 (310) 555-4510 {filler} or 1 (310) 555-4510 later, in 1999 and 12.5")
    rows = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}
    added = [texts[60][s["start"]:s["end"]] for s in rows[60] if not s["base"]]
    assert added == ["1 (310) 555-4510"] or added == ["(310) 555-4510"] or added == ["310) 555-4510"]
    assert all(s["base"] for i in range(60) for s in rows[i])


def test_all_copies_of_a_base_span_are_found():
    # each node hangs on the clamped one, not on the copy before
    text = ("555.4510@host and " * 6) + "555.4510@host.example " + "555.4510@host and " * 12
    base = pii.base_spans(text)
    nodes = pii._nodes(text, base)
    hub = next(i for i, n in enumerate(nodes) if n[3])
    assert {(hub, i) for i in range(len(nodes)) if i != hub} <= set(pii.alike(nodes))
    for against in (0.0, 0.5):  # neutral weights, and weights against the kind
        weights = np.zeros((len(pii.features("0")), 5))
        weights[0, 1] = -against
        assert len(pii.added_spans(text, base, (weights, np.zeros((5, 5)), np.full((5, 5), -3.0) + 6 * np.eye(5)))) == 18


def test_propagation_settles_on_long_chains():
    n = 60
    unary = np.zeros((n, 2))
    unary[0] = [0, -30]
    pot = np.array([[3.0, -3.0], [-3.0, 3.0]])
    p = pii.marginals(unary, [(i, i + 1, pot) for i in range(n - 1)])
    same = np.exp(3) / (np.exp(3) + np.exp(-3))
    assert np.allclose(p[:, 0], [0.5 + 0.5 * (2 * same - 1) ** i for i in range(n)], atol=1e-4)


def test_redaction(spark):
    out = {r["doc_id"]: r for r in pii.redacted(frame(spark, ODD)).collect()}
    assert out[8]["text"] == "[email] [ip] [phone]" and out[8]["n_chars"] == len(out[8]["text"])
    assert out[0]["text"] is None and out[5]["text"] == ODD[5]
    assert pii.redacted(frame(spark, [])).count() == 0
    assert pii.redact("0123456789", [("ip", 2, 5, True), ("card", 4, 7, True)]) == "01[ip]789"


# --- quality classifier and language ----------------------------------------
def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.scored(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.06


def test_quality_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 3) for r in quality.scored(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, None), (3, 1), (4, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, some).collect())
    assert quality.scored(frame(spark, []), some).count() == 0
    clash = quality.kept(docs.withColumn("quality_score", F.lit("x")), some, threshold=0.0)
    assert clash.columns == [*docs.columns, "quality_score"] and clash.count() == len(ODD)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows if r["lang"] is not None]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the one and the other", "en"), ("der eine und der andere", "de")] * 20)]
    docs = spark.createDataFrame(rows + [(100, None, "en", "s", 1), (101, "12 !!", None, "s", 1), (102, "und der", None, "s", 1)], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0.0
    assert got[102]["lang_pred"] == "de" and got[0]["lang_pred"] == "en"
    far = langid.identify(docs.union(spark.createDataFrame([(103, "жук щука", None, "s", 1)], DOCS))).where("doc_id = 103").first()
    assert far["rejected"]
    nothing = langid.identify(frame(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert nothing["lang_pred"] == "und"
    assert langid.identify(frame(spark, [])).count() == 0


# --- HTML -------------------------------------------------------------------
def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def extract(spark, rows):
    out = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_article_without_furniture(spark):
    body = ("<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site</header><div class='cookie-notice'>We use cookies</div>"
            "<article><h1>Title &amp; more</h1><p>One <b>bold</b>\n word.<br>next<p>Two &lt;x&gt;</p><aside>Side</aside>"
            "<div class=ad>Buy</div><form><input><button>Go</button></form><script>var t='</p>';</script>"
            "<section id=comments><article class=comment><p>First!</p></article></section><ul><li>a<li>b</ul></article>"
            "<footer>(c)</footer>")
    got = extract(spark, [(1, "http://a.example/x", page(body)), (2, None, None), (3, "http://a.example/y", ""), (4, "x", "plain  text")])
    assert got == {1: "Title & more\n\nOne bold word. next\n\nTwo <x>\n\na\n\nb", 2: "", 3: "", 4: "plain text"}


def test_template_text_is_left_out_without_an_article(spark):
    rows = [(i, f"https://b.example/{i}", page(f"<div><p>About this site</p></div><div class=story><p>Story {i} is long enough to be largest</p></div>"
                                               "<div><p>All stories</p></div>")) for i in range(5)]
    assert extract(spark, rows) == {i: f"Story {i} is long enough to be largest" for i in range(5)}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    import html

    got = {r["page_id"]: r for r in html_template.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1|div)>", re.sub(r"</?b>", "", inner))]
        want = "\n\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_classes_of_occurrence_vectors(spark):
    rows = [(i, "http://c.example/", page("<div id=top><p>Same</p></div>" + "<ul>" + "<li>x</li>" * (i + 1) + "</ul>")) for i in range(4)]
    made = html_template.templates(html_template.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))).first()
    assert {p.rpartition("/")[2] for p in made["paths"]} >= {"html", "body", "ul", "div.top"}
    assert not any(p.endswith("/li") for p in made["paths"])
    assert html_template._token("/html/body/div.top/p", "Same") in made["texts"]


def test_template_text_inside_articles_and_copies_of_a_page(spark):
    def made(i, told):
        return page(f"<article><h1>Title {i}</h1><p>{told}</p><div class=tip><p>Read on in our archive</p></div></article>")

    rows = [(i, f"http://d.example/{i}", made(i, f"Story {i} is told here at some length")) for i in range(6)]
    got = extract(spark, rows)
    assert got == {i: f"Title {i}\n\nStory {i} is told here at some length" for i in range(6)}
    # a text without an element of its own class on half of the pages is of the stories, not of the template
    rows = [(i, f"http://d.example/{i}", page(f"<article><p>Story {i} is told here at some length</p>" + "<p>Said twice</p>" * (i % 2) + "<p>x</p></article>")) for i in range(8)]
    assert {i for i, t in extract(spark, rows).items() if "Said twice" in t} == {1, 3, 5, 7}
    same = page("<article><h1>One</h1><p>The same text</p></article>")
    assert set(extract(spark, [(i, "http://e.example/", same) for i in range(5)]).values()) == {"One\n\nThe same text"}


def test_slot_of_many_paragraphs_and_repeated_rows(spark):
    def made(i):
        told = "".join(f"<p>Part {j} of story {i} is told here</p>" for j in range(i + 2))
        return page(f"<div class=left><p>Today {i}</p></div><div class=story>{told}</div>")

    want = {i: "\n\n".join(f"Part {j} of story {i} is told here" for j in range(i + 2)) for i in range(4)}
    assert extract(spark, [(i, f"http://f.example/{i}", made(i)) for i in range(4)]) == want
    assert extract(spark, [(i, f"http://f.example/{i}", made(i)) for i in range(4)] * 2) == want


def test_empty_error_and_other_pages_leave_the_template(spark):
    def made(i, kind):
        return page(f"<div><p>About this site</p></div><div class={kind}><p>Story {i} is long enough to be largest</p></div><div><p>All stories</p></div>")

    rows = [(i, f"https://g.example/{i}", made(i, "story" if i < 12 else "other")) for i in range(20)]
    odd = [(100, "https://g.example/a", None), (101, "https://g.example/b", ""), (102, "https://g.example/c", page("<h1>Not found</h1>"))]
    got = extract(spark, rows + odd)
    assert got == {i: f"Story {i} is long enough to be largest" for i in range(20)} | {100: "", 101: "", 102: "Not found"}


def test_names_own_whole_and_not_what_is_around_the_article(spark):
    told = "<article><h1>Title</h1><p class=notice>A notice in the story</p><section class=related-work><p>Work like this</p></section></article>"
    want = "Title\n\nA notice in the story\n\nWork like this"
    for names in ("class='site has-sidebar'", "class=no-sidebar", "class=page-with-header", "id=search-results", "class=widget", "class='notice social'"):
        assert extract(spark, [(1, "http://h.example/1", page(f"<div {names}><div class=sidebar><article>Teaser</article></div>{told}</div>"))]) == {1: want}, names
    # names still own what is in the article, and hidden or furniture elements own articles too
    body = "<article><p>Kept <span class=share>Share</span> whole</p><div class='box share'>Share</div></article><aside><article>A longer text in an aside</article></aside>"
    assert extract(spark, [(1, "http://h.example/1", page(body))]) == {1: "Kept whole"}


def parsed_rows(spark, sf_dir):
    read = html_template.parsed(spark.read.parquet(f"{sf_dir}/pages.parquet")).cache()
    return read, read.collect(), {r["host"]: r for r in html_template.templates(read).collect()}


def test_classes_against_whole_occurrence_vectors(spark):
    read, rows, made = parsed_rows(spark, "/root/testdata/sf0.01")
    got = {}
    for r in html_template.classes(read).collect():
        got.setdefault(r["host"], {}).setdefault((r["pages"], r["vector"]), set()).add((r["path"], r["token"], r["words"]))
    by_host = {}
    for r in rows:
        by_host.setdefault(r["host"], []).append(r)
    for host, pages in by_host.items():
        vectors = {}
        for i, r in enumerate(pages):
            for e in r["elements"]:
                vectors.setdefault((e["path"], e["token"], False), {})[i] = e["times"]
            for b in r["blocks"]:
                at = vectors.setdefault((b["path"], b["token"], True), {})
                at[i] = at.get(i, 0) + 1
        n = sum(bool(r["elements"]) for r in pages)
        same = {}
        for token, v in vectors.items():
            if len(v) >= 0.1 * n and (not token[2] or len(v) >= 3):
                same.setdefault(tuple(sorted(v.items())), set()).add(token)
        assert sorted(map(sorted, same.values())) == sorted(map(sorted, got[host].values()))
        # the template's paths, plainly: once on each of their pages, and in company or nearly everywhere
        want = {t[0] for v, own in same.items() for t in own if not t[2] and {k for _, k in v} == {1} and (len(own) > 1 or len(v) >= 0.9 * n)}
        assert want == set(made[host]["paths"])
        # what a slot holds, plainly: characters below it outside of what is left out, over the pages that have it
        for slot, size in zip(made[host]["slots"], made[host]["sizes"], strict=True):
            below = lambda p, top: p == top or p.startswith(top + "/")
            common = {t[0] for own in same.values() for t in own if not t[2]}
            chars = sum(len(b["text"]) for r in pages for b in r["blocks"] if below(b["path"], slot) and b["path"] in common and b["token"] not in made[host]["texts"]
                        and not any(below(b["path"], x) for x in made[host]["left"]))
            assert size == pytest.approx(chars / sum(slot in {e["path"] for e in r["elements"]} for r in pages))


def test_the_template_decides_the_pages_of_the_table(spark):
    _, rows, made = parsed_rows(spark, "/root/testdata/sf0.01")
    changed = {"template": 0, "slots": 0, "names": 0}
    for r in rows:
        blocks = [(b["path"], b["token"], b["text"]) for b in r["blocks"]]
        once = {e["path"] for e in r["elements"] if e["times"] == 1}
        t = made[r["host"]]
        text = html_template.main_text(blocks, once, t["texts"], t["slots"], t["sizes"], t["left"])
        changed["template"] += text != html_template.main_text(blocks, once, [], [], [], [])
        changed["slots"] += text != html_template.main_text(blocks, once, t["texts"], [], [], [])
        changed["names"] += text != html_template.main_text(blocks, once, t["texts"], t["slots"], t["sizes"], [])
    # without the template the adverts stay; without its names, but with its slots, only where a host's are larger than half of its articles
    assert changed["template"] > 100 and changed["slots"] > 100 and changed["names"] < changed["template"] / 2


def test_the_largest_slot_wins_whatever_its_tag(spark):
    def made(i):
        return page(f"<article><p>Teaser {i}</p></article><div class=story><p>Story {i} is told here at great length, far longer than teasers are</p></div>")

    assert extract(spark, [(i, f"http://i.example/{i}", made(i)) for i in range(5)]) == {
        i: f"Story {i} is told here at great length, far longer than teasers are" for i in range(5)}


def test_only_listed_furniture_is_left_out(spark):
    body = "<article><p>A <math><mi>x</mi></math> b</p><svg><text>c</text></svg><div hidden>d</div><p>e <object>f</object></p></article>"
    assert extract(spark, [(1, "http://j.example/1", page(body))]) == {1: "A x b\n\nc\n\nd\n\ne f"}


def test_no_pages_odd_columns_and_large_hosts(spark, monkeypatch):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_template.extract(empty).collect() == [] and html_template.extract(empty).columns == ["page_id", "url", "text", "n_chars"]
    rows = [(i, f"http://{'k' if i % 3 else 'l'}.example/{i}", page(f"<div class=ad>Buy {i}</div><article>Story {i} is told here</article>")) for i in range(60)]
    rows += [(None, None, None), (1, rows[1][1], rows[1][2])]
    want = sorted((r[0] is None, r[0], f"Story {r[0]} is told here" if r[2] else "") for r in rows)
    monkeypatch.setattr(html_template, "BROADCAST", -1)
    monkeypatch.setattr(html_template, "PART", 7)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "page_id long, url string, html string, text int, host int, pages int")
    assert sorted((r["page_id"] is None, r["page_id"], r["text"]) for r in html_template.extract(df).collect()) == want
