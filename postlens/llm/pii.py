"""Personal data by rules and a skip-chain conditional random field.

Base spans are what four fixed patterns match and a check of their digits
accepts.  The field then labels tokens that the patterns may miss.  Its nodes
are the tokens that hold a digit or an at sign (no other token can be of a
kind); chain edges link nodes that stand next to each other, skip edges link
nodes of a document that are equal or alike (same digits, or the same name
before an at sign), however far apart.  Alike nodes link to one hub for each
distinct form, inside a base span if there is one, so edges grow with the
tokens, not with their pairs, and no copy is farther than another.  Loopy belief
propagation over these edges, run until messages settle, makes labels agree
across the document.  Nodes inside a base span are clamped to its kind; a run of other
nodes that get a kind with a probability of at least ``SURE`` is a span.

Weights are learned from the base spans of all documents: a softmax regression
on token shapes by maximum likelihood, and edge potentials from the smoothed log
odds of the labels at both ends of such edges.  Tasks count shapes and ends, and
Spark adds the counts up; the driver gets one row for each shape and label (a
shape is a string of 23 bits, most of which exclude each other).

Learning and detection are maps over Arrow batches; memory is bounded by one
batch and the nodes of one document.  All scans take time in proportion to the
text, whatever it holds: runs of letters or digits are passed once, not from
each of their places.

Defined cases: a null text counts as empty and has no span; long texts are
scanned whole; repeated rows give repeated results; null ids stay; an empty
table gives no row; without any token that holds a digit or an at sign there is
nothing to learn or find; extra columns stay in ``redacted`` and are not read
elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import per_text, struct, tidy

KINDS = ("email", "ip", "card", "phone")
# an address is what LOCAL characters stand before an at sign that DOMAIN follows
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Nodes: runs of these characters from a digit or an at sign on, and what stands before it without a closing bracket.
AROUND, BEFORE = re.compile(r"[A-Za-z0-9._%+@()-]++").match, LOCAL + "("
MARK = re.compile(r"[0-9@]").search
DIGIT = re.compile(r"[0-9]").search
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Probability for a span.
SURE = 0.95
#: Propagation ends when no message changes by more than this; loops that never settle end after so many rounds.
SETTLED, ROUNDS = 1e-7, 2000
#: Counts by which alike tokens are taken to share a label before any is seen.
AGREE = 20.0

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def _luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The addresses of a text.  What may stand before an at sign never holds one, so each is looked at once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        end = DOMAIN(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
        last = end.end() if end else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns match and the checks accept, by kind and start."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in emails(text)]
    if DIGIT(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def features(token: str) -> np.ndarray:
    """The shape of a token as 0 and 1."""
    digits = len(NOT_DIGITS.sub("", token))
    letters = sum(c.isalpha() for c in token)
    at, dot = token.find("@"), token.count(".")
    groups = token.split(".")
    return np.array([
        1, at > 0, at > 0 and "." in token[at:], at >= 0 and token.endswith("@"), at == 0, dot == 3, dot == 3 and not letters and at < 0,
        dot > 3, 1 <= dot < 3 and not letters, all(g.isdigit() and len(g) <= 3 for g in groups) and dot > 0, digits >= 16 and not letters,
        digits > 19, 8 <= digits < 16 and not letters, digits < 8 and not letters, token.startswith("+"), token.startswith("("), "-" in token,
        16 <= digits <= 19 and not letters and not _luhn(NOT_DIGITS.sub("", token)), letters > 0 and digits > 0, letters > digits, token[-1:].isdigit(), "_" in token or "%" in token, dot == 0 and at < 0,
    ], float)


BITS = 1 << np.arange(len(features("0")))


def _nodes(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int]]:
    """Start, end, token and label (0: none) of each node."""
    sure = sorted((a, b, KINDS.index(k) + 1) for k, a, b in spans)
    out, at, last = [], 0, 0
    while mark := MARK(text, last):
        a = last + len(text[last:mark.start()].rstrip(BEFORE))
        last = AROUND(text, mark.start()).end()
        whole = text[a:last]
        token = whole.rstrip(".-%_()").lstrip("._%-")
        if not token:
            continue
        a += whole.find(token)
        b = a + len(token)
        while at < len(sure) and sure[at][1] <= a:
            at += 1
        label = sure[at][2] if at < len(sure) and sure[at][0] < b else 0
        out.append((a, b, token, label))
    return out


def likes(token: str) -> list[tuple[str, str]]:
    """The keys by which a token is linked to others: those that share one are alike."""
    digits = NOT_DIGITS.sub("", token)
    out = [("=", token)]
    if "@" in token:
        out += [("name", token.partition("@")[0].lower()), ("place", token.partition("@")[2].lower())]
    elif len(digits) >= 7:
        out.append(("digits", digits))
    return [k for k in out if len(k[1]) > 1]


def alike(nodes: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """The skip edges: each node with the hub of each of its keys, which is the first node with that key inside a base
    span, else the first."""
    keys = [likes(token) for *_, token, _ in nodes]
    hubs: dict = {}
    for inside in (True, False):
        for i, own in enumerate(keys):
            if not inside or nodes[i][3]:
                for key in own:
                    hubs.setdefault(key, i)
    return [(hubs[key], i) for i, own in enumerate(keys) for key in own if hubs[key] != i]


def counts(texts: Iterator[str]) -> Counter:
    """How often a shape has a label, and how often labels stand at the ends of chain and skip edges:
    ``(what, shape or first label, label)``."""
    out: Counter = Counter()
    for text in texts:
        if not MARK(text):
            continue
        nodes = _nodes(text, base_spans(text))
        for i, (a, _, token, label) in enumerate(nodes):
            out["shape", int(features(token) @ BITS), label] += 1
            if i and a - nodes[i - 1][1] <= 2:
                out["chain", nodes[i - 1][3], label] += 1
        for i, j in alike(nodes):
            out["skip", nodes[i][3], nodes[j][3]] += 1
            out["skip", nodes[j][3], nodes[i][3]] += 1
    return out


def learn(counted: dict[tuple[str, int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape weights (features x labels) and chain and skip potentials (labels x labels)."""
    n = len(KINDS) + 1
    ends = {"chain": np.ones((n, n)), "skip": np.ones((n, n)) + AGREE * np.eye(n)}
    shapes = []
    for (what, a, b), times in sorted(counted.items()):
        if what == "shape":
            shapes.append((a, b, times))
        else:
            ends[what][a, b] += times
    shape, label, times = np.array(shapes).T
    xs, ys, share = (shape[:, None] // BITS % 2).astype(float), np.eye(n)[label], times / times.sum()
    weights = np.zeros((len(BITS), n))
    for _ in range(300):  # gradient ascent with a small ridge
        z = xs @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights += 2.0 * (xs.T @ ((ys - p) * share[:, None]) - 1e-4 * weights)
    # what edges add beyond the labels' own frequency, at most a factor of e**3 either way (e for neighbours)
    odds = lambda c: np.clip(np.log(c / c.sum() / np.outer(c.sum(1) / c.sum(), c.sum(0) / c.sum())), -3, 3)
    return weights, np.clip(odds(ends["chain"]), -1, 1), odds(ends["skip"])


def marginals(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node by loopy belief propagation with damping.  An edge has its ends and the log
    potentials of the first end's labels by the second's."""
    n = unary.shape[1]
    if not edges:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.concatenate([np.array([e[2] for e in edges]), np.array([e[2].T for e in edges])])
    m = len(edges)
    back = np.r_[m:2 * m, 0:m]
    messages = np.zeros((2 * m, n))
    settled = False
    for step in range(rounds + 1):
        belief = unary + np.stack([np.bincount(dst, messages[:, k], len(unary)) for k in range(n)], axis=1)
        if settled or step == rounds:
            break
        send = belief[src] - messages[back]
        joint = send[:, :, None] + pot
        top = joint.max(1, keepdims=True)
        new = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        new = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        settled = np.abs(new - messages).max() < SETTLED
        messages = new
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[str, int, int]]:
    """The spans that the field adds to the base spans."""
    weights, chain, skip = model
    nodes = _nodes(text, base)
    if all(label for *_, label in nodes):
        return []
    unary = np.array([features(token) for _, _, token, _ in nodes]) @ weights
    for i, (*_, label) in enumerate(nodes):
        if label:
            unary[i] = -30.0
            unary[i, label] = 0.0
    edges = [(i - 1, i, chain) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= 2]
    edges += [(i, j, skip) for i, j in alike(nodes)]
    p = marginals(unary, edges)
    best, sure = p.argmax(1), p.max(1)
    # base spans of different kinds overlap; joined, their starts and ends are both in order
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    first = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        at = bisect_left(first, b)
        return not at or taken[at - 1][1] <= a

    out: list[tuple[str, int, int]] = []
    for (a, b, _, label), k, s in zip(nodes, best.tolist(), sure.tolist(), strict=True):
        if label or not k or s < SURE or not free(a, b):
            continue
        kind = KINDS[k - 1]
        if out and out[-1][0] == kind and a - out[-1][2] <= 2 and free(out[-1][1], b):
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def _all_spans(text: str, model) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    if model is not None and ("@" in text or DIGIT(text)):
        spans += [(*s, False) for s in added_spans(text, base, model)]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fitted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The field's weights from all documents; None if no token holds a digit or an at sign."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            out += counts(x.as_py() for x in batch.column(0))
        rows = [(*key, n) for key, n in out.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "a", "b", "n"])

    able = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    rows = able.mapInArrow(work, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return learn({(r["what"], r["a"], r["b"]): r["n"] for r in rows}) if rows else None


def spans_of(text: Column | str, model) -> Column:
    """All spans of a text column, by kind and start."""
    return per_text(lambda: lambda texts: {"spans": [[dict(zip(("kind", "start", "end", "base"), s)) for s in _all_spans(t or "", model)] for t in texts]},
                    struct(spans=SPANS), text)["spans"]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``spans`` of each document."""
    return docs.select("doc_id", spans_of(F.col("text"), fitted(docs)).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by ``[kind]``; ``n_chars``, where there is one, counts
    the new text.  A null text stays null."""
    model = fitted(docs)
    new = per_text(lambda: lambda texts: {"text": [None if t is None else redact(t, _all_spans(t, model)) for t in texts]},
                   struct(text="string"), F.col("text"))["text"]
    out = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                        shown(F.col("spans")).alias("spans"))
