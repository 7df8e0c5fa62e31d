"""Periodic runs of words, by suffix trees of a text and of its reversal.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are the same) that no neighbouring word extends, of at least ``least``
words and at least ``turns`` periods.

Every run holds a Lyndon root: the longest Lyndon word at one of its positions
for one of the two orders of the words, a word order and its opposite.  That
word ends where the next smaller suffix begins.  So there are two candidates a
position; each is extended to the right by the longest common extension (LCE)
of the suffixes at its two ends, and to the left by that of the reversed
prefixes.  An LCE is the depth of the lowest common ancestor of two leaves of a
suffix tree.  The trees are built by Ukkonen's algorithm; an Euler tour of each
notes the order of its leaves and the least depth it passes between
neighbouring leaves, and the minimum over the way between two leaves, from a
table of powers of two, answers every LCE in constant time.

Only words that can stand in a run enter the trees.  A run repeats at least
``gram`` words at the distance of its period (16 for 24 words and 3 periods),
so all of its words lie in repeated word ``gram``-s; stretches of such words
are joined by separators that occur once.  (Hashes of equal ``gram``-s are
equal; a clash only lets in more words.)

Memory is linear in the words of one text: some 300 bytes a word in a tree, and
one tree is held at a time.

Defined cases: a null or blank text has no words and no runs; a null id is
passed on; repeated rows are worked on row by row; the whole of a very long text is
read; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import SLICE, words

LEAST_WORDS = 24
LEAST_TURNS = 3


def suffix_tree(symbols: list[int], top: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``symbols``, the last of which occurs once and is ``top``: for each node where its edge starts
    and ends in ``symbols``, and the child by ``node * (top + 1) + first symbol``.  Node 0 is the root; leaves end at
    the end."""
    n, k = len(symbols), top + 1
    start, end, link, child_of = [0], [0], [0], {}
    node = edge = length = due = 0
    for i, c in enumerate(symbols):
        due += 1
        last = 0
        while due:
            if not length:
                edge = i
            key = node * k + symbols[edge]
            child = child_of.get(key)
            if child is None:
                child_of[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                span = end[child] - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if symbols[at + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                child_of[key] = split
                child_of[split * k + c] = split + 1
                start[child] = at + length
                child_of[split * k + symbols[at + length]] = child
                if last:
                    link[last] = split
                last = split
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return start, end, child_of


class Tour:
    """The Euler tour of the suffix tree of ``symbols``, with children in the order of their symbols, the end first:
    ``rank`` of each suffix among the leaves, and ``low``, the least depth between neighbouring leaves."""

    def __init__(self, symbols: list[int], both: bool = False):
        n, top = len(symbols), max(symbols) + 1
        start, end, child_of = suffix_tree([*symbols, top], top)
        m = len(start)
        keys = np.fromiter(child_of.keys(), np.int64, m - 1)
        child = np.fromiter(child_of.values(), np.int64, m - 1)
        del child_of
        node, symbol = np.divmod(keys, top + 1)
        spans = (np.array(end, np.int64) - np.array(start, np.int64)).tolist()
        self.rank, self.low = self._walk(n, node, (symbol + 1) % (top + 1), child, spans)
        #: the order of the leaves if the words' order is turned round
        self.opposite = self._walk(n, node, np.where(symbol == top, -1, top - symbol), child, spans)[0] if both else None

    @staticmethod
    def _walk(n: int, node: np.ndarray, order: np.ndarray, child: np.ndarray, spans: list[int]) -> tuple[np.ndarray, np.ndarray]:
        # the stack takes children from the last to the first
        by = np.lexsort((-order, node))
        kids = child[by].tolist()
        first = np.searchsorted(node[by], np.arange(len(spans) + 1)).tolist()
        ranks, low = [], []
        stack, depths, new = [0], [0], False
        while stack:
            v, above = stack.pop(), depths.pop()
            if new:  # the first step down after a leaf leaves from the lowest common ancestor
                low.append(above)
                new = False
            depth = above + spans[v]
            a, b = first[v], first[v + 1]
            if a == b:
                ranks.append(n + 1 - depth)
                new = True
            elif b - a == 2:
                stack += kids[a:b]
                depths += (depth, depth)
            else:
                stack += kids[a:b]
                depths += [depth] * (b - a)
        rank = np.empty(n + 1, np.int64)
        rank[ranks] = np.arange(n + 1)
        return rank, np.array(low, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes a and b, which differ; the empty suffix has none."""
        l, r = self.rank[a], self.rank[b]
        l, r = np.minimum(l, r), np.maximum(l, r)
        power = np.frexp((r - l).astype(float))[1] - 1
        out, row = np.zeros(len(l), np.int64), self.low
        for k in range(int(power.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                row = np.minimum(row[:-half], row[half:])
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(row[l[at]], row[r[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller; the empty suffix is smaller than all."""
    of = rank.tolist()
    out, open_ = [0] * (len(of) - 1), []
    for j, r in enumerate(of):
        while open_ and of[open_[-1]] > r:
            out[open_.pop()] = j
        open_.append(j)
    return np.array(out, np.int64)


def extended(symbols: list[int], least: int, turns: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``symbols``, sorted by start, then period."""
    n = len(symbols)
    if not n:
        return []
    forward = Tour(symbols, both=True)
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(forward.rank), next_smaller(forward.opposite)])
    right = forward.common(i, j)
    del forward
    # only roots that go on to the right for long enough, or may have begun further left
    left = Tour(symbols[::-1]).common(n - i, n - j)
    start, length, period = i - left, j + right - i + left, j - i
    good = (length >= least) & (length >= turns * period)
    found = np.unique(np.stack([start[good], period[good], length[good]]), axis=1)
    return [(s, n_, q) for s, q, n_ in found.T.tolist()]


def repeated(ids: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a word ``gram`` that occurs more than once."""
    inside = np.zeros(len(ids), bool)
    if len(ids) <= gram:
        return inside
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        # the hash of 2**b words from those of halves; the rest of gram from the binary digits
        done, out, part, size = 0, None, mixed, 1
        while True:
            if gram & size:
                out = part if out is None else out[:len(part) - done] * np.uint64(0x94D049BB133111EB) + part[done:]
                done += size
            if 2 * size > gram:
                break
            part = part[:-size] * np.uint64(0xD6E8FEB86659FD93) + part[size:]
            size *= 2
        out = out[:len(ids) - gram + 1]
    order = np.argsort(out, kind="stable")
    same = out[order[1:]] == out[order[:-1]]
    again = np.zeros(len(out), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    step[at] += 1
    step[at + gram] -= 1
    return np.cumsum(step[:-1]) > 0


def runs(own: list, least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a list of words, sorted by start, then period.  ``turns`` is at least 2."""
    if len(own) < least:
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
    # a run of period q repeats length - q words: at least least - q, and at least (turns - 1) * q
    gram = min(least - least // turns, (turns - 1) * (least // turns + 1))
    inside = repeated(ids, gram)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    pieces = [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]
    if not pieces:
        return []
    symbols, back, other = [], [], len(number)
    for a, b in pieces:
        symbols += ids[a:b].tolist()
        symbols.append(other)
        back.append(np.arange(a, b + 1))
        other += 1
    # words numbered anew, in the order of their numbers
    at = np.concatenate(back)
    symbols = np.unique(np.array(symbols), return_inverse=True)[1].tolist()
    return [(int(at[s]), n, q) for s, n, q in extended(symbols, least, turns)]


def collapse(own: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return own
    step = np.zeros(len(own) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    gone = np.cumsum(step) > 0
    return [w for w, out in zip(own, gone.tolist()) if not out]


def looped(doc_id: int | None, own: list) -> list:
    """The words with a planted loop, for one id in ten by its CRC-32: from some word on they repeat their first ones."""
    if doc_id is None or not own:
        return own
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return own
    a = g % len(own)
    p = 1 + (len(own) - a) // (3 + g % 8)
    return own[:a] + [own[a + i % p] for i in range(len(own) - a)]


def find(docs: DataFrame, edit: Callable[[int | None, list], list] | None = None,
         least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> DataFrame:
    """For each document ``doc_id, runs`` (start, length and period in words, sorted by start, then period) and
    ``collapsed``, the words that stay when each run keeps its first period.  ``edit`` may change the words first."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "start array<long>, length array<long>, period array<long>, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids, out = part.column(0), ([], [], [], [])
                for doc_id, text in zip(ids.to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = words(text)
                    own = edit(doc_id, own) if edit else own
                    found = runs(own, least, turns)
                    for i in range(3):
                        out[i].append([run[i] for run in found])
                    out[3].append(b" ".join(collapse(own, found)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, pa.list_(pa.int64())) for x in out[:3]), pa.array(out[3], pa.string())],
                    ["doc_id", "start", "length", "period", "collapsed"])

    return rows.mapInArrow(work, f"doc_id {kind}, {fields}").select(
        "doc_id", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")


def steepest(of: Column) -> Column:
    """The run with the greatest exact length over period, ties by least start, then period; null without runs."""

    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.try_element_at(F.array_sort(of, before), F.lit(1))


def digest(found: DataFrame) -> DataFrame:
    """The results of ``find`` as counts, the steepest run and digests."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    best = found.withColumn("best", steepest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
