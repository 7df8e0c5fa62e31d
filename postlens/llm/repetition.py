"""Quality rules by suffix-array repetition.

The words of a batch of texts form one sequence whose suffixes end with their
text.  The suffix array is made by prefix doubling: ranks of 1, 2, 4, ...
words, sorting anew only positions that still share a rank.  Ranks of all
lengths are kept and give the longest common prefix of neighbours in the
array.  The deepest common-prefix interval around a suffix is the longest
repeat that starts there; a repeat is maximal if the one starting a word
earlier doesn't run over it.  Spans of maximal repeats are joined, for repeats
of at least 5 words, of at least 6 and so on to 10; a text fails if spans of any
such length cover too many of its characters - the longer the repeats, the fewer
may be covered - or if one repeat is too long.  So a line said twice fails a
short text and not a long one, and a passage of more than 50 words said twice
fails any text, though few of its words may be repeated.

A map over Arrow batches: no shuffle; memory is bounded by one batch, which is
worked on in pieces of about ``PIECE`` words (a single longer text is one piece).
Doubling ends when no two suffixes share a rank, so the ranks that are held are 8
bytes a word times the logarithm of the longest repeat: 5 arrays for repeats of
up to 31 words, 20 for a text that is one passage of a million words said twice.

Defined cases: null, empty and blank texts have no words and fail the base
rule; very long texts are taken whole; repeated rows give repeated results; an
empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import per_text, struct, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: The method's limits: share of a text's characters that repeats of at least so many words may cover (0.15 for 5 words,
#: 0.01 less for each word more, as in published rules for duplicate n-grams), and words of the longest repeat.
MOST_COVERED, LONGEST = tuple((n, (20 - n) / 100) for n in range(5, 11)), 50
PIECE = 200_000

FIELDS = struct(n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long",
                n_repeats="long", longest_repeat="long", covered="double", covered_over="double")


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of a sequence of small non-negative ids, the length of the longest run of ids
    that starts there and starts elsewhere too, in the same text; ``ends`` is
    the end of each position's text."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    first = np.r_[True, ends[1:] != ends[:-1]]
    text = np.cumsum(first) - 1
    key = text * (ids.max() + 1) + ids
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0))
    levels, step = [rank], 1
    shared = np.zeros(n, bool)
    same = key[1:] == key[:-1]
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    at = np.flatnonzero(shared)
    while len(at):
        # a rank is the place of its first suffix in the array: a group is sorted within its own places
        later = at + step
        inside = later < ends[at]
        second = np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second)
        at, second = at[by], second[by]
        base = rank[at]
        new_group = np.r_[True, base[1:] != base[:-1]]
        start = np.maximum.accumulate(np.where(new_group, np.arange(len(at)), 0))
        new = new_group | np.r_[True, second[1:] != second[:-1]]
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        fresh = base + place - start
        order[base + np.arange(len(at)) - start] = at
        rank = rank.copy()
        rank[at] = fresh
        levels.append(rank)
        step *= 2
        size = np.diff(np.r_[np.flatnonzero(new), len(at)])
        at = at[np.repeat(size > 1, size)]
    # a suffix that is alone at a level keeps its rank, so equal ranks at level k are equal runs of 2**k words
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        ok = (a + (1 << k) <= ends[i]) & (b + (1 << k) <= ends[j]) & (text[i] == text[j])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        common[ok] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[i] = common
    longest[j] = np.maximum(longest[j], common)
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """The words in repeats of at least ``least`` words."""
    edge = np.zeros(len(longest) + 1, np.int64)
    p = np.flatnonzero(longest >= least)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + longest[p], -1)
    return np.cumsum(edge[:-1]) > 0


def _piece(texts: list[list[bytes]], most_covered: tuple) -> list[tuple[int, int, int, float, float]]:
    """Repeated words, maximal repeats, longest repeat, covered share of characters for each text's words, and by how
    much that is over the limit of any length of repeats."""
    counts = [len(t) for t in texts]
    flat = [w for t in texts for w in t]
    n = len(flat)
    if not n:
        return [(0, 0, 0, 0.0, -1.0)] * len(texts)
    ids = pd.factorize(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, n))[0]
    stops = np.cumsum(counts)
    ends = np.repeat(stops, counts)
    longest = longest_repeats(ids, ends)
    hit = longest >= WINDOW
    before = np.r_[0, longest[:-1]] - 1  # what the repeat one word earlier leaves here
    before[np.r_[0, stops[:-1]][np.array(counts) > 0]] = -1
    maximal = hit & ((longest > before) | (before < WINDOW - 1))
    covered = _covered(longest, WINDOW)
    by_length = [(_covered(longest, least), most) for least, most in most_covered]
    novel = np.flatnonzero(np.r_[True, ids[1:] > np.maximum.accumulate(ids)[:-1]])  # ids number words as they first occur
    chars = np.array([len(flat[i].decode("utf-8", "surrogatepass")) for i in novel.tolist()], np.int64)[ids]
    out, lo = [], 0
    for hi in stops.tolist():
        c = covered[lo:hi]
        top = longest[lo:hi][hit[lo:hi]]
        total = max(1, chars[lo:hi].sum())
        over = max((float(chars[lo:hi][of[lo:hi]].sum() / total) - most for of, most in by_length), default=-1.0)
        out.append((int(c.sum()), int(maximal[lo:hi].sum()), int(top.max(initial=0)), float(chars[lo:hi][c].sum() / total), over))
        lo = hi
    return out


def _measure(texts: list[str | None], most_covered: tuple = MOST_COVERED) -> dict:
    out: dict = {f: [] for f in FIELDS.fieldNames()}
    held: list[list[bytes]] = []
    total = 0

    def flush() -> None:
        nonlocal held, total
        for values in _piece(held, most_covered):
            for f, v in zip(("n_repeat_words", "n_repeats", "longest_repeat", "covered", "covered_over"), values, strict=True):
                out[f].append(v)
        held, total = [], 0

    for text in texts:
        own = words(text)
        seen: set[str] = set()
        again = 0
        for line in (text or "").split("\n"):
            if line in seen:
                again += 1
            elif words(line):
                seen.add(line)
        out["n_words"].append(len(own))
        out["word_chars"].append(len(b"".join(own).decode("utf-8", "surrogatepass")))
        out["n_symbols"].append(len(SYMBOLS.findall(text or "")))
        out["n_dup_lines"].append(again)
        held.append(own)
        total += len(own)
        if total >= PIECE:
            flush()
    flush()
    return out


def measured(text: Column | str, most_covered: tuple = MOST_COVERED) -> Column:
    """A struct of ``FIELDS`` for a text column."""
    return per_text(lambda: lambda texts: _measure(texts, most_covered), FIELDS, text)


def rules(docs: DataFrame, most_covered: tuple = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """The measures and verdicts of each document: ``base_failed`` (few words or many repeated ones) and ``kept``: neither
    that, nor repeats that cover more of its characters than ``most_covered`` says (pairs of least words and share), nor
    one beyond ``longest`` words."""
    rows = docs.select("doc_id", measured(F.col("text"), most_covered).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    fine = (F.col("covered_over") <= 0) & (F.col("longest_repeat") <= longest)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & fine).alias("kept"), "n_repeats", "longest_repeat", "covered")
