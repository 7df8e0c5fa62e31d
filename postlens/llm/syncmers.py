"""Document fingerprints by closed syncmers.

A k-mer of ``K`` code points is chosen if the smallest of its inner substrings
of ``S`` code points, by hash, stands at its start or its end.  The choice
depends on the k-mer alone, so equal passages give equal anchors wherever they
stand.  A fingerprint is the hashes of the chosen k-mers in text order, eight
hex digits each; a text without one has the hash of the whole text, an empty
text the empty fingerprint.

Two fingerprints are matched by position: the j-th occurrence of a hash in one
stands against the j-th in the other, and of these pairs the longest chain
that rises in both is kept.  Likeness is twice the chain's length over the
number of all anchors; it is 1 for equal fingerprints.

To edit a text with the next document's beginning, documents are dealt by
ranges of ids, and the first document of a range goes to the range before it
too.  An id, or the lack of one, that holds several ranges' share of the rows is
dealt by ranges of its texts' hashes.  Ranges are cut by the bytes of all texts.
Texts are shuffled once; a task streams over its sorted rows.

Defined cases: a null text counts as empty; two empty fingerprints have
likeness 1, one empty has 0; rows that share an id stand in the order of their
texts' hashes and follow each other; a null id stands last; the only row of a
table is its own next one; an empty table gives no row; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 24, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges for each partition, so that partitions come out even; bytes of text in a range, or more if these would be more than MOST.
RANGES, RANGE_BYTES, MOST = 4, 2 << 20, 80_000

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def anchors(text: str) -> np.ndarray:
    """The hashes of a text's anchors in text order, as unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(points) >= K:
        # hashes of runs by doubling: a run of 2n is one of n times BASE**n plus the next n
        run, width, of = points, 1, {}
        while 2 * width <= K:
            run = run[:-width] * _power(width) + run[width:]
            width *= 2
            of[width] = run
        inner = _mixed(of[S])
        n = len(points) - K + 1
        span = K - S + 1  # inner substrings of a k-mer
        low, width = inner, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width: span - width + n])
        at = np.flatnonzero((low == inner[:n]) | (low == inner[K - S: K - S + n]))
        if len(at):
            whole = of[16][at] * _power(8) + of[8][at + 16]
            return (_mixed(whole) >> np.uint64(32)).astype(np.uint32)
    return np.frombuffer(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:4], np.uint32)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """Hash and number of occurrence of each anchor as one integer."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    i = np.arange(len(h))
    start = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], i, 0)) if len(h) else i
    out = np.empty(len(h), np.uint64)
    out[order] = s.astype(np.uint64) << np.uint64(32) | (i - start).astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice likeness of two anchor sequences by their longest common chain.  What both begin with is in a longest
    chain, and is not searched."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return float(not total)
    short = min(len(a), len(b))
    differ = a[:short] != b[:short]
    chain = int(differ.argmax()) if differ.any() else short
    a, b = a[chain:], b[chain:]
    if len(a) and len(b) and not set(a.tolist()).isdisjoint(b.tolist()):
        _, ia, ib = np.intersect1d(_occurrences(a), _occurrences(b), assume_unique=True, return_indices=True)
        tails: list[int] = []
        for x in ib[np.argsort(ia)].tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        chain += len(tails)
    return 2.0 * chain / total


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the beginning of ``after``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """Ids and texts with the range they are dealt to, and the number of partitions for the ranges.  Ranges and ids are in
    descending order, null ids last; the first row of a range also goes, as a guest, to the range before it, and that of
    the first range to the last one.  The driver holds an id and a hash for each range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    n = min(MOST, max(RANGES * spark.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    # an id that is several cuts has a range for the ids above it, and as many of its own
    values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    own = np.r_[0, np.where(times > 1, times, 0)]
    base = np.cumsum(1 + own[::-1])[::-1] - 1 - own  # of the ids from a cut on, by the number of cuts that are not above them
    nulls = max(1, -(-n * (size["n"] - size["ids"]) // max(1, size["n"])))

    @F.pandas_udf("int")
    def place(ids: pd.Series, lacks: pd.Series, ties: pd.Series) -> pd.Series:
        ids, lacks = ids.to_numpy(np.int64), lacks.to_numpy(bool)
        part = ties.to_numpy(np.int64) / 2.0**64 + 0.5
        cut = np.searchsorted(values, ids, side="right")
        heavy = (own[cut] > 0) & (ids == (values[cut - 1] if len(values) else ids))
        at = base[cut] + np.where(heavy, 1 + np.minimum((part * own[cut]).astype(int), own[cut] - 1), 0)
        last = int(base[0] + 1 + own[0])
        return pd.Series(np.where(lacks, last + np.minimum((part * nulls).astype(int), nulls - 1), at).astype("int32"))

    # a long column with nulls would become floating-point in Python
    rows = rows.withColumn("range", place(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("tie")))
    # the first row of each range: the largest id, then the least hash
    down = F.bitwise_not("doc_id")
    tops = rows.groupBy("range").agg(F.min(F.struct(down.alias("down"), "tie")).alias("top")).orderBy("range").collect()
    before = [tops[i - 1]["range"] for i in range(len(tops))]
    tops = spark.createDataFrame([(r["range"], r["top"]["down"], r["top"]["tie"], b) for r, b in zip(tops, before, strict=True)],
                                 "_range int, _down long, _tie long, host int")
    first = rows.join(F.broadcast(tops), (F.col("range") == F.col("_range")) & down.eqNullSafe(F.col("_down")) & (F.col("tie") == F.col("_tie")))
    guests = first.groupBy("host").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    rows = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumnRenamed("host", "range").withColumn("guest", F.lit(1)))
    return rows, -(-n // RANGES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness to each other and to the next document's."""
    dealt, partitions = _ranged(docs)
    dealt = dealt.repartition(partitions, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.drop("tie").mapInArrow(_stream, SCHEMA)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the row that waits for its next one
    out: list[tuple] = []
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
                        for n, t in (c.split() for c in SCHEMA.split(", "))])
    with np.errstate(over="ignore"):
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("doc_id", "text", "range", "guest")]
            for doc_id, text, place, guest in zip(*cols, strict=True):
                if held is not None and held[2] == place and not held[3]:
                    own = anchors(text)
                    out.append(_row(held, text, own))
                    held = (doc_id, text, place, guest, own)
                elif held is None or held[2] != place:
                    held = (doc_id, text, place, guest, None if guest else anchors(text))
                if guest:
                    held = (None, "", place, 1, None)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)


def _row(held: tuple, after: str, theirs: np.ndarray) -> tuple:
    doc_id, text, _, _, own = held
    new = edited(text, after)
    changed = anchors(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(),
            changed.astype(">u4").tobytes().hex(), likeness(own, changed), likeness(own, theirs))
