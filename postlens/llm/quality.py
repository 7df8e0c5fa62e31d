"""Quality classification by compression.

Zstandard dictionaries are built from good and from bad labelled texts, two
pairs from separate parts of the sample.  A text is cut into pieces of
``PIECE`` bytes; each piece is compressed with either dictionary of a pair,
and the difference of the two sizes is divided by the piece's length.  The
mean over pieces, weighted by length, and over pairs is the text's measure:
positive if the good dictionary serves it better.  Differences of a piece are
held within ``CLIP``, so that a piece that a dictionary happens to contain
doesn't decide alone.  A logistic curve, fitted to labelled texts that are in
no dictionary, turns the measure into the probability of label 1.

The fit reads a bounded sample of the labelled rows on the driver: of each class
the ``SAMPLE`` texts that a hash of id and text puts first, equal rows once, as
far as these are within ``FIT_BYTES``; a text that goes beyond that is passed
over.  Scoring is a map over Arrow batches of whole texts, without a shuffle.

Defined cases: null and empty texts count as one empty piece, whose measure is
0; a label that is neither 0 nor 1, or null, is not learned from, and an id
with several labels counts by its rows; without rows of both classes every
score is the share of label 1 among those there are, or 0.5; repeated rows
give repeated results; an empty table gives no row; extra columns stay in
``kept`` and are not read elsewhere.
"""

from __future__ import annotations

import random

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import crc_held_out, fresh, per_text, struct

SAMPLE, PAIRS, PIECE, CLIP, THRESHOLD = 3000, 2, 1024, 0.12, 0.7
DICTIONARY, LEVEL = 112_640, 3
#: Bytes of the texts of a class that are learned from.
FIT_BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """``text, quality, own`` of at most ``sample`` rows of each class, and at most ``fit_bytes`` of them, without held-out
    ids; ``own`` is the hash of id and text."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~crc_held_out())
    known = known.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    bound = F.lit(0)
    for label, n in counts.items():
        bound = F.when(F.col("quality") == label, F.lit(int(min(1.0, 1.2 * sample / n) * (1 << 20)) + 1)).otherwise(bound)
    # hashes pass about 1.2 * sample ids of each class; null ids join nothing
    chosen = known.where((F.col("u") < bound) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "quality").distinct()
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")) \
        .select(F.xxhash64("doc_id", "text").alias("own"), "quality", "text")
    # an id may stand on any number of rows: their hashes and sizes are looked at before any text is brought together
    first: list[tuple[int, int]] = []
    for label in counts:
        sizes = rows.where(F.col("quality") == label).select("own", F.octet_length("text").alias("size")).distinct().orderBy("own", "size").limit(sample)
        total = 0
        for r in sizes.collect():
            if total + r["size"] <= fit_bytes:
                total += r["size"]
                first.append((r["own"], label))
    taken = docs.sparkSession.createDataFrame(first, "_own long, _label int")
    return rows.join(F.broadcast(taken), (F.col("own") == F.col("_own")) & (F.col("quality") == F.col("_label"))) \
        .select("text", "quality", "own").dropDuplicates(["own", "quality"])


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY`` bytes: trained, or the texts' own bytes where they are too few to train."""
    blocks = [t[i:i + 2 * PIECE] for t in texts for i in range(0, len(t), 2 * PIECE)]
    random.Random(5).shuffle(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks[:8000]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY]


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)


class Measure:
    """The compressed-size difference of a text under pairs of dictionaries (good, bad)."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        self.pairs = [(_compressor(good).compress, _compressor(bad).compress) for good, bad in pairs]

    def __call__(self, text: str | None) -> float:
        pieces = _pieces((text or "").encode("utf-8", "surrogatepass"))
        lengths = np.array([len(p) for p in pieces])
        total = 0.0
        for good, bad in self.pairs:
            d = np.array([len(bad(p)) - len(good(p)) for p in pieces]) / np.maximum(lengths, 40)
            total += float(np.average(np.clip(d, -CLIP, CLIP), weights=lengths + 1))
        return total / len(self.pairs) if text else 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small ridge; the slope is never negative."""
    s = x.std() or 1.0
    z, a, b = x / s, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + step[0], b + step[1]
    return max(a, 0.0) / s, b


def fit(rows: list[tuple[str, int]]) -> tuple[list[tuple[bytes, bytes]], float, float]:
    """Dictionary pairs, slope and offset from texts and labels; no pair if a class has too few texts."""
    by = {label: [t.encode("utf-8", "surrogatepass") for t, q in rows if q == label] for label in (0, 1)}
    parts = PAIRS + 1
    if min(map(len, by.values())) < 2 * parts:
        share = (len(by[1]) + 0.5) / (len(by[0]) + len(by[1]) + 1)
        return [], 0.0, float(np.log(share / (1 - share)))
    pairs = [(_dictionary(by[1][j::parts]), _dictionary(by[0][j::parts])) for j in range(PAIRS)]
    measure = Measure(pairs)
    rest = [(t, label) for label in (0, 1) for t in by[label][PAIRS::parts]]
    slope, offset = _logistic(np.array([measure(t.decode("utf-8", "surrogatepass")) for t, _ in rest]), np.array([q for _, q in rest], float))
    return pairs, slope, offset


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The classifier that a sample of labelled documents gives."""
    return fit([(r["text"], r["quality"]) for r in labelled(docs, labels, sample).orderBy("own", "quality").collect()])


def score_of(text: Column | str, model) -> Column:
    """The probability of label 1 for a text column."""
    pairs, slope, offset = model

    def make():
        measure = Measure(pairs) if pairs else lambda t: 0.0
        return lambda texts: {"score": [float(1 / (1 + np.exp(-np.clip(slope * measure(t) + offset, -30, 30)))) for t in texts]}

    return per_text(make, struct(score="double"), text)["score"]


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    out = docs.select("doc_id", crc_held_out().alias("held_out"), score_of(F.col("text"), fitted(docs, labels, sample)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    s = fresh(docs, "quality_score")
    return docs.withColumn(s, score_of(F.col("text"), fitted(docs, labels, sample))).where(F.col(s) >= threshold).drop(s)
