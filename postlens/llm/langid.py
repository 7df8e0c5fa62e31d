"""Language identification by the nearest centroid.

A text becomes a vector of its letters' n-grams (runs of 1 to 4 characters of
the lower-cased text, where everything between letters is one space), hashed
to ``DIMS`` counts, weighted by log (1 + count) and inverse document frequency
and scaled to length 1.  The vectors of each language's sample are clustered
by spherical k-means; a text gets the language of the centroid with the
largest cosine.  It is marked as rejected if its distance from that centroid
is larger than those of nearly all texts the centroid was made from.

Centroids are fitted on the driver from a bounded sample: about ``SAMPLE``
different texts of each language, by a hash of id and text, as sparse counts.
Document frequencies and the distances behind the limits are those of all
documents that may be learned from: tasks count, and Spark adds up one row for
each dimension, and one for each centroid and step of distance.  Prediction is a
map over Arrow batches of whole texts, without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
a null language is not learned from; with nothing to learn from all are
``und``; ties go to the language first in code-point order; repeated rows give
repeated results; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import crc_held_out, per_text, struct

DIMS, GRAMS, CLUSTERS, SAMPLE, SHARPNESS = 1 << 13, 4, 4, 400, 25.0
#: Share of a language's texts whose distances lie within the limit, room beyond these, and steps in which distances are counted.
WITHIN, ROOM, STEPS = 0.995, 1.15, 2000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0][points]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's hashed n-grams; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = is_letter(points)
    if not letter.any():
        return None
    points = np.where(letter, points, 32)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    points = np.concatenate([[32], points[int(points[0] == 32): len(points) - int(points[-1] == 32)], [32]]).astype(np.uint64)
    total = np.zeros(DIMS, np.int64)
    run = points
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            if n > 1:
                if len(run) < 2:
                    break
                run = run[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
            h = (run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=DIMS)
    return total


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _clusters(vectors: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of a spherical k-means that starts from evenly spaced rows; clusters that stay empty go."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(1)
        centres = np.array([_scaled(vectors[own == j].mean(0)) for j in range(len(centres)) if (own == j).any()])
    return centres


class Model:
    """Inverse document frequencies, centroids with their languages, and the distance up to which each accepts."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], frequencies: np.ndarray, n: int, clusters: int = CLUSTERS) -> None:
        """From a sample of languages and counts, and how many of all ``n`` documents have each dimension."""
        self.langs = sorted({lang for lang, _ in rows})
        x = np.array([c for _, c in rows]) if rows else np.zeros((0, DIMS), np.int64)
        self.idf = (np.log((1 + n) / (1 + frequencies)) + 0.1).astype(np.float32)
        vectors = self.vectors(x)
        of, centres = [], []
        for i, lang in enumerate(self.langs):
            found = _clusters(vectors[[a == lang for a, _ in rows]], clusters)
            of += [i] * len(found)
            centres.append(found)
        self.of = np.array(of, int)
        self.centres = np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, DIMS), np.float32)
        self.limits = np.full(len(self.of), np.inf)

    def limit(self, steps: np.ndarray) -> None:
        """The limits, from how many documents of a centroid's language lie nearest to it at each step of distance."""
        def at(counted: np.ndarray) -> float:
            if not counted.sum():
                return 0.0
            return float((np.searchsorted(np.cumsum(counted), WITHIN * counted.sum()) + 1) * 2 / STEPS)

        usual = [at(steps[self.of == i].sum(0)) for i in range(len(self.langs))]
        self.limits = np.array([ROOM * max(usual[i], at(own)) for i, own in zip(self.of, steps, strict=True)])

    def nearest(self, lang: str, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts of a language, its nearest centroid and the step of the distance to it."""
        own = np.flatnonzero(self.of == self.langs.index(lang))
        near = vectors @ self.centres[own].T
        return own[near.argmax(1)], np.clip((1 - near.max(1)) * STEPS / 2, 0, STEPS - 1).astype(int)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """Rows of counts as weighted vectors of length 1."""
        x = x.astype(np.float32)
        tf = np.log1p(x) * self.idf
        return _scaled(tf)

    def predict(self, texts: list[str | None]) -> dict:
        """Language, score and rejection of each text."""
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if self.langs:
            for lo in range(0, len(texts), 64):
                some = [(i, c) for i in range(lo, min(lo + 64, len(texts))) if (c := counts(texts[i])) is not None]
                if not some:
                    continue
                near = self.vectors(np.array([c for _, c in some])) @ self.centres.T
                best = np.stack([near[:, self.of == i].max(1) for i in range(len(self.langs))], 1)
                p = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                far = 1 - near.max(1) > self.limits[near.argmax(1)]
                for (i, _), j, row, no in zip(some, best.argmax(1).tolist(), p, far.tolist(), strict=True):
                    lang[i], score[i], rejected[i] = self.langs[j], float(row[j]), no
        return {"lang_pred": lang, "score": score, "rejected": rejected}


def learnable(docs: DataFrame) -> DataFrame:
    """Language and text of the documents that may be learned from."""
    known = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("own"), (~crc_held_out()).alias("may"))
    return known.where("may and lang is not null and text is not null").drop("may")


def sampled(known: DataFrame, sample: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """Language and counts of about ``sample`` texts of each language, rows alike in id and text taken once."""
    u = F.pmod(F.col("own"), F.lit(1 << 20))
    bound = F.lit(0)
    for r in known.groupBy("lang").count().collect():  # a row for each language
        bound = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, sample / r["count"]) * (1 << 20)) + 1)).otherwise(bound)
    chosen = known.where(u < bound)

    def make():
        def sparse(texts):
            found = [counts(t) for t in texts]
            return {"grams": [None if c is None else np.flatnonzero(c).astype("<u2").tobytes() for c in found],
                    "times": [None if c is None else np.minimum(c[c > 0], 1 << 30).astype("<u4").tobytes() for c in found]}
        return sparse

    rows = chosen.select("own", "lang", per_text(make, struct(grams="binary", times="binary"), F.col("text")).alias("v")) \
        .select("own", "lang", "v.*").where("grams is not null").dropDuplicates(["own", "lang"]).orderBy("own", "lang").collect()
    out = []
    for r in rows:
        c = np.zeros(DIMS, np.int64)
        c[np.frombuffer(r["grams"], "<u2")] = np.frombuffer(r["times"], "<u4")
        out.append((r["lang"], c))
    return out


def _tallied(known: DataFrame, shape: tuple[int, int], make) -> np.ndarray:
    """The sum over all batches of ``make(languages, texts)``, a matrix of counts: within tasks first, then entry by entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                total += make(batch.column(0).slice(lo, 64).to_pylist(), batch.column(1).slice(lo, 64).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    out = np.zeros(shape[0] * shape[1], np.int64)
    for r in known.select("lang", "text").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def fitted(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """The model that documents with a language, other than held-out ones, give."""
    known = learnable(docs)
    rows = sampled(known, sample)
    if not rows:
        return Model([], np.zeros(DIMS, np.int64), 0)

    def present(langs: list, texts: list) -> np.ndarray:
        total = np.zeros((1, DIMS + 1), np.int64)  # the last counts documents
        for text in texts:
            if (c := counts(text)) is not None:
                total[0, :DIMS] += c > 0
                total[0, DIMS] += 1
        return total

    had = _tallied(known, (1, DIMS + 1), present)[0]
    model = Model(rows, had[:DIMS], int(had[DIMS]), clusters)

    def steps(langs: list, texts: list) -> np.ndarray:
        total = np.zeros((len(model.of), STEPS), np.int64)
        found: dict = {}
        for lang, text in zip(langs, texts, strict=True):
            if lang in model.langs and (c := counts(text)) is not None:
                found.setdefault(lang, []).append(c)
        for lang, own in found.items():
            np.add.at(total, model.nearest(lang, model.vectors(np.array(own))), 1)
        return total

    model.limit(_tallied(known, (len(model.of), STEPS), steps))
    return model


def predicted(text: Column | str, model: Model) -> Column:
    """A struct ``lang_pred, score, rejected`` for a text column."""
    return per_text(lambda: model.predict, struct(lang_pred="string", score="double", rejected="boolean"), text)


def identify(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``: the language of the nearest centroid, its share among the
    languages' softmax of cosines, and whether the text lies beyond the centroid's limit."""
    model = fitted(docs, sample, clusters)
    return docs.select("doc_id", crc_held_out().alias("held_out"), predicted(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")
