"""A skipping index for text search (E4, E5): which files can hold a term.

For each file the index has a Bloom filter of the byte trigrams of its
lower-cased texts, stored by 64-bit words: ``(file, word, bits)``.  A trigram
sets one bit of one word.  A task sets the bits of all trigrams of an Arrow batch
at once, in a bit map for each file it reads, so its work grows with the bytes
of the texts, and no row for each trigram is made; the partial filters are
joined by bitwise or.  A search reads only the words of its own trigrams, keeps the files that
have all of their bits, and looks into these files alone, with the exact
predicate.  A file that holds the term always has the bits, so nothing is lost; a
term of fewer than three bytes, or a pattern that isn't plain text, reads
all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.filters import keyword_filter, text_search
from postlens.sources import published

#: 64-bit words of a file's filter: 2**20 bits, 128 kB.
WORDS = 1 << 14
_BITS = 20
#: Bit maps that a task holds at once, of 1 MB each.
_MAPS = 32
#: Trigrams that are worked on at once.
_PART = 1 << 15
_PLAIN = re.compile(r"[\w\s,:;!%&#@\"'<>=~`/-]+")


def _slots(grams: np.ndarray) -> np.ndarray:
    """The place of each trigram, as a number of 24 bits, among the bits of a filter."""
    return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def _grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """The trigrams of the bytes of all texts of a binary column, none across two texts, in parts that stay in the
    processor's cache; one pass over the column's buffer."""
    texts = texts.drop_null().cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if ends[-1] - ends[0] < 3:
        return
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[1:-1] - ends[0]
    for start in range(0, len(data) - 2, _PART):
        part = data[start : start + _PART + 2].astype(np.uint32)
        whole = np.ones(len(part) - 2, bool)
        for back in (1, 2):  # these begin in one text and end in another
            cut = ends[np.searchsorted(ends, start + back) : np.searchsorted(ends, start + back + len(whole))] - start - back
            whole[cut] = False
        yield (part[:-2] << 16 | part[1:-1] << 8 | part[2:])[whole]


def _partial_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, word, bits`` of the rows of a task: a bit map for each file, of which it reads one or a few neighbours."""
    maps: dict[str, np.ndarray] = {}

    def out(name: str) -> pa.RecordBatch:
        words = np.packbits(maps.pop(name), bitorder="little").view("<i8")
        held = np.flatnonzero(words)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(words[held])], ["file", "word", "bits"])

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        for i, name in enumerate(names.dictionary.to_pylist()):
            own = batch.filter(pc.equal(names.indices, i))
            if name not in maps:
                while len(maps) >= _MAPS:
                    yield out(next(iter(maps)))
                maps[name] = np.zeros(WORDS * 64, bool)
            for column in own.columns[1:]:
                for grams in _grams(column):
                    maps[name][_slots(grams)] = True
    while maps:
        yield out(next(iter(maps)))


def build(spark: SparkSession, table: str, path: str, cols: Sequence[str]) -> None:
    """Index the text columns ``cols`` of the parquet table at ``table``; sorted by word, so that a search reads few row groups."""
    rows = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), *cols)
    texts = [F.lower(F.col(c)).cast("binary").alias(f"text_{i}") for i, c in enumerate(cols)]
    words = rows.select("file", *texts).mapInArrow(_partial_filters, "file string, word int, bits long")
    words = words.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
    # every file has a row, also without any trigram
    every = rows.select("file").distinct().select("file", F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"))
    published.publish(words.unionByName(every).repartitionByRange("word", "file").sortWithinPartitions("word", "file"), path)


def files(spark: SparkSession, path: str, term: str) -> tuple[list[str], int]:
    """The files that can hold a term, and how many there are."""
    index = published.read(spark, path)
    every = index.where("word = -1").select("file")
    total = every.count()
    wanted: dict[int, int] = {}
    lowered = spark.range(1).select(F.lower(F.lit(term)).cast("binary")).first()[0]
    for grams in _grams(pa.array([bytes(lowered)], pa.binary())):
        for slot in set(_slots(grams).tolist()):
            wanted[slot >> 6] = wanted.get(slot >> 6, 0) | 1 << (slot & 63)
    if not wanted:
        return sorted(r["file"] for r in every.collect()), total
    signed = {w: b - (1 << 64) if b >> 63 else b for w, b in wanted.items()}
    has = reduce(lambda a, b: a | b, [(F.col("word") == w) & (F.col("bits").bitwiseAND(F.lit(b)) == b) for w, b in signed.items()])
    found = index.where(F.col("word").isin(list(wanted))).where(has).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return sorted(r["file"] for r in found.collect()), total


def _of(spark: SparkSession, table: str, index: str, term: str) -> DataFrame:
    found, total = files(spark, index, term)
    whole = spark.read.parquet(table)
    if len(found) == total:
        return whole
    # files are named as URIs
    return spark.read.schema(whole.schema).option("basePath", table).parquet(*map(unquote, found)) if found else whole.where("false")


def search(spark: SparkSession, table: str, index: str, q: str | None, cols: Sequence[str] = ("text_clean", "text", "fulltext")) -> DataFrame:
    """E5 on an indexed table: the same rows as ``text_search``."""
    if q is None or not q.strip():
        return spark.read.parquet(table)
    return text_search(_of(spark, table, index, q.strip().lower()), q, cols)


def keyword(spark: SparkSession, table: str, index: str, pattern: str | None, text_col: str = "text") -> DataFrame:
    """E4 on an indexed table: the same rows as ``keyword_filter``; the index serves patterns that are plain text."""
    if pattern is None or not pattern.strip():
        return spark.read.parquet(table)
    plain = _PLAIN.fullmatch(pattern) and pattern.isascii()
    return keyword_filter(_of(spark, table, index, pattern) if plain else spark.read.parquet(table), pattern, text_col)
