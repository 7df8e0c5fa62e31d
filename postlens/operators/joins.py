"""Join-shaped operators (G1-G4, G6 lives in ``keywords``).

The reference has no SQL joins; these are the set-membership and lookup
patterns it performs.  Small sides (vocabularies, the ≤ k-row theme table)
are broadcast; their size is bounded by a parameter, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.metrics import align_counts, vocab_frame


def rows_not_in(df: DataFrame, sample: DataFrame, key: str = "id") -> DataFrame:
    """G1: rows whose key is not in ``sample`` (left anti join)."""
    return df.join(sample.select(key), key, "left_anti")


def align_to_vocabulary(counts: DataFrame, vocab: Sequence[str], key: str, fill_cols: Sequence[str]) -> DataFrame:
    """One row per vocabulary value in vocabulary order (``ord``), missing
    counts → 0 (union of zero rows + re-aggregate: no join)."""
    return align_counts(counts, vocab, key, fill_cols)


def with_theme_text(facts: DataFrame, themes: DataFrame, id_col: str = "id") -> DataFrame:
    """Theme facts ⟕ names/summaries, defaults ``Theme N`` and
    ``Analysis of N tweets in this theme``."""
    t = themes.select(F.col("id").alias(id_col), "name", "summary")
    out = facts.join(F.broadcast(t), id_col, "left")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Theme "), F.col(id_col).cast("string")))
    summ = F.coalesce(F.nullif(F.col("summary"), F.lit("")),
                      F.concat(F.lit("Analysis of "), F.col("tweet_count").cast("string"),
                               F.lit(" tweets in this theme")))
    return out.withColumn("name", name).withColumn("summary", summ)


def in_vocabulary(df: DataFrame, col: str, vocab: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows whose value is (``keep``) or is not in the vocabulary
    (semi / anti join against the broadcast vocabulary)."""
    voc = vocab_frame(df.sparkSession, vocab, col).select(col)
    return df.join(F.broadcast(voc), col, "left_semi" if keep else "left_anti")
