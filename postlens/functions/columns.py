"""Column-role resolution and small scalar helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import wordlists as W


def resolve(df: DataFrame, candidates: Sequence[str], role: str = "column", required: bool = True) -> str | None:
    """First candidate present in ``df.columns`` (driver-side, no job)."""
    for name in candidates:
        if name in df.columns:
            return name
    if required:
        raise KeyError(f"No {role} column among {list(candidates)}; columns present: {df.columns}")
    return None


def sentiment_key(c: Column) -> Column:
    """Null label → ``neutral``; otherwise lower-cased (decision: labels that
    collapse onto one key add up)."""
    return F.lower(F.coalesce(c, F.lit("neutral")))


def aspect_display(c: Column, fallback: str = W.ASPECT_FALLBACK) -> Column:
    """null/blank/none/unspecified → fallback label, else trimmed text."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("", "none", "unspecified"), F.lit(fallback)).otherwise(t)


def aspect_stored(c: Column, fallback: str = W.ASPECT_FALLBACK) -> Column:
    """Display name → stored key (fallback → ``none``; lower; blanks and
    ``/`` → ``_``); null or blank → null."""
    t = F.trim(c.cast("string"))
    key = F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", "_"), "/", "_")
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(F.lower(t) == fallback.lower(), F.lit(W.ASPECT_STORED_FALLBACK))
        .otherwise(key)
    )


def aspect_api_key(c: Column) -> Column:
    """lower/trim; ``app_ux`` → ``app/ux``."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t == "app_ux", F.lit("app/ux")).otherwise(t)


def first_non_empty(*cols: Column | str, default: str = "") -> Column:
    """First value that is neither null nor empty."""
    parts = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.coalesce(*parts, F.lit(default))


def pretty_label(c: Column, underscores: str = "all") -> Column:
    """Capitalise the first character; ``_`` → space for ``all``
    underscores, only the ``first`` one, or ``none``."""
    head = F.upper(F.substring(c, 1, 1))
    tail = F.substring(c, 2, 1 << 30)
    if underscores == "all":
        tail = F.regexp_replace(tail, "_", " ")
    elif underscores == "first":
        tail = F.regexp_replace(tail, "^([^_]*)_", "$1 ")
    return F.concat(head, tail)


def serialize_rows(df: DataFrame) -> DataFrame:
    """Bigint → string, timestamp/date → ``YYYY-MM-DD``, aspect normalised."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.LongType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd")
        if f.name == "aspect_dominant":
            c = aspect_display(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def dominant_aspect(
    score_cols: dict[str, Column | str],
    threshold: float = W.ASPECT_THRESHOLD,
    fallback: str = W.ASPECT_FALLBACK,
) -> Column:
    """Name of the highest score (first wins on ties); fallback when the
    maximum is below ``threshold``.  Missing scores count as 0.0."""
    scores = F.array(*[F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0.0)).cast("double")
                       for v in score_cols.values()])
    top = F.array_max(scores)
    # array_position finds the first maximum: ties go to the earlier aspect
    name = F.element_at(F.array(*[F.lit(k) for k in score_cols]), F.array_position(scores, top).cast("int"))
    return F.when(top < F.lit(threshold), F.lit(fallback)).otherwise(name)
