"""Filters and projections.

All predicates are plain Column expressions on stored columns so Catalyst
pushes them into the parquet scan (and prunes ``date`` partitions when the
table is written with ``partitionBy("date")``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.columns import aspect_display, aspect_stored


def _blank(v) -> bool:
    return v is None or (isinstance(v, str) and v.strip() == "")


def _as_date(v):
    if isinstance(v, (_dt.date, _dt.datetime)):
        return F.lit(v if not isinstance(v, _dt.datetime) else v.date())
    return F.to_date(F.lit(str(v).strip()))


def date_window(df: DataFrame, start=None, end=None, date_col: str = "date") -> DataFrame:
    """Inclusive calendar window on a date column; a missing bound is open
    (equivalent to the table's min/max default)."""
    cond = []
    if not _blank(start):
        cond.append(F.col(date_col) >= _as_date(start))
    if not _blank(end):
        cond.append(F.col(date_col) <= _as_date(end))
    return df.where(reduce(lambda a, b: a & b, cond)) if cond else df


def where_clause(df: DataFrame, start=None, end=None, extra: Sequence[Column] = (), date_col: str = "date",
                 both_or_none: bool = True) -> DataFrame:
    """The window applies only when both bounds are non-blank (when
    ``both_or_none``), then every extra predicate is AND-ed."""
    if both_or_none and (_blank(start) or _blank(end)):
        out = df
    else:
        out = date_window(df, start, end, date_col)
    for c in extra:
        out = out.where(c)
    return out


def timestamp_window(df: DataFrame, start=None, end=None, ts_col: str = "createdat") -> DataFrame:
    """``ts >= start`` and ``ts < end + 1 day`` (the whole end day); each
    bound optional."""
    out = df
    if not _blank(start):
        out = out.where(F.col(ts_col) >= _as_date(start).cast("timestamp_ntz"))
    if not _blank(end):
        out = out.where(F.col(ts_col) < F.date_add(_as_date(end), 1).cast("timestamp_ntz"))
    return out


def keyword_filter(df: DataFrame, keyword: str | None, text_col: str = "text", regex: bool = True) -> DataFrame:
    """Case-insensitive regex match (``regex=False``: literal substring)."""
    if _blank(keyword):
        return df
    c = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if regex:
        return df.where(c.rlike("(?i)" + keyword))
    return df.where(F.lower(c).contains(keyword.lower()))


def text_search(df: DataFrame, q: str | None, cols: Sequence[str] = ("text_clean", "text", "fulltext")) -> DataFrame:
    """E5: case-insensitive literal substring over several text columns (OR).
    The term is matched literally, so ``%`` and ``_`` need no escaping."""
    if _blank(q):
        return df
    needle = F.lit(q.strip().lower())
    conds = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, conds))


def theme_equals(df: DataFrame, theme_id: int, theme_col: str = "theme") -> DataFrame:
    """E6."""
    return df.where(F.col(theme_col) == F.lit(int(theme_id)))


def aspect_sentiment_equals(df: DataFrame, aspect: str | None, sentiment: str | None,
                            aspect_col: str = "aspect_dominant", by_stored_key: bool = False) -> DataFrame:
    """Case-insensitive aspect and sentiment equality.  With
    ``by_stored_key`` the requested aspect is first mapped to its stored key
    (B12) and compared exactly."""
    out = df
    if not _blank(aspect):
        if by_stored_key:
            key = aspect_stored(F.lit(aspect))
            out = out.where(F.col(aspect_col) == key)
        else:
            out = out.where(F.lower(F.col(aspect_col)) == F.lit(aspect.lower()))
    if not _blank(sentiment):
        out = out.where(F.lower(F.col("sentiment_label")) == F.lit(sentiment.lower()))
    return out


def include_others(df: DataFrame, include: bool, aspect_col: str = "aspect_dominant") -> DataFrame:
    """Drop rows whose displayed aspect is the fallback unless ``include``."""
    if include:
        return df
    return df.where(aspect_display(F.col(aspect_col)) != F.lit(W.ASPECT_FALLBACK))


# FIXED VALUES — columns returned when the caller names none
DEFAULT_FIELDS = ("id twitterurl text_clean text fulltext sentiment_label sentiment_score aspect_pricing aspect_delivery "
                  "aspect_returns aspect_staff aspect_app_ux aspect_dominant createdat lang has_url has_hashtag").split()


def select_fields(df: DataFrame, fields: Sequence[str] | str | None = None,
                  allowed: Sequence[str] | None = None) -> DataFrame:
    """Caller-chosen field list from an allow-list; unknown → ValueError."""
    if isinstance(fields, str):
        fields = [f.strip() for f in fields.split(",") if f.strip()]
    wanted = list(fields) if fields else list(DEFAULT_FIELDS)
    allow = set(allowed) if allowed is not None else set(df.columns)
    bad = [f for f in wanted if f not in allow or f not in df.columns]
    if bad:
        raise ValueError(f"unknown fields: {bad}")
    return df.select(*wanted)


def nonzero(df: DataFrame, count_col: str = "count") -> DataFrame:
    """E10."""
    return df.where(F.col(count_col) > 0)
