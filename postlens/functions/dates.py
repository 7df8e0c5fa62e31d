"""Date parsing and bucketing as Column expressions.

All parsing is JVM-side (``try_to_timestamp`` / ``timestamp_seconds``); a bad
value becomes null instead of failing the job (ANSI mode is on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES — string layouts accepted besides ISO, and the local zone
DATE_PATTERNS = ["MMM-dd-yyyy", "MM/dd/yyyy"]
LOCAL_ZONE = "US/Eastern"
EPOCH_MS_CUTOFF = 1e11


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")


def _ltz_to_utc_wallclock(c: Column, session_tz: str) -> Column:
    """An instant (TIMESTAMP_LTZ) as its UTC wall-clock time (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit(session_tz), F.lit("UTC"), c.cast("timestamp_ntz"))


def parse_string_timestamp(c: Column, session_tz: str, patterns: list[str] | None = None) -> Column:
    """String → UTC wall-clock timestamp_ntz; ISO first, then each pattern."""
    pats = DATE_PATTERNS if patterns is None else patterns
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(p)) for p in pats]
    return _ltz_to_utc_wallclock(F.coalesce(*tries), session_tz)


def epoch_to_timestamp(c: Column, unit: str, session_tz: str) -> Column:
    """Epoch seconds or milliseconds → UTC wall-clock timestamp_ntz."""
    num = c.cast("long")
    ltz = F.timestamp_millis(num) if unit == "ms" else F.timestamp_seconds(num)
    return _ltz_to_utc_wallclock(ltz, session_tz)


def epoch_unit(df: DataFrame, column: str) -> str:
    """``ms`` when the median is above 1e11, else ``s``.  One aggregate job;
    an approximate median is exact enough to tell the two ranges apart."""
    med = df.agg(F.percentile_approx(F.col(column).cast("double"), 0.5, 10000).alias("m")).first()["m"]
    return "ms" if med is not None and med > EPOCH_MS_CUTOFF else "s"


def to_utc_wallclock(df: DataFrame, column: str, unit: str | None = None) -> Column:
    """Any date-like column → UTC wall-clock timestamp_ntz, null when unparseable."""
    dtype = df.schema[column].dataType
    tz = _session_tz(df)
    c = F.col(column)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return _ltz_to_utc_wallclock(c, tz)
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        return epoch_to_timestamp(c, unit or epoch_unit(df, column), tz)
    return parse_string_timestamp(c.cast("string"), tz)


def utc_to_local(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall clock → wall clock in ``zone`` (naive), DST-aware."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def normalize_date_param(c: Column) -> Column:
    """``MM/DD/YYYY`` → ``YYYY-MM-DD``; ISO and anything else unchanged."""
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
        .when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2"))
        .otherwise(c)
    )


def period_bucket(c: Column, period: str) -> Column:
    """Bucket start date for ``daily``/``weekly`` (Monday)/``monthly``."""
    d = F.to_date(c)
    if period == "daily":
        return d
    if period == "weekly":
        return F.to_date(F.date_trunc("week", d))
    if period == "monthly":
        return F.to_date(F.date_trunc("month", d))
    raise ValueError(f"period must be daily, weekly or monthly, not {period!r}")


def period_label(c: Column, period: str) -> Column:
    """Chart label of a bucket start; unknown period → the ISO date."""
    d = F.to_date(c)
    if period == "daily":
        return F.date_format(d, "MMM d")
    if period == "weekly":
        return F.concat(F.lit("Week "), F.date_format(d, "MMM d"))
    if period == "monthly":
        return F.date_format(d, "MMM yyyy")
    return F.date_format(d, "yyyy-MM-dd")


def iso_or_empty(c: Column) -> Column:
    """Any date-like value as ``YYYY-MM-DD``; empty string for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
