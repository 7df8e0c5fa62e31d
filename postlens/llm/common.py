"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import scratch_path

#: Rows that are worked on at a time.
SLICE = 1000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8 (``bytes.split`` separates on exactly the
    characters that ``WORD`` leaves out); none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: unlike a checkpoint it is computed once, and what Spark has
    inferred of its columns doesn't grow from round to round."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release() -> None:
    """Give back the memory that a task's work has freed: a Python worker lives on beside its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over Arrow batches that releases its memory when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def per_text(make: Callable[[], Callable[[list], dict]], schema: T.StructType, text: Column | str) -> Column:
    """A struct column computed from a column of texts or bytes in Arrow batches.

    ``make()`` runs once in each task and returns a function from a list of
    values (null is None) to a dict of lists, one for each field."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        try:
            for batch in batches:
                values = [None if x is None or x != x else x for x in batch.tolist()]
                # results go back in smaller batches, so that few of them are held
                for lo in range(0, max(1, len(values)), SLICE):
                    out = work(values[lo:lo + SLICE])
                    yield pd.DataFrame({f.name: pd.Series(out[f.name], dtype=_dtype(f.dataType)) for f in schema.fields})
        finally:
            work = None
            release()

    return run(text)


def _dtype(kind: T.DataType) -> str:
    return {"bigint": "int64", "int": "int32", "double": "float64", "boolean": "bool"}.get(kind.simpleString(), "object")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "string": T.StringType(), "binary": T.BinaryType()}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A struct type from names and types or type names."""
    return T.StructType([T.StructField(n, _TYPES.get(t, t)) for n, t in fields.items()])


def crc_held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
