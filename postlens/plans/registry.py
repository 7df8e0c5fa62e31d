"""Registered queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, its DuckDB twin over the driver tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    twin: str | Callable[[], str] | None  # DuckDB text, or what makes it
    operator: str  # SURVEY §2 id(s)

    @property
    def sql(self) -> str | None:
        """The DuckDB twin, put together only when it is asked for."""
        if self.twin is None:
            return None
        return _bigint_count_if(self.twin if isinstance(self.twin, str) else self.twin())


REGISTRY: dict[str, Query] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; ``count(case when … then 1 end)`` is
    BIGINT like Spark's ``count_if``."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + len(tok), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"count(case when {_bigint_count_if(sql[j + len(tok):k - 1])} then 1 end)")
        i = k


def register(name: str, operator: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operator)
        return fn

    return deco
