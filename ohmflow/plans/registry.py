"""Query catalogue: name -> (Spark plan builder, DuckDB oracle SQL).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
test tables.  Double columns are rounded (``rounded``) on both sides so that
summation order does not change the compared digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``sql`` is its DuckDB twin (omit when not SQL-expressible)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (``overrides`` gives per-column digits)."""
    overrides = overrides or {}
    cols = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            cols.append(F.round(F.col(c).cast("double"), overrides.get(c, digits)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def load_all() -> None:
    """Import the theme modules so that their decorators register queries."""
    from . import (browse, io, kpi, quality, relate, series, shapes, stats, streams)  # noqa: F401
