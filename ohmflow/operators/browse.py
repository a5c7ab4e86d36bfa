"""Browsing: newest rows, pages, single-row lookup, preview, history range.

Every limit here is the feature itself (a page, a preview, a top-k), planned
as TakeOrderedAndProject: each task keeps its own top rows, only those move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

__all__ = ["newest", "readings_page", "sorted_list", "single_row", "preview_head", "history_range",
           "home_cards"]


def newest(df: DataFrame, order_col: str, tie: str, n: int = schemas.EXPERIMENTS_PAGE, offset: int = 0) -> DataFrame:
    """Q1: newest first (NULLs first, as Postgres sorts DESC), ``tie`` ascending breaks ties."""
    ordered = df.orderBy(F.col(order_col).desc_nulls_first(), F.col(tie).asc_nulls_last())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(n)


def readings_page(df: DataFrame, key: str, value, order: list[str], n: int = schemas.READINGS_PAGE,
                  seq_name: str | None = "sequence_number") -> DataFrame:
    """Q2: readings of one experiment in order, first ``n``; ``seq_name`` numbers the page."""
    page = df.where(F.col(key) == F.lit(value)).orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)
    if seq_name:
        # the window runs over at most n rows (the page), never over the experiment
        page = page.withColumn(seq_name, F.row_number().over(Window.orderBy(*order)))
    return page


def sorted_list(df: DataFrame, by: str) -> DataFrame:
    """Q3: whole list ascending with NULLs last (distributed range sort)."""
    return df.orderBy(F.col(by).asc_nulls_last())


def single_row(df: DataFrame, cond: Column) -> DataFrame:
    """Q5: the one matching row; zero or several matches give an empty result."""
    two = df.where(cond).limit(2)
    return two.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).where("_n = 1").drop("_n")


def preview_head(df: DataFrame, order: list[str], n: int = schemas.PREVIEW_ROWS) -> DataFrame:
    """Q6: first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)


def history_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows with start <= ts <= end; the predicate reaches the Parquet scan
    (row-group skipping, and partition pruning on date-partitioned layouts)."""
    c = F.col(ts)
    return df.where((c >= F.lit(start).cast("timestamp_ntz")) & (c <= F.lit(end).cast("timestamp_ntz")))


def home_cards(df: DataFrame) -> DataFrame:
    """The home page's columns; an absent column is empty text, an absent device the fixed label
    (a device that is there but NULL stays NULL)."""
    cols = {"experiment_name": "", "experiment_type": "", "status": "", "result": "", "start_time": "",
            "device_id": schemas.UNKNOWN_DEVICE_LABEL}
    return df.select(*[F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in cols.items()])
