"""Data shapes that charts consume (G1-G7): long series, gauge status, matrix,
stacked bars, shares, scatter pairs, metric cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["series_long", "threshold_status", "matrix_pivot", "bar_totals", "share_of_total",
           "scatter_pairs", "count_text", "amount_text", "metric_cards"]


def series_long(df: DataFrame, ids: list[str], y1: list[str], y2: list[str] | None = None) -> DataFrame:
    """G1: one row per (row, y column) with the axis (1 or 2) it is drawn on."""
    y2 = y2 or []
    cols = y1 + y2
    entries = F.array(*[F.struct(F.lit(c).alias("series"), F.lit(1 if c in y1 else 2).alias("axis"),
                                 F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*ids, F.inline(entries))


def threshold_status(value: Column, threshold: Column) -> Column:
    """G2: 'danger' above the threshold, 'success' otherwise; no or zero threshold -> 'neutral'."""
    return (F.when(threshold.isNull() | (threshold == 0), F.lit("neutral"))
            .when(value > threshold, F.lit("danger")).otherwise(F.lit("success")))


def matrix_pivot(df: DataFrame, row: str, col: str, value: str, col_values: list) -> DataFrame:
    """Rows x columns of mean values; the column values are given (no extra job)."""
    return df.groupBy(row).pivot(col, col_values).agg(F.avg(value))


def bar_totals(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The visible stacked bar per x (and colour) is the sum of its rows."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*keys).agg(F.sum(y).alias(f"{y}_total"))


def share_of_total(df: DataFrame, label: str, value: str) -> DataFrame:
    """Sum per label and its share of the grand total (summed over the labels: one scan)."""
    per = df.groupBy(label).agg(F.sum(value).alias("total"))
    grand = F.sum("total").over(Window.partitionBy())            # over one row per label
    return per.select(label, "total", F.try_divide(F.col("total"), grand).alias("share"))


def scatter_pairs(df: DataFrame, ids: list[str], dims: list[str]) -> DataFrame:
    """Lower triangle of the scatter matrix: (x_dim, y_dim, x, y) for dims i > j."""
    pairs = [(dims[j], dims[i]) for i in range(len(dims)) for j in range(i)]
    entries = F.array(*[F.struct(F.lit(xd).alias("x_dim"), F.lit(yd).alias("y_dim"),
                                 F.col(xd).cast("double").alias("x"), F.col(yd).cast("double").alias("y"))
                        for xd, yd in pairs])
    return df.select(*ids, F.inline(entries))


def count_text(value: Column) -> Column:
    """Whole number with thousands separators; NULL stays NULL."""
    return F.format_number(value, 0)


def amount_text(value: Column, unit: Column) -> Column:
    """Number with two decimals and its unit; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string("%.2f %s", value, unit))


def metric_cards(periodic: DataFrame, period: str, metrics: dict[str, str]) -> DataFrame:
    """Per period and metric: value to 2 decimals with its unit, and the change
    against the previous period with its colour, as numbers and as displayed text.

    The colour is 'normal' for a change above zero, else 'inverse' (also
    without a change); a change of zero or none has no text.

    ``periodic`` is already aggregated per period (small); ``metrics`` maps a
    column to its unit.
    """
    w = Window.orderBy(period)
    with_delta = periodic.select(period, *[F.col(m).cast("double").alias(f"_v{i}") for i, m in enumerate(metrics)],
                                 *[(F.col(m) - F.lag(m).over(w)).cast("double").alias(f"_d{i}")
                                   for i, m in enumerate(metrics)])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.col(f"_v{i}").alias("_v"),
                                 F.col(f"_d{i}").alias("_d"))
                        for i, (m, u) in enumerate(metrics.items())])
    long = with_delta.select(period, F.inline(entries))
    return long.select(
        period, "metric", F.round("_v", 2).alias("value"), "unit", F.round("_d", 2).alias("delta"),
        F.when(F.col("_d") > 0, F.lit("normal")).otherwise(F.lit("inverse")).alias("delta_color"),
        amount_text(F.col("_v"), F.col("unit")).alias("value_text"),
        F.when(F.col("_d") != 0, amount_text(F.col("_d"), F.col("unit"))).alias("delta_text"))
