"""Data quality: coercion, rule counters, shaping, constraint checks.

Rule counters are one aggregate per key (map-side combined), unpivoted to
(rule, violations) rows; no rule needs a shuffle beyond that aggregate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import missing_required, normalize_columns, strict_double
from .ordering import IDX, global_index, row_number_in_key

__all__ = ["normalize_columns", "coerce_numeric", "power_mismatch", "rule_counters", "validation_report",
           "validation_summary",
           "validation_messages",
           "range_violations", "drop_empty_rows", "shape_records", "filter_eq", "check_constraints",
           "duplicate_keys", "unique_violations", "sequence_numbers"]


def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Parse the signal columns to double; unparseable, empty and NaN -> NULL."""
    cols = [c for c in (columns or schemas.REQUIRED) if c in df.columns]
    types = dict(df.dtypes)
    parsed = {c: strict_double(F.col(c), types[c]) for c in cols}
    return df.withColumns(parsed)


def power_mismatch(current: Column, voltage: Column, power: Column, tol: float = schemas.POWER_TOLERANCE) -> Column:
    """P5: |P - I*V| > tol * I*V; any missing value -> not a mismatch.

    With I*V < 0 the tolerance is negative, so such rows always count.
    """
    calc = current * voltage
    return F.coalesce(F.abs(power - calc) > F.lit(tol) * calc, F.lit(False))


def rule_counters(coerced: DataFrame) -> list[tuple[str, Column]]:
    """(rule name, counting expression) in report order; only rules whose columns exist."""
    cols = set(coerced.columns)
    rules: list[tuple[str, Column]] = []
    for c in schemas.REQUIRED:
        if c in cols:
            rules.append((f"{c}_not_numeric", F.count_if(F.col(c).isNull())))
    if "current" in cols:
        rules.append(("current_negative", F.count_if(F.col("current") < schemas.CURRENT_MIN)))
        rules.append(("current_above_max", F.count_if(F.col("current") > schemas.CURRENT_MAX)))
    if "voltage" in cols:
        rules.append(("voltage_negative", F.count_if(F.col("voltage") < schemas.VOLTAGE_MIN)))
        rules.append(("voltage_above_max", F.count_if(F.col("voltage") > schemas.VOLTAGE_MAX)))
    if all(c in cols for c in schemas.REQUIRED):
        rules.append(("power_mismatch", F.count_if(power_mismatch(F.col("current"), F.col("voltage"),
                                                                  F.col("power")))))
    return rules


def validation_report(df: DataFrame, keys: list[str] | None = None, strict_names: bool = False) -> DataFrame:
    """One row per (key, rule): rule_no, rule, violations, valid.

    ``valid`` is true for a key whose rules all have zero violations.  Missing
    required columns are one rule, ``missing: <names>``, whose violations are
    their number (a schema fact, known on the driver).
    """
    wide, rules = _rule_row(df, list(keys or []), strict_names)
    entries = F.array(*[F.struct(F.lit(i + 1).alias("rule_no"), F.lit(name).alias("rule"),
                                 F.col(f"_r{i}").cast("long").alias("violations"))
                        for i, (name, _) in enumerate(rules)])
    # valid is decided on the wide per-key row, before unpivoting: no window, no sort
    return wide.select(*(keys or []), F.inline(entries), _all_zero(rules).alias("valid"))


def _rule_row(df: DataFrame, keys: list[str], strict_names: bool):
    """One row per key with the violations of each rule in ``_r<i>``, and the rules."""
    norm = normalize_columns(df, strict=strict_names)
    missing = missing_required(norm.columns)
    coerced = coerce_numeric(norm)
    rules = ([(_missing_rule(missing), F.lit(len(missing)).cast("long"))] if missing else []) + rule_counters(coerced)
    return coerced.groupBy(*keys).agg(*[expr.alias(f"_r{i}") for i, (_, expr) in enumerate(rules)]), rules


def _all_zero(rules) -> Column:
    total = F.lit(0).cast("long")
    for i in range(len(rules)):
        total = total + F.col(f"_r{i}").cast("long")
    return total == 0


def validation_summary(df: DataFrame, keys: list[str] | None = None, strict_names: bool = False) -> DataFrame:
    """P6 in its original shape, from the data: per key valid, and the messages of violated rules in report
    order, joined by '; '.  One aggregate: the messages are put together on each key's row of counters."""
    keys = list(keys or [])
    wide, rules = _rule_row(df, keys, strict_names)
    said = F.concat_ws("; ", *[F.when(F.col(f"_r{i}") > 0, F.lit(_message(name))) for i, (name, _) in enumerate(rules)])
    return wide.select(*keys, _all_zero(rules).alias("valid"), said.alias("messages"))


def _missing_rule(names) -> str:
    return "missing: " + ", ".join(names)


def _message(rule: str) -> str:
    if rule.startswith("missing: "):
        return schemas.MSG_MISSING.format(cols=", ".join(schemas.ORIGINAL_NAMES[n] for n in rule[9:].split(", ")))
    if rule.endswith("_not_numeric"):
        return schemas.MSG_NOT_NUMERIC.format(col=schemas.ORIGINAL_NAMES[rule[:-12]])
    return {"current_negative": schemas.MSG_CURRENT_NEGATIVE, "current_above_max": schemas.MSG_CURRENT_ABOVE_MAX,
            "voltage_negative": schemas.MSG_VOLTAGE_NEGATIVE, "voltage_above_max": schemas.MSG_VOLTAGE_ABOVE_MAX,
            "power_mismatch": schemas.MSG_POWER_MISMATCH}[rule]


def validation_messages(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P6 in its original shape: per key (valid, messages of violated rules in report order).

    Missing columns give one message for all.  Messages are joined by '; '.
    """
    keys = list(keys or [])
    names = ([_missing_rule(c) for n in range(1, 4) for c in itertools.combinations(schemas.REQUIRED, n)]
             + [f"{c}_not_numeric" for c in schemas.REQUIRED]
             + ["current_negative", "current_above_max", "voltage_negative", "voltage_above_max", "power_mismatch"])
    msg = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(_message(n)))])
    bad = F.when(F.col("violations") > 0, F.struct(F.col("rule_no"), msg[F.col("rule")].alias("m")))
    agg = report.groupBy(*keys).agg(F.min("valid").alias("valid"), F.collect_list(bad).alias("_m"))
    text = F.array_join(F.transform(F.array_sort(F.col("_m")), lambda e: e["m"]), "; ")
    return agg.select(*keys, "valid", text.alias("messages"))


def range_violations(coerced: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P4 counters per key (bounds themselves pass)."""
    keys = list(keys or [])
    return coerced.groupBy(*keys).agg(
        F.count_if(F.col("current") < schemas.CURRENT_MIN).alias("current_negative"),
        F.count_if(F.col("current") > schemas.CURRENT_MAX).alias("current_above_max"),
        F.count_if(F.col("voltage") < schemas.VOLTAGE_MIN).alias("voltage_negative"),
        F.count_if(F.col("voltage") > schemas.VOLTAGE_MAX).alias("voltage_above_max"))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every column is NULL (NaN counts as missing)."""
    return df.na.drop(how="all")


def sequence_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "sequence_number") -> DataFrame:
    """1-based contiguous position (long) per key in ``order``."""
    return row_number_in_key(global_index(df, keys, order), keys, name).drop(IDX)


def shape_records(df: DataFrame, experiment_id: Column | str, keys: list[str], order: list[str],
                  now: Column | None = None) -> DataFrame:
    """P10: rows ready for the experiment_data table.

    Absent signal columns become 0.0 (a present NULL stays NULL); address 1,
    type '未知', timestamp ``now`` (a parameter, for reruns) when absent;
    temperature / humidity only when present.
    """
    norm = normalize_columns(df)
    cols = set(norm.columns)
    eid = F.col(experiment_id) if isinstance(experiment_id, str) else experiment_id
    seq = sequence_numbers(norm.withColumn("_eid", eid.cast("string")), ["_eid"] + [k for k in keys if k != "_eid"],
                           order)
    # the stored table's column is an INTEGER
    out = [F.col("_eid").alias("experiment_id"), F.col("sequence_number").cast("int").alias("sequence_number")]
    for c in schemas.REQUIRED:
        out.append((F.col(c).cast("double") if c in cols else F.lit(0.0)).alias(c))
    out.append((F.col("device_address").cast("int") if "device_address" in cols
                else F.lit(schemas.DEFAULT_DEVICE_ADDRESS)).alias("device_address"))
    out.append((F.col("device_type").cast("string") if "device_type" in cols
                else F.lit(schemas.DEFAULT_DEVICE_TYPE)).alias("device_type"))
    ts_default = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    out.append((F.col("timestamp") if "timestamp" in cols else ts_default).alias("timestamp"))
    for c in ("temperature", "humidity"):
        if c in cols:
            out.append(F.col(c).cast("double").alias(c))
    return seq.select(*out)


def filter_eq(df: DataFrame, **conds) -> DataFrame:
    """Equality filters; a ``None`` value adds no filter (pushed to the scan)."""
    for c, v in conds.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def check_constraints(df: DataFrame, table: str, checks: dict[str, list[str]] | None = None,
                      not_null: list[str] | None = None, varchar: dict[str, int] | None = None) -> DataFrame:
    """One row per (table, column, rule) with the violation count.

    CHECK membership: NULL passes (as in SQL).  NOT NULL and VARCHAR(n) limits
    counted on the same single aggregate.
    """
    checks = schemas.CHECKS.get(table, {}) if checks is None else checks
    not_null = schemas.NOT_NULL.get(table, []) if not_null is None else not_null
    varchar = schemas.VARCHAR_LIMITS.get(table, {}) if varchar is None else varchar
    cols = set(df.columns)
    rules = []
    for c, allowed in checks.items():
        if c in cols:
            rules.append((c, "check_in", F.count_if(~F.col(c).isin(*allowed))))
    for c in not_null:
        if c in cols:
            rules.append((c, "not_null", F.count_if(F.col(c).isNull())))
    for c, n in varchar.items():
        if c in cols:
            rules.append((c, f"varchar_{n}", F.count_if(F.length(F.col(c)) > n)))
    wide = df.agg(*[e.alias(f"_c{i}") for i, (_, _, e) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                                 F.lit(r).alias("rule"), F.col(f"_c{i}").cast("long").alias("violations"))
                        for i, (c, r, _) in enumerate(rules)])
    return wide.select(F.inline(entries))


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """P15 over the table's unique columns: (table, column, value, row_count) of each value held twice or more."""
    out = None
    for c in schemas.UNIQUE_KEYS[table]:
        part = duplicate_keys(df, [c]).select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                                              F.col(c).cast("string").alias("value"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; NULL keys never collide."""
    nn = None
    for k in keys:
        c = F.col(k).isNotNull()
        nn = c if nn is None else nn & c
    return (df.where(nn).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .where(F.col("row_count") > 1))
