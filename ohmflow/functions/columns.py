"""Column helpers: strict numeric parsing, NaN handling, timestamps, names.

All helpers return Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)

# Timestamp patterns tried in order (ISO forms first, then the slash dates of
# the sample file such as 2025/5/2).
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d",
]


def nan_to_null(c: Column) -> Column:
    """NaN compares true in Spark (NaN > 3); missing must be NULL instead."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


NUMERIC_NAMES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def strict_double(c: Column, dtype: T.DataType | str | None = None) -> Column:
    """Parse to double the way a lenient numeric coercion does: unparseable -> NULL.

    ``try_cast`` alone accepts Java literal suffixes ('1d', '1f'); those are
    refused here.  NaN (also the text 'nan') becomes NULL.
    """
    numeric = (isinstance(dtype, NUMERIC_TYPES) or
               (isinstance(dtype, str) and (dtype in NUMERIC_NAMES or dtype.startswith("decimal"))))
    if numeric:
        return nan_to_null(c.cast("double"))
    s = F.trim(c.cast("string"))
    # a Java literal suffix: last char d/D/f/F right after a digit or '.' ('inf' stays a number);
    # two substring tests instead of a regex per cell
    java_suffix = (F.substring(s, -1, 1).isin("d", "D", "f", "F")
                   & F.substring(s, -2, 1).isin(*list("0123456789.")))
    parsed = F.when(java_suffix, F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    return nan_to_null(parsed)


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """First format that parses wins; result is a wall-clock TIMESTAMP_NTZ."""
    fmts = formats or TIMESTAMP_FORMATS
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts])
    return parsed.cast("timestamp_ntz")


_UNIT = re.compile(r"\s*[（(][^()（）]*[)）]\s*$")


def strip_unit(name: str) -> str:
    """'电流 (A)' -> '电流'."""
    return _UNIT.sub("", name.strip())


def canonical_names(columns: list[str], strict: bool = False) -> list[str]:
    """Names after alias normalisation (positional, so 'I' and 'i' never collide).

    For each canonical name the first alias present, in the order of the alias
    list, gets it; a column that held the name before keeps its values under
    ``<name>_other``.  ``strict=True`` keeps unit suffixes, as the original did;
    by default a trailing '(unit)' is removed first.
    """
    names = [c.strip() if strict else strip_unit(c) for c in columns]
    out = list(names)
    for canon, aliases in schemas.ALIASES.items():
        alias = next((a for a in aliases if a in names), None)
        if alias is None or alias == canon:
            continue
        if canon in names:
            out[names.index(canon)] = f"{canon}_other"
        out[names.index(alias)] = canon
    return out


def normalize_columns(df: DataFrame, strict: bool = False) -> DataFrame:
    """Strip names and rename aliases to canonical English names."""
    return df.toDF(*canonical_names(df.columns, strict=strict))


def missing_required(columns: list[str]) -> list[str]:
    """Required columns absent after normalisation (driver-side schema check)."""
    return [c for c in schemas.REQUIRED if c not in columns]
