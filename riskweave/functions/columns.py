"""Column-expression helpers (JVM-side, codegen friendly). No Python UDFs anywhere.

Covers the reference's scalar helpers: rounding/clipping (F8), string tests (F1), sanitising run ids
(F2), category inference (F3), boolean parsing (F4), tolerant float parsing (F5), day arithmetic and
timestamp literals (F6/F7), DMS -> decimal degrees (F9), WKT points (F10), sentinel tests (F11) and
cadence defaults (F14).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import constants as K

__all__ = [
    "col_of", "r6", "r2", "clip", "nan_to_null", "ts_literal", "day_start", "day_end_exclusive",
    "sanitize_run_id", "infer_category", "parse_bool", "parse_bool_strict", "to_float", "dms_to_decimal",
    "wkt_point", "is_missing", "cadence_default", "feature_id_of", "micros_between",
]


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round half up to 6 decimals the same way the DuckDB oracle does (floor(x*1e6+0.5)/1e6)."""
    return F.floor(col_of(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def r2(c) -> Column:
    """2-decimal rounding for written scores (floor(x*100+0.5)/100, identical in Spark and DuckDB)."""
    return F.floor(col_of(c) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def clip(c, lo: float, hi: float) -> Column:
    """Clip like pandas: NULL and NaN stay missing (Spark's greatest/least would skip NULL and rank
    NaN highest)."""
    a, b = min(lo, hi), max(lo, hi)
    v = nan_to_null(col_of(c))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(v, F.lit(float(a))), F.lit(float(b))))


def nan_to_null(c) -> Column:
    """NaN -> NULL (pandas folds both into NaN; Spark keeps them apart)."""
    return F.nanvl(col_of(c), F.lit(None).cast("double"))


def ts_literal(value, like: T.DataType | None = None) -> Column:
    """A timestamp literal of the same flavour as the column it is compared with, so the predicate
    stays a bare-column comparison and reaches the Parquet scan as a pushed filter."""
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime.combine(value, _dt.time())
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    target = like if isinstance(like, (T.TimestampNTZType, T.TimestampType)) else T.TimestampNTZType()
    return F.lit(text).cast(target)


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def day_start(df: DataFrame, ts_col: str, day: _dt.date) -> Column:
    return ts_literal(day, _type_of(df, ts_col))


def day_end_exclusive(df: DataFrame, ts_col: str, day: _dt.date) -> Column:
    return ts_literal(day + _dt.timedelta(days=1), _type_of(df, ts_col))


def micros_between(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (zone-free for timestamp_ntz)."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))


def sanitize_run_id(c) -> Column:
    """Everything but Unicode letters/digits, '-' and '_' becomes '_'."""
    return F.regexp_replace(col_of(c).cast("string"), r"[^\p{L}\p{N}_-]", "_")


def infer_category(c, prefixes=K.CATEGORY_PREFIXES) -> Column:
    """First prefix p with key == p or key starting with p + '_'; NULL when none matches."""
    key = col_of(c)
    out = F.lit(None).cast("string")
    for p in reversed(prefixes):
        out = F.when((key == F.lit(p)) | key.startswith(F.lit(p + "_")), F.lit(p)).otherwise(out)
    return out


def parse_bool(c, default: bool = False) -> Column:
    """true/1/yes (case/space-insensitive) -> True; NULL -> default."""
    s = F.lower(F.trim(col_of(c).cast("string")))
    return F.when(s.isNull(), F.lit(default)).otherwise(s.isin(*K.TRUE_WORDS))


def parse_bool_strict(c, default: bool = False) -> Column:
    """Only 'true' (case/space-insensitive) -> True; NULL -> default."""
    s = F.lower(F.trim(col_of(c).cast("string")))
    return F.when(s.isNull(), F.lit(default)).otherwise(s == F.lit("true"))


def to_float(c, default: float | None = 0.0) -> Column:
    """float(v), or ``default`` when not parseable (try_cast: no ANSI error)."""
    v = F.trim(col_of(c).cast("string")).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def dms_to_decimal(c) -> Column:
    """Degrees, minutes, seconds and hemisphere at the start of the text; else a plain float; else NULL."""
    s = F.trim(col_of(c).cast("string"))
    deg = F.regexp_extract(s, K.DMS_PATTERN, 1)
    matched = deg != F.lit("")
    dd = (deg.try_cast("double") + F.regexp_extract(s, K.DMS_PATTERN, 2).try_cast("double") / F.lit(60.0)
          + F.regexp_extract(s, K.DMS_PATTERN, 3).try_cast("double") / F.lit(3600.0))
    hemi = F.upper(F.regexp_extract(s, K.DMS_PATTERN, 4))
    signed = F.when(hemi.isin("S", "W"), -dd).otherwise(dd)
    plain = F.when(F.lower(s) == F.lit("nan"), F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    return F.when(s.isNull() | (s == F.lit("")), F.lit(None).cast("double")).when(matched, signed).otherwise(plain)


def wkt_point(lat, lon) -> Column:
    """WKT point, latitude first, 6 decimals."""
    return F.format_string("POINT(%.6f %.6f)", r6(lat), r6(lon))


def is_missing(c, sentinels=True) -> Column:
    v = col_of(c)
    return v.isNull() | v.isin(*K.MISSING_SENTINELS) if sentinels else v.isNull()


def cadence_default(frequency, is_daily=None) -> Column:
    daily = F.coalesce(col_of(is_daily), F.lit(True)) if is_daily is not None else F.lit(True)
    return F.coalesce(col_of(frequency), F.when(daily, F.lit("daily")).otherwise(F.lit("always")))


def feature_id_of(name, version) -> Column:
    return F.concat(col_of(name), F.lit(K.FEATURE_ID_VERSION_SEP), col_of(version).cast("string"))
