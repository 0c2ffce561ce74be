"""Date windows, the target-date spine, and newest-row-per-key reductions.

Scale notes
-----------
* Newest-per-key is a ``groupBy(key).agg(max(struct(order..., payload...)))``: a hash aggregate with a
  map-side partial step, so a key holding a third of all rows is reduced inside every map task before
  the shuffle -- no single task ever sorts a hot key's rows (a ``row_number`` window would).
* Window filters are half-open ranges on the raw timestamp column so they reach the Parquet scan.
* Many target dates: rows are summed to daily cells first (``daily_cells``), and each cell is exploded only to the dates
  whose window contains it (fan-out <= lookback+1 per cell), giving an equi-key ``target_date`` that
  every downstream aggregate / rank partitions on.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import day_end_exclusive, day_start


@dataclass(frozen=True)
class DateSpan:
    """Closed range of target (as-of) dates."""

    start: _dt.date
    end: _dt.date

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"empty date span {self.start}..{self.end}")

    @property
    def single(self) -> bool:
        return self.start == self.end

    def days(self) -> list[_dt.date]:
        n = (self.end - self.start).days
        return [self.start + _dt.timedelta(days=i) for i in range(n + 1)]


def as_span(targets) -> DateSpan:
    if isinstance(targets, DateSpan):
        return targets
    if isinstance(targets, str):
        d = _dt.date.fromisoformat(targets)
        return DateSpan(d, d)
    if isinstance(targets, _dt.datetime):
        return DateSpan(targets.date(), targets.date())
    if isinstance(targets, _dt.date):
        return DateSpan(targets, targets)
    a, b = targets
    return DateSpan(as_span(a).start, as_span(b).end)


def between_days(df: DataFrame, ts_col: str, first: _dt.date, last: _dt.date) -> Column:
    """Closed day range [first, last] written as a half-open range on the raw column (pushdown)."""
    return (F.col(ts_col) >= day_start(df, ts_col, first)) & (F.col(ts_col) < day_end_exclusive(df, ts_col, last))


def normalised(df: DataFrame) -> DataFrame:
    """Missing values in one form before any statistic: NaN feature values become NULL (Spark would rank
    and average NaN), rows without an entity go."""
    kinds, out = dict(df.dtypes), df
    if "entity_id" in kinds:
        out = out.where(F.col("entity_id").isNotNull())
    if kinds.get("feature_value") in ("double", "float"):
        out = out.withColumn("feature_value", F.when(~F.isnan("feature_value"), F.col("feature_value")))
    return out


def day_of(df: DataFrame) -> Column:
    """The day of a row: the partition value ``ds`` where the table has it, so that filters on days select
    partitions, else the day of the timestamp."""
    return F.to_date("ds" if "ds" in df.columns else "timestamp")


def target_window(df: DataFrame, targets, lookback_days: int, ts_col: str = "timestamp",
                  feature_ids: list[str] | None = None) -> DataFrame:
    """Rows whose day lies in the closed window [D - lookback_days, D] of each target date D.

    Adds ``day`` and ``target_date``: one literal (pushed-down) filter over the union of windows, then
    each row is exploded to exactly the target dates whose window contains its day (one date: fan-out 1).
    """
    span = as_span(targets)
    n = int(lookback_days)
    out = normalised(df)
    if feature_ids is not None:
        out = out.where(F.col("feature_id").isin(list(feature_ids)))
    out = out.where(between_days(out, ts_col, span.start - _dt.timedelta(days=n), span.end))
    out = out.withColumn("day", F.to_date(F.col(ts_col)))
    # One code path for one or many dates: target_date is derived from the row's day, never a bare
    # literal, so Catalyst cannot fold the per-date joins into key-less (nested-loop) joins.
    first = F.greatest(F.col("day"), F.lit(span.start))
    last = F.least(F.date_add(F.col("day"), n), F.lit(span.end))
    return out.withColumn("target_date", F.explode(F.sequence(first, last)))


def daily_cells(df: DataFrame, targets, lookback_days: int, feature_ids: list[str], ts_col: str = "timestamp") -> DataFrame:
    """One row per (feature, entity, day) of the windows of all target dates: sum ``s``, maximum ``hi``, minimum ``lo``, number of
    values ``k`` and newest time ``ts``. Rows are summed to cells, with a partial aggregate before the shuffle,
    before anything is spread over dates."""
    span = as_span(targets)
    rows = normalised(df).where(F.col("feature_id").isin(list(feature_ids)))
    rows = rows.where(between_days(rows, ts_col, span.start - _dt.timedelta(days=int(lookback_days)), span.end))
    v = F.col("feature_value")
    return rows.groupBy("feature_id", "entity_id", F.to_date(ts_col).alias("day")).agg(
        F.sum(v).alias("s"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.count(v).alias("k"), F.max(ts_col).alias("ts"))


def spread_cells(cells: DataFrame, targets, lookback_days: int) -> DataFrame:
    """Each cell for the target dates whose window [D - lookback_days, D] holds its day."""
    span, n = as_span(targets), int(lookback_days)
    first, last = F.greatest("day", F.lit(span.start)), F.least(F.date_add("day", n), F.lit(span.end))
    return cells.withColumn("target_date", F.explode(F.sequence(first, last)))


def window_cells(df: DataFrame, targets, lookback_days: int, feature_ids: list[str]) -> DataFrame:
    """Daily cells by target date."""
    return spread_cells(daily_cells(df, targets, lookback_days, feature_ids), targets, lookback_days)


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                   tie_breaks: list[str] | None = None) -> DataFrame:
    """Newest row per key (W1): keeps ``keys + order_cols + value_cols`` of the row with the largest
    (order_cols, tie_breaks) tuple. Tie-breaks make the pick total-order deterministic (Q18)."""
    tie_breaks = [c for c in (tie_breaks or []) if c not in order_cols]
    carried = [c for c in value_cols if c not in order_cols and c not in tie_breaks]
    packed = F.struct(*[F.col(c) for c in order_cols + tie_breaks + carried]).alias("_top")
    return df.groupBy(*keys).agg(F.max(packed).alias("_top")).select(
        *keys, *[F.col("_top." + c).alias(c) for c in order_cols + [c for c in value_cols if c not in order_cols]])


def latest_non_null_per_key(df: DataFrame, keys: list[str], order_col: str, value_cols: list[str],
                            tie_breaks: list[str] | None = None) -> DataFrame:
    """Per key and per column, the value of the newest row where that column is not NULL (W3: what a
    sort + groupby().last() does in pandas). Each column is a ``max_by`` with the ordering nulled out
    where the value is NULL, so all columns come from one partial aggregation."""
    order = F.struct(F.col(order_col), *[F.col(c) for c in (tie_breaks or [])])
    aggs = [F.max(F.col(order_col)).alias(order_col)]
    for c in value_cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def asof_latest(df: DataFrame, keys: list[str], targets, value_cols: list[str], ts_col: str = "timestamp",
                tie_breaks: list[str] | None = None) -> DataFrame:
    """As-of read for many dates (J14 without a range join): for every target date D of the span and
    every key, the newest row with day <= D, with NULL values skipped (W3).

    Each key's daily cell is valid from its day until the day before the key's next cell (``lead``
    over the key's daily cells -- at most one row per day, so no partition grows with a hot key) and
    is exploded only to the target dates inside that interval: the fan-out equals the output size.
    Rows before the span keep only the last one per key as the carry-in."""
    span = as_span(targets)
    rows = normalised(df.where(F.col(ts_col) < day_end_exclusive(df, ts_col, span.end)))
    if "ds" in df.columns:
        rows = rows.where(F.col("ds") <= F.lit(span.end.isoformat()))
    for c in value_cols:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("_day", F.to_date(ts_col))
    cells = latest_per_key(rows, keys + ["_day"], [ts_col], value_cols, tie_breaks=tie_breaks)
    nxt = F.lead("_day").over(Window.partitionBy(*keys).orderBy("_day"))
    valid_to = F.coalesce(F.date_sub(nxt, 1), F.lit(span.end))
    cells = cells.withColumn("_to", valid_to).where(F.col("_to") >= F.lit(span.start))
    return cells.withColumn("target_date", F.explode(F.sequence(F.greatest(F.col("_day"), F.lit(span.start)), F.col("_to")))) \
                .drop("_day", "_to")
