"""Exact rank statistics per group without a single-partition window.

For each row, within its group: ``n_rows`` (group size), ``n_greater`` / ``n_less`` (rows with a
strictly larger / smaller value) and the multiplicity of the group's minimum and maximum. From these:

* min-rank descending  = 1 + n_greater   (pandas ``rank(method='min', ascending=False)``)
* min-rank ascending   = 1 + n_less
* percent_rank desc    = n_greater / (n_rows - 1)
* linear-interpolated quantiles (``quantile_rows``)

Plan: (1) collapse to distinct (group, value) with counts -- the partial aggregate absorbs hot values;
(2) cut each group's distinct values into value-range buckets using approximate quantiles (the
buckets only decide *placement*, results stay exact); (3) a running count inside each bucket plus a
broadcast table of bucket offsets (groups x buckets rows); (4) join back to the rows with hot values
salted. Bucket boundaries and offsets are one row per group and bucket: their size is bounded by the
number of groups (feature x target date). Callers that know this number name it, and the tables are broadcast if
it is small; without it the planner decides by their size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.skew import HOT_ROWS, SALTS, salted_join

# Value-range buckets per group: the within-bucket running count is one window partition per
# (group, bucket), so a group of N distinct values is spread over ~BUCKETS tasks of N/BUCKETS rows.
BUCKETS = 200


#: Rows of group statistics that may be sent to every task.
BROADCAST_ROWS = 500_000


def _hint(df: DataFrame, groups: int | None, rows_per_group: int) -> DataFrame:
    """A broadcast hint where the number of groups is known and small; otherwise the planner decides by size."""
    return F.broadcast(df) if groups is not None and groups * rows_per_group <= BROADCAST_ROWS else df


def _distinct_values(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    if not group_cols:
        raise ValueError("rank statistics need at least one group column (e.g. target_date)")
    v = F.col(value_col)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))


def _count_below(df: DataFrame, bounds: str, value_col: str, n_bounds: int, out: str = "_b") -> DataFrame:
    """Number of (sorted) bounds strictly below the value: a lower-bound binary search of
    ceil(log2(n+1)) steps, instead of a per-row scan of the whole array.

    The search is ONE ``aggregate`` expression over the step sequence, carrying (lo, hi). Written as
    chained projections instead, each step re-references the previous step's CASE several times, and
    once the optimizer collapses the projections the expression tree grows exponentially with the
    number of steps (planning never finishes)."""
    steps = max(1, math.ceil(math.log2(n_bounds + 1)))
    zero = F.struct(F.lit(0).alias("lo"), F.lit(n_bounds).alias("hi"))

    def step(acc, _i):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.coalesce(F.get(F.col(bounds), mid) < F.col(value_col), F.lit(False))
        return (F.when(lo >= hi, acc)
                 .when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
                 .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))))

    return df.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)["lo"])


def _group_stats(dv: DataFrame, g: list[str], value_col: str, buckets: int, hot_rows: int) -> DataFrame:
    """One row per group: bucket bounds, size, multiplicity of min and max, and the group's hot values
    (at most n/hot_rows of them -- a proven bound for the broadcast)."""
    probs = [i / buckets for i in range(1, buckets)]
    return dv.groupBy(*g).agg(
        F.percentile_approx(value_col, probs, 10000).alias("_bounds"),
        F.sum("_cnt").alias("_n"),
        F.min_by("_cnt", value_col).alias("_cnt_min"),
        F.max_by("_cnt", value_col).alias("_cnt_max"),
        F.collect_list(F.when(F.col("_cnt") >= hot_rows, F.col(value_col))).alias("_hot_values"),
    )


def distinct_value_ranks(df: DataFrame, group_cols: list[str], value_col: str,
                         buckets: int | None = None, dv: DataFrame | None = None, stats: DataFrame | None = None,
                         hot_rows: int = HOT_ROWS, groups: int | None = None) -> DataFrame:
    """One row per (group, distinct value): _cnt, _n_less, _n_greater, _n, _cnt_min, _cnt_max."""
    g = list(group_cols)
    buckets = buckets or BUCKETS
    v = F.col(value_col)
    dv = _distinct_values(df, g, value_col) if dv is None else dv
    stats = _group_stats(dv, g, value_col, buckets, hot_rows) if stats is None else stats
    dvb = dv.join(_hint(stats.drop("_hot_values"), groups, buckets), g)
    dvb = _count_below(dvb, "_bounds", value_col, buckets - 1).drop("_bounds")
    per_bucket = dvb.groupBy(*g, "_b").agg(F.sum("_cnt").alias("_bcnt"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*g, "_b", F.coalesce(F.sum("_bcnt").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    out = dvb.join(_hint(offsets, groups, buckets), g + ["_b"])
    out = out.withColumn("_n_less", F.col("_off") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
    out = out.withColumn("_n_greater", F.col("_n") - F.col("_n_less") - F.col("_cnt"))
    return out.drop("_b", "_off")


def with_rank_stats(df: DataFrame, group_cols: list[str], value_col: str, buckets: int | None = None,
                    hot_rows: int = HOT_ROWS, salts: int = SALTS, groups: int | None = None) -> DataFrame:
    """``groups``: how many groups there are at most, where the caller knows. Rows of ``df`` with a non-null, non-NaN value, plus the rank-statistic columns. The per-group
    stats broadcast also carries the hot values, so tagging hot rows costs no extra pass."""
    g = list(group_cols)
    buckets = buckets or BUCKETS
    dv = _distinct_values(df, g, value_col)
    stats = _group_stats(dv, g, value_col, buckets, hot_rows)
    ranks = distinct_value_ranks(df, g, value_col, buckets, dv=dv, stats=stats, hot_rows=hot_rows, groups=groups)
    v = F.col(value_col)
    rows = (df.where(v.isNotNull() & ~F.isnan(v))
              .join(_hint(stats.select(*g, "_hot_values"), groups, buckets), g)
              .withColumn("_is_hot", F.array_contains("_hot_values", v)).drop("_hot_values"))
    spread = [c for c in df.columns if c not in g + [value_col]] or [value_col]
    out = salted_join(rows, ranks, g + [value_col], F.col("_is_hot"), F.col("_cnt") >= hot_rows, salts, spread_cols=spread)
    return out.drop("_is_hot")


def quantile_rows(df: DataFrame, group_cols: list[str], value_col: str, p: float,
                  buckets: int | None = None, out_col: str = "quantile", groups: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantile per group (same as pandas ``quantile`` / ``quantile_cont``):
    with h = (n-1)p, the value at 0-based ascending position k is the distinct value with
    n_less <= k < n_less + cnt."""
    g = list(group_cols)
    dv = distinct_value_ranks(df, g, value_col, buckets, groups=groups)
    h = (F.col("_n") - 1) * F.lit(float(p))
    k0, k1 = F.floor(h), F.ceil(h)

    def at(k):
        return (F.col("_n_less") <= k) & (k < F.col("_n_less") + F.col("_cnt"))

    picked = dv.where(at(k0) | at(k1)).groupBy(*g).agg(
        F.max(F.when(at(k0), F.col(value_col))).alias("_v0"),
        F.max(F.when(at(k1), F.col(value_col))).alias("_v1"),
        F.first(h).alias("_h"),
    )
    return picked.select(*g, (F.col("_v0") + (F.col("_h") - F.floor(F.col("_h"))) * (F.col("_v1") - F.col("_v0")))
                         .alias(out_col))
