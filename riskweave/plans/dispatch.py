"""Scoring of many registered features at once: one plan for each (method, parameters), with the scored feature as a
group key, instead of one plan for each feature.

A registry row becomes a ``Spec``: method, parameters, and the source features it reads. Specs that differ only in their
sources and weights are one group. The sources go to the plan as a small table (out_id, feature_id, place, weight), one
row for each source of a scored feature, which is configuration: ``MOST_SOURCES`` bounds it before it is sent to every
task. A group's plan reads its source rows once, sums them to daily cells, and only then hands the cells to the
scored features and target dates that need them.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import clip, micros_between, nan_to_null
from riskweave.functions.params import flag, number
from riskweave.operators.instance import rank_values, wilson_lower_bound
from riskweave.operators.ranking import quantile_rows
from riskweave.operators.windows import DateSpan, as_span, asof_latest, between_days, normalised, spread_cells, window_cells

OUT = ["out_id", "target_date"]
MOST_SOURCES = 100_000
INSTANCE = ("rank_scoring", "zscore", "winsorized_zscoring", "log_based_scoring", "wilson_fraud_scoring", "exponential_decay_scoring")
CATEGORY = ("softmax_scoring", "weighted_average", "max_scoring")
_PER_FEATURE = {"MAX": "max", "MIN": "min", "AVERAGE": "avg"}


@dataclass
class Spec:
    """One scored feature: what is computed from which sources. ``problem`` says why it cannot be."""

    feature_id: str
    feature_name: str
    version: str
    method: str = ""
    params: dict = field(default_factory=dict)
    sources: list[tuple[str, float]] = field(default_factory=list)
    problem: str | None = None
    skip: bool = False

    @property
    def key(self) -> tuple[str, str]:
        return self.method, json.dumps(self.params, sort_keys=True, default=str)


def _weight(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def spec_of(feature_id: str, feature_name: str, version, params: dict) -> Spec:
    """The spec of parsed registry parameters; errors are kept in it, not raised."""
    spec = Spec(feature_id, feature_name, str(version))
    given = dict(params)
    method, function = given.pop("scoring_method", None), given.pop("scoring_function", None)
    try:
        if method is not None:
            _instance(spec, str(method), given)
        elif function is not None:
            _category(spec, str(function), given)
        else:
            spec.skip, spec.problem = True, "names neither a scoring_method nor a scoring_function"
    except (ValueError, TypeError, ArithmeticError) as e:
        spec.problem = str(e)
    return spec


def _instance(spec: Spec, method: str, given: dict) -> None:
    if method not in INSTANCE:
        raise ValueError(f"unknown scoring_method '{method}'")
    spec.method = method
    weights = given.get("weights")
    if method == "wilson_fraud_scoring":
        ids = [given["feature_id_numerator"], given["feature_id_denominator"]] if {"feature_id_numerator", "feature_id_denominator"} <= set(given) else []
    else:
        ids = _listed(given.get("feature_id"))
    if not ids:
        raise ValueError("no source feature is named")
    many = not isinstance(given.get("feature_id"), str) and method != "wilson_fraud_scoring"
    keep: dict = {"range_start": number(given.get("range_start"), 0.0), "range_end": number(given.get("range_end"), 1.0)}
    if method == "rank_scoring":
        weighted = given.get("method") == "weighted_average" and many and weights is not None
        if many and not weighted:
            raise ValueError("a list of feature ids needs method='weighted_average' and weights")
        keep["mode"] = "weighted" if weighted else "sum" if flag(given.get("require_aggregation")) else "snapshot"
        keep["inverse"] = bool(given.get("is_inverse"))
        keep["threshold"] = number(given["threshold"]) if flag(given.get("apply_threshold")) and given.get("threshold") is not None else None
    elif method in ("zscore", "winsorized_zscoring"):
        multiple = bool(given.get("is_multiple_col"))
        wanted = (given.get("aggregation_method") if multiple else "SUM") if method == "winsorized_zscoring" or flag(given.get("require_aggregation")) else None
        if method == "winsorized_zscoring" and not multiple:
            wanted = None
        keep = {"agg": wanted.upper() if wanted else None, "period": int(number(given.get("period_in_days"), 30)) if wanted else 1}
        if keep["agg"] not in (None, "SUM", "AVERAGE", "MAX", "MIN", "WEIGHTED_AVERAGE"):
            raise ValueError(f"unsupported aggregation method: {wanted}")
        if keep["agg"] == "WEIGHTED_AVERAGE" and not (multiple and weights is not None):
            raise ValueError("agg_method 'weighted_average' needs weights")
        if method == "winsorized_zscoring":
            keep |= {"percentile": number(given.get("winsorize_percentile"), K.DEFAULT_WINSOR_PERCENTILE),
                     "scale": number(given.get("sigmoid_scale"), K.DEFAULT_SIGMOID_SCALE)}
        if keep["agg"] != "WEIGHTED_AVERAGE":
            weights = None
    else:
        if many and len(ids) > 1:
            raise ValueError(f"{method} reads one feature")
        keep["period"] = int(number(given.get("period_in_days"), 30))
        if method == "log_based_scoring":
            keep["threshold"] = number(given.get("threshold"), 0.0)
        if method == "exponential_decay_scoring":
            if given.get("period_in_days") is None:
                raise ValueError("exponential_decay_scoring needs period_in_days")
            keep |= {"unit": given.get("time_unit", "days"), "rate": number(given.get("decay_rate"), K.DEFAULT_DECAY_RATE)}
    spec.params = keep
    spec.sources = [(i, _weight((weights or {}).get(i, 0.0 if weights is not None else 1.0))) for i in ids]
    if weights is not None and method in ("rank_scoring", "zscore", "winsorized_zscoring") and sum(w for _, w in spec.sources) == 0:
        raise ZeroDivisionError("the sum of the weights of the target features cannot be zero")


def _category(spec: Spec, function: str, given: dict) -> None:
    if function not in CATEGORY:
        raise ValueError(f"unknown scoring_function '{function}'")
    weights = given.get("risk_weightage") or {}
    if not weights:
        raise ValueError("no features to score: risk_weightage is empty")
    spec.method, spec.sources = function, [(k, _weight(v)) for k, v in weights.items()]
    if function != "max_scoring" and sum(w for _, w in spec.sources) == 0:
        raise ZeroDivisionError("the sum of the weights of the target features cannot be zero")
    if function == "softmax_scoring":
        share = number(given.get("softmax_weightage"), K.DEFAULT_SOFTMAX_WEIGHTAGE)
        if not 0 <= share <= 1:
            raise ValueError(f"softmax_weightage {share} is outside [0, 1]")
        spec.params = {"share": share, "K": number(given.get("K"), K.DEFAULT_SOFTMAX_K)}


def groups_of(specs: list[Spec]) -> list[list[Spec]]:
    """Specs of the same method and parameters, those with a problem left out."""
    out: dict[tuple[str, str], list[Spec]] = {}
    for s in specs:
        if s.problem is None:
            out.setdefault(s.key, []).append(s)
    return [out[k] for k in sorted(out)]


# -------------------------------------------------------------------------------------------- inputs
def _sources(spark: SparkSession, group: list[Spec]) -> DataFrame:
    rows = [(s.feature_id, f, i, w, len(s.sources), sum(x for _, x in s.sources)) for s in group for i, (f, w) in enumerate(s.sources)]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"{len(rows)} sources in one group; {MOST_SOURCES} at most are sent to every task")
    return spark.createDataFrame(rows, "out_id string, feature_id string, place int, weight double, n_sources int, total_weight double")


def _source_ids(group: list[Spec]) -> list[str]:
    return sorted({f for s in group for f, _ in s.sources})


def _spread(fv: DataFrame, group: list[Spec], span: DateSpan, lookback: int) -> DataFrame:
    """Daily cells for the scored features that read them and the target dates whose window holds them."""
    return _for_outputs(window_cells(fv, span, lookback, _source_ids(group)), fv, group)


def _for_outputs(cells: DataFrame, fv: DataFrame, group: list[Spec]) -> DataFrame:
    return cells.join(F.broadcast(_sources(fv.sparkSession, group)), "feature_id")


def _combined(fv: DataFrame, group: list[Spec], span: DateSpan, lookback: int, agg: str | None) -> DataFrame:
    """(out_id, target_date, entity_id, x): the sources of a feature as one value (M1)."""
    cells = _spread(fv, group, span, lookback)
    kind = _PER_FEATURE.get(agg or "SUM", "sum")
    total, count = F.sum("s"), F.sum("k")
    own = {"sum": total, "max": F.max("hi"), "min": F.min("lo"), "avg": F.when(count > 0, total / count)}[kind]
    per = cells.groupBy(*OUT, "entity_id", "feature_id", "place", "weight", "n_sources", "total_weight").agg(own.alias("v"), count.alias("k"))
    v = F.coalesce("v", F.lit(0.0))
    wide = per.groupBy(*OUT, "entity_id", "n_sources", "total_weight").agg(
        F.sum(v).alias("s"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.sum(v * F.col("weight")).alias("w"), F.sum("k").alias("k"),
        F.count(F.lit(1)).alias("present"))
    absent = F.col("present") < F.col("n_sources")          # a source without rows counts as 0
    x = {"AVERAGE": F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(F.lit(0.0)),
         "MAX": F.when(absent, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")),
         "MIN": F.when(absent, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
         "WEIGHTED_AVERAGE": F.col("w") / F.col("total_weight")}.get(agg or "SUM", F.col("s"))
    if agg not in (None, "SUM"):
        wide = wide.where("k > 0")
    return wide.select(*OUT, "entity_id", x.alias("x"))


def _snapshot(fv: DataFrame, group: list[Spec], span: DateSpan) -> DataFrame:
    """W6 for many features: for each target the rows of its source's latest day with data within 365 days."""
    lookback = K.RANK_SNAPSHOT_LOOKBACK_DAYS
    rows = normalised(fv).where(F.col("feature_id").isin(_source_ids(group)))
    rows = rows.where(between_days(rows, "timestamp", span.start - _dt.timedelta(days=lookback), span.end)).withColumn("day", F.to_date("timestamp"))
    days = rows.select("feature_id", "day").distinct()
    newest = _for_outputs(spread_cells(days, span, lookback), fv, group).groupBy(*OUT, "feature_id").agg(F.max("day").alias("day"))
    return rows.join(newest, ["feature_id", "day"]).select(*OUT, "entity_id", F.col("feature_value").alias("x"))


# -------------------------------------------------------------------------------------------- methods
def _rank(fv, group, span, p):
    if p["mode"] == "weighted":
        values = _combined(fv, group, span, K.RANK_AGG_PERIOD_DAYS, "WEIGHTED_AVERAGE")
    elif p["mode"] == "sum":
        cells = _spread(fv, group, span, K.RANK_AGG_PERIOD_DAYS)
        values = cells.groupBy(*OUT, "entity_id").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("x"))
    else:
        values = _snapshot(fv, group, span)
    return rank_values(values, p["range_start"], p["range_end"], p["inverse"], p["threshold"] is not None, p["threshold"], value_col="x",
                       group_cols=OUT, groups=len(group) * len(span.days()))


def _deviation(stats_std):
    bad = F.col(stats_std).isNull() | F.isnan(stats_std) | (F.col(stats_std) <= 0)
    return F.when(bad, F.lit(1.0)).otherwise(F.col(stats_std))


def _zscore(fv, group, span, p):
    values = _combined(fv, group, span, p["period"], p["agg"])
    stats = values.groupBy(*OUT).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return values.join(stats, OUT).select(*OUT, "entity_id", nan_to_null((F.col("x") - F.col("mean")) / _deviation("std")).alias("score"))


def _winsorized(fv, group, span, p):
    values = _combined(fv, group, span, p["period"], p["agg"])
    stats = values.groupBy(*OUT).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    stats = stats.join(quantile_rows(values, OUT, "x", p["percentile"], out_col="top", groups=len(group) * len(span.days())), OUT)
    z = (F.least("x", "top") - F.col("mean")) / _deviation("std")
    score = F.when(F.col("x") > F.col("top"), F.lit(K.WINSOR_EXTREME_SCORE)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(p["scale"]) * z)))
    return values.join(stats, OUT).select(*OUT, "entity_id", nan_to_null(clip(score, 0.0, 1.0)).alias("score"))


def _log(fv, group, span, p):
    cells = _spread(fv, group, span, p["period"])
    values = cells.groupBy(*OUT, "entity_id").agg(F.sum("s").alias("x")).where(F.col("x") > F.lit(p["threshold"]))
    most = values.groupBy(*OUT).agg(F.max("x").alias("most"))
    top = F.when(F.col("most") > 0, F.col("most")).otherwise(F.lit(1.0))
    start, end = p["range_start"], p["range_end"]
    score = F.lit(start) + F.lit(end - start) * (F.log1p("x") / F.log1p(top))
    return values.join(most, OUT).select(*OUT, "entity_id", nan_to_null(clip(score, start, end)).alias("score"))


def _wilson(fv, group, span, p):
    cells = _spread(fv, group, span, p["period"])
    up, base = F.col("place") == 0, F.col("place") == 1
    sums = cells.groupBy(*OUT, "entity_id").agg(
        F.coalesce(F.sum(F.when(up, F.col("s"))), F.lit(0.0)).alias("ups"), F.sum(F.when(base, F.col("s"))).alias("n"),
        F.count_if(up).alias("ku"), F.count_if(base).alias("kn")).where("ku > 0 and kn > 0 and n > 0")
    start, end = p["range_start"], p["range_end"]
    score = F.lit(start) + F.lit(end - start) * wilson_lower_bound(F.col("ups"), F.col("n"))
    return sums.select(*OUT, "entity_id", nan_to_null(clip(nan_to_null(score), start, end)).alias("score"))


def _decay(fv, group, span, p):
    cells = _spread(fv, group, span, p["period"])
    now = cells.groupBy(*OUT).agg(F.max("ts").alias("now"))
    age = micros_between("ts", "now") / F.lit(1e6) / F.lit(86400.0 if p["unit"] == "days" else 3600.0)
    risk = cells.join(now, OUT).groupBy(*OUT, "entity_id").agg(F.coalesce(F.sum(F.col("hi") * F.exp(-F.lit(p["rate"]) * age)), F.lit(0.0)).alias("x"))
    ends = risk.groupBy(*OUT).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    start, end = p["range_start"], p["range_end"]
    score = F.when(F.col("hi") > F.col("lo"), F.lit(start) + (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(end - start)).otherwise(F.lit(0.5))
    return risk.join(ends, OUT).select(*OUT, "entity_id", nan_to_null(clip(score, start, end)).alias("score"))


def _of_category(method: str):
    def run(scores, group, span, p):
        rows = scores.where(F.col("feature_id").isin(_source_ids(group)))
        rows = rows.select("entity_id", "feature_id", "feature_value", "timestamp", *[c for c in ("ds",) if c in rows.columns])
        latest = asof_latest(rows, ["entity_id", "feature_id"], span, ["feature_value"], tie_breaks=["feature_value"])
        x = F.col("feature_value")
        w = F.col("weight") / F.col("total_weight")
        each = latest.join(F.broadcast(_sources(scores.sparkSession, group)), "feature_id").groupBy(*OUT, "entity_id")
        if method == "max_scoring":
            return each.agg(F.max(x).alias("score"))
        if method == "weighted_average":
            return each.agg(nan_to_null(F.sum(x * F.col("weight") / F.col("total_weight"))).alias("score"))
        e = F.exp(F.lit(p["K"]) * x)
        sums = each.agg(F.sum(w * x * e).alias("num"), F.sum(w * e).alias("den"), F.sum(w * x).alias("flat"))
        value = F.lit(p["share"]) * (F.col("num") / F.col("den")) + F.lit(1 - p["share"]) * F.col("flat")
        return sums.select(*OUT, "entity_id", nan_to_null(value).alias("score"))

    return run


METHODS = {"rank_scoring": _rank, "zscore": _zscore, "winsorized_zscoring": _winsorized, "log_based_scoring": _log,
           "wilson_fraud_scoring": _wilson, "exponential_decay_scoring": _decay, **{m: _of_category(m) for m in CATEGORY}}


def score_group(group: list[Spec], fv: DataFrame, scores: DataFrame | None, targets) -> DataFrame:
    """(out_id, target_date, entity_id, score) of all features of a group, in one plan."""
    method = group[0].method
    if method in CATEGORY and scores is None:
        raise ValueError(f"{method} combines scores, but no score store was given")
    return METHODS[method](scores if method in CATEGORY else fv, group, as_span(targets), group[0].params)
