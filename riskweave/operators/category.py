"""Category scoring methods M8-M10 over the latest value per (entity, feature) as of a date.

Weights are configuration (a handful of features), so they travel as a literal map expression --
no join. Output: (entity_id, risk_value) for one as-of date, or (target_date, entity_id,
risk_value) for a ``DateSpan``.
"""

from __future__ import annotations

import datetime as _dt
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import nan_to_null
from riskweave.operators.windows import as_span, asof_latest


def _latest(scores: DataFrame, ids: list[str], as_of) -> tuple[DataFrame, list[str]]:
    """Latest value per (entity, feature) as of every date asked for, read the same way for one date and
    for a ``DateSpan`` (then grouped by ``target_date`` as well)."""
    span = as_span(as_of)
    rows = scores.where(F.col("feature_id").isin(ids)).select("entity_id", "feature_id", "feature_value", "timestamp")
    latest = asof_latest(rows, ["entity_id", "feature_id"], span, ["feature_value"], tie_breaks=["feature_value"])
    return latest, ["entity_id"] if span.single else ["target_date", "entity_id"]


def _weights(risk_weightage: dict) -> dict[str, float]:
    if not risk_weightage:
        raise ValueError("no features to score: risk_weightage is empty")
    out = {}
    for k, v in risk_weightage.items():
        try:
            out[k] = float(v)
        except (TypeError, ValueError):
            out[k] = 0.0
    return out


def _lookup(mapping: dict[str, float], key: Column) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in mapping.items()))
    return m[key]


def softmax_scoring(scores: DataFrame, as_of: _dt.date, risk_weightage: dict,
                    softmax_weightage=K.DEFAULT_SOFTMAX_WEIGHTAGE, K_=K.DEFAULT_SOFTMAX_K, **kw) -> DataFrame:
    """M8: alpha * sum(w x e^{Kx}) / sum(w e^{Kx}) + (1 - alpha) * sum(w x), w normalised by the
    sum of all configured weights."""
    w = _weights(risk_weightage)
    k = float(kw.get("K", K_))
    alpha = float(softmax_weightage)
    if not 0 <= alpha <= 1:
        raise ValueError(f"softmax_weightage {alpha} is outside [0, 1]")
    total = sum(w.values())
    latest, g = _latest(scores, list(w), as_of)
    nw = _lookup({f: v / total for f, v in w.items()}, F.col("feature_id"))
    x = F.col("feature_value")
    e = F.exp(F.lit(k) * x)
    s = latest.groupBy(*g).agg(
        F.sum(nw * x * e).alias("_num"), F.sum(nw * e).alias("_den"), F.sum(nw * x).alias("_wm"))
    value = F.lit(alpha) * (F.col("_num") / F.col("_den")) + F.lit(1 - alpha) * F.col("_wm")
    return s.select(*g, nan_to_null(value).alias("risk_value"))


def weighted_average(scores: DataFrame, as_of: _dt.date, risk_weightage: dict, **_ignored) -> DataFrame:
    """M9: sum(x * w / total) over present features; absent features count as 0 (no renormalising)."""
    w = _weights(risk_weightage)
    total = sum(w.values())
    latest, g = _latest(scores, list(w), as_of)
    term = F.col("feature_value") * _lookup(w, F.col("feature_id")) / F.lit(total)
    return latest.groupBy(*g).agg(nan_to_null(F.sum(term)).alias("risk_value"))


def max_scoring(scores: DataFrame, as_of: _dt.date, risk_weightage: dict, **_ignored) -> DataFrame:
    """Max of the latest values; the weights only select the features."""
    w = _weights(risk_weightage)
    latest, g = _latest(scores, list(w), as_of)
    return latest.groupBy(*g).agg(F.max("feature_value").alias("risk_value"))


CATEGORY_METHODS = {
    "softmax_scoring": softmax_scoring,
    "weighted_average": weighted_average,
    "max_scoring": max_scoring,
}
