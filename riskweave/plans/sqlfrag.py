"""SQL fragments shared by the DuckDB oracle queries (the oracle mirrors each Spark plan's
semantics in plain SQL over the same Parquet tables)."""

from __future__ import annotations


def dbl(x: float) -> str:
    """An exact double literal (string -> double parsing is correctly rounded in both engines)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def r6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"


def r2(expr: str) -> str:
    return f"(floor(({expr}) * 100 + 0.5) / 100)"


def clip(expr: str, lo: float, hi: float) -> str:
    a, b = min(lo, hi), max(lo, hi)
    return f"(CASE WHEN ({expr}) IS NULL OR isnan({expr}) THEN NULL ELSE least(greatest({expr}, {dbl(a)}), {dbl(b)}) END)"


def fv_cte(name: str = "fv", measure: str = "count", include_any: bool = False) -> str:
    agg = "CAST(count(*) AS DOUBLE)" if measure == "count" else "sum(value)"
    suffix = f"{measure}_daily"
    base = (f"SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type || '_{suffix}_v1' AS feature_id, "
            f"event_type || '_{suffix}' AS feature_name, '1' AS feature_version, {agg} AS feature_value, "
            f"max(ts) AS \"timestamp\", '' AS comments FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
    if include_any:
        base += (f" UNION ALL SELECT CAST(user_id AS VARCHAR), 'any_{suffix}_v1', 'any_{suffix}', '1', {agg}, max(ts), '' "
                 f"FROM events GROUP BY user_id, CAST(ts AS DATE)")
    return f"{name} AS ({base})"


def score_store_cte(weights: dict[str, float]) -> str:
    """instance scores per (feature, day) + weighted risk score, as ``store``."""
    total = sum(weights.values())
    case = " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in weights.items())
    rank_score = clip("CASE WHEN n <= 1 OR mr <= 1 THEN 1.0 ELSE 1.0 - (r - 1) / (mr - 1) * 1.0 END", 0.0, 1.0)
    return f"""{fv_cte('fv_s')},
inst0 AS (SELECT entity_id, feature_id, CAST("timestamp" AS DATE) AS day, feature_value,
                 rank() OVER (PARTITION BY feature_id, CAST("timestamp" AS DATE) ORDER BY feature_value DESC) AS r,
                 count(*) OVER (PARTITION BY feature_id, CAST("timestamp" AS DATE)) AS n FROM fv_s),
inst1 AS (SELECT *, max(r) OVER (PARTITION BY feature_id, day) AS mr FROM inst0),
inst AS (SELECT entity_id, replace(feature_id, '_count_daily_v1', '_score') || '_v1' AS feature_id,
                replace(feature_id, '_count_daily_v1', '_score') AS feature_name, '1' AS feature_version,
                {r2(rank_score)} AS feature_value, CAST(day AS TIMESTAMP) AS "timestamp",
                CAST(NULL AS VARCHAR) AS comments FROM inst1),
risk AS (SELECT entity_id, 'risk_score_v1' AS feature_id, 'risk_score' AS feature_name, '1' AS feature_version,
                {r2(f"sum(feature_value * CASE feature_id {case} END) / {dbl(total)}")} AS feature_value,
                CAST(CAST("timestamp" AS DATE) AS TIMESTAMP) AS "timestamp", CAST(NULL AS VARCHAR) AS comments
         FROM inst WHERE feature_id IN ({', '.join(repr(k) for k in weights)})
         GROUP BY entity_id, CAST("timestamp" AS DATE)),
store AS (SELECT * FROM inst UNION ALL SELECT * FROM risk)"""
