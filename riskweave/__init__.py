"""riskweave: per-entity features, scores and entity-master jobs as Spark DataFrame plans.

Every public operator takes DataFrame(s) plus parameters (with an explicit as-of date, never the
wall clock) and returns a lazy DataFrame. Writes live only in ``plans.backfill``, ``plans.serving``
and ``operators.upsert`` callers.
"""

__all__ = ["session", "constants"]
