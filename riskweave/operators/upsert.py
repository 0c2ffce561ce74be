"""Keyed upserts into a master table without MERGE (S10-S14), compare-and-set migration (S15) and
the registry mirror (S17).

One policy per column, all evaluated on the *pre-image* of the target row (Q8 decision):

* ``overwrite``      key in source -> source value (even NULL)                      (S10)
* ``keep_old``       key in source -> coalesce(source, target)                      (S11)
* ``fill_missing``   target NULL -> source value                                   (S12)
* ``fill_sentinel``  target NULL / 'None' / 'Unknown' -> source value               (S12)
* ``("follow", c)``  filled exactly when column ``c`` is filled (code follows name) (S12)

``insert=False`` gives the matched-only update (S13). The join is one shuffle of target and source
on the key (a full outer join, or a left join for matched-only); at scale the master table is kept
bucketed by key so the target side does not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.operators.windows import latest_per_key


def upsert(target: DataFrame, source: DataFrame, key: str, policies: dict, now, touch: str = "source",
           touch_col: str = "updated_at", insert: bool = True, source_order: list[str] | None = None) -> DataFrame:
    """Several source rows of one key count as one: the largest by ``source_order`` (e.g. the time of change),
    then by the other columns in their order, so no key multiplies a master row.

    ``touch``: 'source' -> ``now`` for every key in the source; 'missing' -> ``now`` only for new
    keys and for keys where some fill column was missing; 'changed' -> ``now`` for new keys and where the value of some
    column becomes another (Q20); 'never'."""
    now_col = now if isinstance(now, Column) else F.lit(now)
    scols = [c for c in source.columns if c != key]
    order = list(source_order or [])
    source = latest_per_key(source, [key], order, scols) if scols else source.select(key).distinct()
    s = source.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in scols], F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    j = t.join(s, key, "full_outer" if insert else "left")
    in_s = F.coalesce(F.col("_in_s"), F.lit(False))
    in_t = F.coalesce(F.col("_in_t"), F.lit(False))

    def missing(c: str, sentinel: bool) -> Column:
        v = F.col(c)
        return v.isNull() | v.isin(*K.MISSING_SENTINELS) if sentinel else v.isNull()

    fill_tests = {}
    for c, pol in policies.items():
        if pol == "fill_missing":
            fill_tests[c] = missing(c, False)
        elif pol == "fill_sentinel":
            fill_tests[c] = missing(c, True)
    def value(c: str) -> Column | None:
        """The column after the upsert; None without a policy."""
        pol, sv = policies.get(c), F.col(f"_s_{c}") if c in scols else F.lit(None)
        if pol == "overwrite":
            return F.when(in_s, sv).otherwise(F.col(c))
        if pol == "keep_old":
            return F.when(in_s, F.coalesce(sv, F.col(c))).otherwise(F.col(c))
        if pol in ("fill_missing", "fill_sentinel"):
            return F.when(in_s & (~in_t | fill_tests[c]), sv).otherwise(F.col(c))
        if isinstance(pol, tuple) and pol[0] == "follow":
            return F.when(in_s & (~in_t | fill_tests[pol[1]]), sv).otherwise(F.col(c))
        return None

    out = []
    for c in target.columns:
        if c == key:
            out.append(F.col(key))
        elif c == touch_col and touch != "never":
            if touch == "source":
                cond = in_s
            elif touch == "changed":
                cond = in_s & ~in_t
                for other in target.columns:
                    after = value(other) if other not in (key, touch_col) else None
                    if after is not None:
                        cond = cond | (in_s & ~after.eqNullSafe(F.col(other)))
            else:
                any_missing = None
                for test in fill_tests.values():
                    any_missing = test if any_missing is None else (any_missing | test)
                cond = in_s & (~in_t | F.coalesce(any_missing, F.lit(False)))
            out.append(F.when(cond, now_col).otherwise(F.col(c)).alias(c))
        else:
            after = value(c)
            out.append(F.col(c) if after is None else after.alias(c))
    return j.select(*out)


def advance_watermark(registry: DataFrame, key: str, col: str, new_marks: DataFrame) -> DataFrame:
    """Monotone high-water mark -- moves only when NULL or older (``greatest`` skips NULL)."""
    n = new_marks.select(F.col(key), F.col(col).alias("_new"))
    return registry.join(n, key, "left").select(
        *[F.greatest(F.col(c), F.col("_new")).alias(c) if c == col else F.col(c) for c in registry.columns])


def compare_and_set(registry: DataFrame, migrations: DataFrame, key: str = "feature_id",
                    col: str = "dependent_features", apply: bool = False, force: bool = False) -> DataFrame:
    """Per migration row (key, expected_old, new): 'skip_not_found' | 'skip_mismatch' (trimmed
    current != trimmed expected, unless forced) | 'dry_run' | 'applied', with the resulting value."""
    cur = registry.select(F.col(key), F.col(col).alias("current"), F.lit(True).alias("_found"))
    j = migrations.join(cur, key, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    matches = F.coalesce(F.trim(F.col("current")) == F.trim(F.col("expected_old")), F.lit(False))
    outcome = (F.when(~found, F.lit("skip_not_found"))
                .when(~matches & F.lit(not force), F.lit("skip_mismatch"))
                .when(F.lit(not apply), F.lit("dry_run"))
                .otherwise(F.lit("applied")))
    return j.select(key, outcome.alias("outcome"), "current",
                    F.when(outcome == F.lit("applied"), F.col("new")).otherwise(F.col("current")).alias("final_value"))


def registry_mirror(registry: DataFrame, now) -> DataFrame:
    """The mirror's 18 columns: NULL flags -> 0, list -> JSON text, timestamps as 'yyyy-MM-dd HH:mm:ss' with ``now``
    for NULL (an explicit as-of, never the wall clock), an empty category; columns the registry lacks are NULL."""
    now_col = now if isinstance(now, Column) else F.lit(now)
    fmt = "yyyy-MM-dd HH:mm:ss"
    dep = registry.schema["dependent_features"].dataType
    dep_col = F.to_json("dependent_features") if dep.typeName() == "array" else F.col("dependent_features")

    def own(name: str, out: str | None = None) -> Column:
        return (F.col(name) if name in registry.columns else F.lit(None)).cast("string").alias(out or name)

    def time(name: str) -> Column:
        given = F.col(name) if name in registry.columns else F.lit(None).cast("timestamp_ntz")
        return F.date_format(F.coalesce(given, now_col), fmt).alias(name)

    return registry.select(
        own("feature_id", "id"), own("feature_name", "name"), own("description"), own("data_type"), own("status"),
        F.coalesce(F.col("is_active").cast("int"), F.lit(0)).alias("is_active"), F.coalesce(F.col("is_risk").cast("int"), F.lit(0)).alias("is_risk"),
        own("version"), own("update_window"), own("source_table"), own("destination_table"), own("query", "source_query"),
        dep_col.alias("dependent_features"), F.lit("").alias("category"), time("created_at"), own("created_by"), time("updated_at"), own("updated_by"))
