"""The entity master refreshed end to end (M11, M12, M14-M16, activeness), incrementally.

Each step is one source frame with a policy for each of its columns (``operators.upsert``). ``updated_at`` moves only where a
value changes (Q20), so a second run over the same inputs changes no row, and ``changed_rows`` tells a writer whether
there is anything to write and which rows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.operators.upsert import upsert


@dataclass
class Step:
    """One source of the master: its rows (with the key), the policy of each column, and whether it brings new entities."""

    source: DataFrame
    policies: dict
    insert: bool = True
    order: list[str] | None = None


def users_to_refresh(users: DataFrame, master: DataFrame, as_of: _dt.date, days: int = 7, updated: str = "last_updated_date",
                     user: str = "user_code", key: str = "id", office: str = "ro", custom_ids: DataFrame | None = None) -> DataFrame:
    """M16's input: users changed in the last ``days`` days and the partial current one, and those whose office the master does not
    know (``Unknown``, P10), in one pass. With ``custom_ids`` (a frame of keys) these users alone, however old."""
    own = F.upper(F.col(user))
    if custom_ids is not None:
        return users.join(custom_ids.select(F.upper(F.col(key)).alias("asked")).distinct(), own == F.col("asked"), "left_semi")
    unknown = master.where(F.col(office) == F.lit(K.MISSING_SENTINELS[-1])).select(F.upper(F.trim(F.col(key))).alias("unresolved")).distinct()
    marked = users.join(unknown, own == F.col("unresolved"), "left")
    recent = F.coalesce(F.col(updated) >= F.lit(as_of - _dt.timedelta(days=days)), F.lit(False))
    return marked.where(recent | F.col("unresolved").isNotNull()).select(*users.columns)


def refresh_master(master: DataFrame, steps: list[Step], now: Column, key: str = "id", touch: str = "updated_at") -> DataFrame:
    """The master after all steps, in order, each on what the one before left."""
    out = master
    for step in steps:
        source = step.source.where(F.col(key).isNotNull())
        out = upsert(out, source, key, step.policies, now, touch="changed", touch_col=touch, insert=step.insert, source_order=step.order)
    return out


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``after`` that ``before`` does not have: compared by a hash of all columns, one join on (key, hash)."""
    columns = [c for c in after.columns if c != key]

    def hashed(frame: DataFrame) -> DataFrame:
        # a NULL hashes like nothing, so each column says whether it is there
        parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
        return frame.withColumn("row_hash", F.xxhash64(*parts)).withColumn("row_check", F.sha2(F.to_json(F.struct(*columns)), 256))

    old = hashed(before.select(*after.columns)).select(key, "row_hash", "row_check")
    return hashed(after).join(old, [key, "row_hash", "row_check"], "left_anti").select(*after.columns)
