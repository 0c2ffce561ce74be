"""The stream's state: deltas that follow the batches, compaction by day, expiry, and views that equal the batch job's."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskweave.operators.master import latest_sync
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.derived import activity_a, activity_b
from riskweave.streaming.sync_stream import run_sync_stream, state_parts

D = dt.date(2024, 1, 30)


@pytest.fixture
def folders(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    return {k: os.path.join(root, k) for k in ("in", "state", "checkpoint")}


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_view_equals_batch_after_every_file(spark, sf_small, folders):
    events = spark.read.parquet(f"{sf_small}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(7)))
    seen = None
    for i in range(7):
        more = events.where(F.col("part") == i).drop("part")
        more.coalesce(1).write.mode("append").parquet(folders["in"])
        seen = more if seen is None else seen.unionByName(more)
        view = run_sync_stream(spark, folders["in"], folders["state"], folders["checkpoint"], D, compact_every=2)
        assert rows(view) == rows(latest_sync(activity_a(seen), activity_b(seen), D, days=30).select(view.columns))
    parts = state_parts(spark, folders["state"])
    # batches 0..6, compactions after 1, 3 and 5: the base holds up to 5, deltas of the last two compactions and of batch 6 remain
    assert [p.base.version() for p in parts] == [3, 3] and [p.base.commit_info()["notes"]["upto"] for p in parts] == [5, 5]
    assert parts[0].base.files.names("delta") == ["b=4", "b=5", "b=6"]
    # a replayed compaction changes nothing; a restart without new files gives the view as it was
    parts[0].compact(5, None)
    assert parts[0].base.version() == 3
    again = run_sync_stream(spark, folders["in"], folders["state"], folders["checkpoint"], D, compact_every=2)
    assert rows(again) == rows(latest_sync(activity_a(events), activity_b(events), D, days=30).select(again.columns))


def test_only_touched_days_are_rewritten_and_old_days_expire(spark, sf_small, folders):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    for day in (3, 20, 29):
        events.where(F.to_date("ts") == dt.date(2024, 1, day)).coalesce(1).write.mode("append").parquet(folders["in"])
        run_sync_stream(spark, folders["in"], folders["state"], folders["checkpoint"], D, compact_every=1, keep_days=12)
    base = state_parts(spark, folders["state"])[0].base
    assert sorted(r.ds for r in base.manifest().collect()) == ["2024-01-20", "2024-01-29"]
    batch = {r.ds: r.batch for r in base.manifest(2).collect()}
    assert {r.ds: r.batch for r in base.manifest(3).collect()}["2024-01-20"] == batch["2024-01-20"]
