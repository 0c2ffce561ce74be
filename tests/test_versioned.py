"""Versioned tables: replaced windows, emptied days, failed and concurrent writes, replays, pruning and vacuum."""

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.versioned import VersionedTable

SCHEMA = "entity_id string, feature_value double"


@pytest.fixture
def table(spark):
    return VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}", SCHEMA)


def rows(spark, *triples):
    return spark.createDataFrame([(f"e{i}", float(v), f, d) for i, (f, d, v) in enumerate(triples)], "entity_id string, feature_value double, feature_id string, ds string")


def held(frame):
    return sorted((r.feature_id, r.ds, r.feature_value) for r in frame.collect())


def test_empty_table(spark, table):
    assert table.version() == 0 and held(table.read()) == [] and table.manifest().count() == 0
    assert table.read().columns == ["entity_id", "feature_value", "feature_id", "ds"]


def test_window_is_replaced_whole(spark, table):
    table.replace_window(rows(spark, ("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("a", "2024-01-03", 3), ("b", "2024-01-02", 4)), ["a", "b"], "2024-01-01", "2024-01-03")
    table.replace_window(rows(spark, ("a", "2024-01-02", 9)), ["a"], dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    want = [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 9.0), ("b", "2024-01-02", 4.0)]
    assert held(table.read()) == want
    assert held(table.read(version=1))[2] == ("a", "2024-01-03", 3.0)       # a reader of the old version keeps it
    table.replace_window(rows(spark).limit(0), ["a"], "2024-01-01", "2024-01-31")
    assert held(table.read()) == [("b", "2024-01-02", 4.0)]
    assert table.version() == 3


def test_rows_outside_the_window_leave_the_table_as_it_was(spark, table):
    table.replace_window(rows(spark, ("a", "2024-01-01", 1)), ["a"], "2024-01-01", "2024-01-01")
    for bad in (("a", "2024-02-01", 1), ("b", "2024-01-01", 1)):
        with pytest.raises(ValueError):
            table.replace_window(rows(spark, bad), ["a"], "2024-01-01", "2024-01-01")
    assert table.version() == 1 and held(table.read()) == [("a", "2024-01-01", 1.0)]
    assert len(table.files.names("data")) == 1


def test_a_failed_write_shows_nothing(spark, table):
    table.append(rows(spark, ("a", "2024-01-01", 1)))
    bad = rows(spark, ("a", "2024-01-01", 0)).withColumn("feature_value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        table.replace_window(bad, ["a"], "2024-01-01", "2024-01-01")
    assert table.version() == 1 and held(table.read()) == [("a", "2024-01-01", 1.0)]


def test_replayed_source_changes_nothing(spark, table):
    table.replace_window(rows(spark, ("a", "2024-01-01", 1)), ["a"], "2024-01-01", "2024-01-01", source="batch-7")
    assert table.replace_window(rows(spark, ("a", "2024-01-01", 5)), ["a"], "2024-01-01", "2024-01-01", source="batch-7") == 1
    assert held(table.read()) == [("a", "2024-01-01", 1.0)] and table.applied("batch-7") and not table.applied("batch-8")


def test_concurrent_writers_both_land(spark, table):
    frames = {f: rows(spark, (f, "2024-01-01", i)) for i, f in enumerate("abcd")}
    threads = [threading.Thread(target=table.replace_window, args=(r, [f], "2024-01-01", "2024-01-01")) for f, r in frames.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert table.version() == 4 and [r[0] for r in held(table.read())] == list("abcd")


def test_pruning_newest_day_and_counts(spark, table):
    table.append(rows(spark, ("a", "2024-01-01", 1), ("a", "2024-01-05", 2), ("a", "2024-01-05", 3), ("b:c/d", "2024-01-09", 4)))
    assert spark.range(1).select(table.newest("a").alias("d")).first().d == "2024-01-05"
    assert {(r.feature_id, r.ds): r.n_rows for r in table.manifest().collect()}["a", "2024-01-05"] == 2
    assert held(table.read(["b:c/d"])) == [("b:c/d", "2024-01-09", 4.0)]
    plan = table.read(["a"], "2024-01-05", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ds#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vacuum_keeps_what_versions_need(spark, table):
    for v in range(3):
        table.append(rows(spark, ("a", "2024-01-01", v), ("b", "2024-01-02", v)))
    table.stage(rows(spark, ("a", "2024-01-01", 100)))          # a write that never committed
    assert table.vacuum(keep=2) == 2
    assert held(table.read()) == [("a", "2024-01-01", 2.0), ("b", "2024-01-02", 2.0)]
    assert held(table.read(version=2)) == [("a", "2024-01-01", 1.0), ("b", "2024-01-02", 1.0)]
