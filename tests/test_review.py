"""Behaviour found wrong in review: repeated source keys, stream restarts, readers that disagreed."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskweave.functions.params import flag, number
from riskweave.operators import category as cat
from riskweave.operators.master import latest_sync
from riskweave.operators.upsert import upsert
from riskweave.operators.windows import DateSpan
from riskweave.plans.backfill import backfill_from_registry, render_cumulative_day
from riskweave.sources.derived import activity_a, activity_b
from riskweave.sources.tables import read_table
from riskweave.streaming.sync_stream import run_sync_stream

D = dt.date(2024, 1, 30)
FV = "entity_id string, feature_id string, feature_value double, timestamp timestamp_ntz"


def at(day: dt.date, hour: int = 0) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour))


def test_repeated_source_keys_make_one_master_row(spark):
    tgt = spark.createDataFrame([("1", "old", None)], "id string, name string, updated_at string")
    src = spark.createDataFrame([("1", "z", 1), ("1", "a", 2), ("2", "b", 1), ("2", "b", 1)], "id string, name string, seq int")
    got = sorted(tuple(r) for r in upsert(tgt, src, "id", {"name": "overwrite"}, F.lit("now"), source_order=["seq"]).collect())
    assert got == [("1", "a", "now"), ("2", "b", "now")]
    got = sorted(tuple(r) for r in upsert(tgt, src, "id", {"name": "overwrite"}, F.lit("now")).collect())
    assert got == [("1", "z", "now"), ("2", "b", "now")]                     # without an order, by the columns
    only = upsert(tgt, src.select("id"), "id", {}, F.lit("now"), insert=False)
    assert [tuple(r) for r in only.collect()] == [("1", "old", "now")]


def test_stream_restart_without_files_and_with_a_moved_date(spark, sf_small):
    ev = read_table(spark, sf_small, "events")
    root = tempfile.mkdtemp(prefix="riskweave-restart-")
    src, state, ckpt = (os.path.join(root, x) for x in ("src", "state", "ckpt"))
    ev.repartition(3).write.parquet(src)
    run_sync_stream(spark, src, state, ckpt, dt.date(2024, 1, 25))
    for as_of, days in ((dt.date(2024, 1, 25), 30), (D, 1)):                  # no new file since
        got = run_sync_stream(spark, src, state, ckpt, as_of, days)
        exp = latest_sync(activity_a(ev), activity_b(ev), as_of, days).select(got.columns)
        assert sorted(got.collect()) == sorted(exp.collect())


def test_stream_before_the_first_file_is_empty(spark):
    root = tempfile.mkdtemp(prefix="riskweave-nofile-")
    os.mkdir(os.path.join(root, "src"))
    got = run_sync_stream(spark, *(os.path.join(root, x) for x in ("src", "state", "ckpt")), D)
    assert got.count() == 0


def test_category_scores_agree_for_one_date_and_a_span(spark):
    nan = float("nan")
    rows = [("a", "x", 0.5, at(D)), ("a", "y", nan, at(D)), (None, "x", 4.0, at(D)), ("b", "x", None, at(D)), ("c", "y", 0.25, at(D, 5)),
            ("c", "y", 0.75, at(D, 5))]
    scores = spark.createDataFrame(rows, FV)
    span = DateSpan(D - dt.timedelta(days=1), D)
    for method in (cat.softmax_scoring, cat.weighted_average, cat.max_scoring):
        one = sorted(tuple(r) for r in method(scores, D, {"x": 1.0, "y": 1.0}).collect())
        many = sorted(tuple(r)[1:] for r in method(scores, span, {"x": 1.0, "y": 1.0}).where(F.col("target_date") == F.lit(D)).collect())
        assert one == many and [r[0] for r in one] == ["a", "c"]
    assert one == [("a", 0.5), ("c", 0.75)]


def test_cumulative_day_counts_a_missing_value_as_zero(spark):
    daily = spark.createDataFrame([("a", "d", None, at(D)), ("b", "d", 2.0, at(D))], FV)
    store = spark.createDataFrame([("a", "c", 5.0, at(D - dt.timedelta(days=1)))], FV)
    got = {r.entity_id: r.feature_value for r in render_cumulative_day(spark, daily, store, "d", "c", D).collect()}
    assert got == {"a": 5.0, "b": 2.0}


def test_registry_rows_are_not_dropped_silently(spark):
    kinds = "feature_id string, feature_name string, version string, dependent_features string"
    fv = spark.createDataFrame([], FV)
    for text in ("[scoring_function:max_scoring, risk_weightage:{a:1}]", "[feature_id:x]"):
        with pytest.raises(ValueError):
            backfill_from_registry(spark.createDataFrame([("f_v1", "f", "1", text)], kinds), fv, None, D)


def test_parameters():
    assert [number(x, 7.0) for x in (3, "2.5", " -1e2 ", "x", None, "", [1])] == [3.0, 2.5, -100.0, 7.0, 7.0, 7.0, 7.0]
    assert [flag(x) for x in (True, False, "True", " true", "yes", None)] == [True, False, True, True, False, False]
    assert flag(None, True)
