"""Multi-date plans equal the union of single-date runs; a resumed stream only adds new batches."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskweave.functions.columns import r6
from riskweave.operators import category as cat
from riskweave.operators import instance as inst
from riskweave.operators.combine import combine_features
from riskweave.operators.windows import DateSpan
from riskweave.sources.feature_values import daily_event_features
from riskweave.sources.score_store import score_store
from riskweave.sources.tables import read_table

SPAN = DateSpan(dt.date(2024, 1, 26), dt.date(2024, 1, 29))


def _rows(df, value):
    return sorted((str(r["target_date"]), r["entity_id"], r[value]) for r in
                  df.select("target_date", "entity_id", r6(value).alias(value)).collect())


def _span_equals_days(build, value):
    got = _rows(build(SPAN), value)
    exp = []
    for d in SPAN.days():
        exp += _rows(build(d), value)
    assert got == sorted(exp)


@pytest.fixture(scope="module")
def fvs(spark, sf_small):
    ev = read_table(spark, sf_small, "events")
    return (daily_event_features(ev, include_any=True), daily_event_features(ev, measure="value"), score_store(ev))


@pytest.mark.parametrize("method", ["rank", "rank_snapshot", "zscore", "winsor", "log", "wilson", "decay", "combine"])
def test_span_equals_single_days(fvs, method):
    counts, values, _ = fvs
    builders = {
        "rank": lambda t: inst.rank_scoring(counts, "click_count_daily_v1", t, require_aggregation=True),
        "rank_snapshot": lambda t: inst.rank_scoring(counts, "signup_count_daily_v1", t),
        "zscore": lambda t: inst.zscore(values, "purchase_value_daily_v1", t, require_aggregation=True),
        "winsor": lambda t: inst.winsorized_zscoring(values, "view_value_daily_v1", t),
        "log": lambda t: inst.log_based_scoring(counts, "error_count_daily_v1", t),
        "wilson": lambda t: inst.wilson_fraud_scoring(counts, "error_count_daily_v1", "any_count_daily_v1", t),
        "decay": lambda t: inst.exponential_decay_scoring(values, "purchase_value_daily_v1", t, 7),
        "combine": lambda t: combine_features(counts, ["click_count_daily_v1", "view_count_daily_v1"], t, 5, "average"),
    }
    _span_equals_days(builders[method], "final_value" if method == "combine" else "score")


def test_category_span_equals_single_days(fvs):
    _, _, store = fvs
    w = {"error_score_v1": 2.0, "view_score_v1": 1.0}
    got = _rows(cat.softmax_scoring(store, SPAN, w), "risk_value")
    exp = []
    for d in SPAN.days():
        exp += _rows(cat.softmax_scoring(store, d, w).withColumn("target_date", F.lit(d)), "risk_value")
    assert got == sorted(exp)


def test_stream_resume_processes_only_new_files(spark, sf_small):
    from riskweave.operators.master import latest_sync
    from riskweave.sources.derived import activity_a, activity_b
    from riskweave.streaming.sync_stream import run_sync_stream
    ev = read_table(spark, sf_small, "events")
    root = tempfile.mkdtemp(prefix="riskweave-resume-")
    src, state, ckpt = (os.path.join(root, x) for x in ("src", "state", "ckpt"))
    early = ev.where(F.dayofmonth("ts") <= 15)
    early.coalesce(1).write.mode("append").parquet(src)
    run_sync_stream(spark, src, state, ckpt, dt.date(2024, 1, 30))
    ev.where(F.dayofmonth("ts") > 15).coalesce(1).write.mode("append").parquet(src)
    got = run_sync_stream(spark, src, state, ckpt, dt.date(2024, 1, 30))      # restart from the checkpoint
    exp = latest_sync(activity_a(ev), activity_b(ev), dt.date(2024, 1, 30))
    assert sorted(got.collect()) == sorted(exp.collect())
