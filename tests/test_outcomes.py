"""Grouped dispatch against the methods one by one, and backfill runs whose features fail, are skipped, resumed and replaced."""

import datetime as dt
import math
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from riskweave.operators.category import CATEGORY_METHODS
from riskweave.operators.instance import INSTANCE_METHODS
from riskweave.operators.windows import DateSpan
from riskweave.plans import dispatch, outcomes
from riskweave.plans.backfill import backfill_from_registry, score_table
from riskweave.session import ensure_checkpoint_dir

RNG = random.Random(4)
SPAN = DateSpan(dt.date(2024, 1, 28), dt.date(2024, 1, 30))
REGISTRY = "feature_id string, feature_name string, version string, dependent_features string"


@pytest.fixture(scope="module")
def fv(spark):
    rows = []
    for e in range(25):
        for f in ("a_v1", "b_v1", "c_v1"):
            for d in range(40):
                if RNG.random() < 0.4:
                    value = RNG.choice([None, float("nan"), 0.0, -2.0, 1.0, 1.0, 3.0, RNG.random() * 10])
                    rows.append((f"e{e}" if RNG.random() < 0.95 else None, f, value, dt.datetime(2023, 12, 22) + dt.timedelta(days=d, hours=RNG.randint(0, 23))))
    return spark.createDataFrame(rows, "entity_id string, feature_id string, feature_value double, timestamp timestamp_ntz").cache()


CASES = [
    ("rank_scoring", {"feature_id": "a_v1", "require_aggregation": "True"}), ("rank_scoring", {"feature_id": "b_v1", "is_inverse": True, "range_start": 0.5}),
    ("rank_scoring", {"feature_id": "a_v1", "require_aggregation": True, "apply_threshold": "true", "threshold": "2.5"}),
    ("rank_scoring", {"feature_id": ["a_v1", "b_v1"], "method": "weighted_average", "weights": {"a_v1": 2, "b_v1": "1.5"}}),
    ("zscore", {"feature_id": "a_v1", "require_aggregation": True, "period_in_days": 20}), ("zscore", {"feature_id": "b_v1"}),
    *[("zscore", {"feature_id": ["a_v1", "b_v1", "c_v1"], "is_multiple_col": True, "require_aggregation": True, "aggregation_method": m, "period_in_days": 5,
                  "weights": {"a_v1": 1, "b_v1": 2, "c_v1": 3}}) for m in ("max", "MIN", "average", "sum", "weighted_average")],
    ("winsorized_zscoring", {"feature_id": "a_v1", "winsorize_percentile": 0.8}),
    ("winsorized_zscoring", {"feature_id": ["a_v1", "c_v1"], "is_multiple_col": True, "aggregation_method": "average", "period_in_days": 9}),
    ("log_based_scoring", {"feature_id": "a_v1", "threshold": 1}), ("wilson_fraud_scoring", {"feature_id_numerator": "a_v1", "feature_id_denominator": "b_v1"}),
    ("exponential_decay_scoring", {"feature_id": "c_v1", "period_in_days": 10, "decay_rate": 0.3}),
    ("exponential_decay_scoring", {"feature_id": "a_v1", "period_in_days": 10, "time_unit": "hours", "decay_rate": 0.01}),
]


def values(frame, key):
    return {(str(r.target_date), r.entity_id): None if r[key] is None or math.isnan(r[key]) else round(r[key], 9) for r in frame.collect()}


@pytest.mark.parametrize("method, params", CASES)
def test_grouped_equals_single(spark, fv, method, params):
    """A group of the case and of one more feature with other sources gives what the method gives alone."""
    spec = dispatch.spec_of("x_v1", "x", 1, {"scoring_method": method, **params})
    assert spec.problem is None
    other = dispatch.spec_of("y_v1", "y", 1, {"scoring_method": method, **{k: "c_v1" if k == "feature_id" and v != "c_v1" and isinstance(v, str) else v for k, v in params.items()}})
    group = dispatch.groups_of([spec, other])[0]
    assert len(group) == 2
    got = dispatch.score_group(group, fv, None, SPAN)
    single = values(INSTANCE_METHODS[method](fv, targets=SPAN, **params), "score")
    assert values(got.where("out_id = 'x_v1'"), "score") == single and len(single) > 20
    assert got.where("out_id = 'y_v1'").count() > 0


@pytest.mark.parametrize("method", list(CATEGORY_METHODS))
def test_grouped_categories_equal_single(spark, fv, method):
    weights = {"a_v1": 2, "b_v1": 1.5, "z_v1": 1}
    specs = [dispatch.spec_of(f"{n}_v1", n, 1, {"scoring_function": method, "risk_weightage": w}) for n, w in (("x", weights), ("y", {"c_v1": 3}))]
    got = dispatch.score_group(dispatch.groups_of(specs)[0], fv, fv, SPAN)
    assert values(got.where("out_id = 'x_v1'"), "score") == values(CATEGORY_METHODS[method](fv, SPAN, weights), "risk_value")


def test_problems_are_kept():
    say = lambda **p: dispatch.spec_of("f", "f", 1, p).problem
    assert "unknown scoring_method 'nope'" in say(scoring_method="nope")
    assert "weights" in say(scoring_method="rank_scoring", feature_id=["a", "b"])
    assert "zero" in say(scoring_method="rank_scoring", feature_id=["a"], method="weighted_average", weights={"a": 0})
    assert "outside" in say(scoring_function="softmax_scoring", risk_weightage={"a": 1}, softmax_weightage=2)
    assert say(scoring_method="wilson_fraud_scoring", feature_id_numerator="a") == "no source feature is named"
    assert dispatch.spec_of("f", "f", 1, {"feature_id": "a"}).skip


def test_three_hundred_features_plan_in_seconds(spark, fv):
    rows = [(f"s{i}_v1", f"s{i}", "1", f"[scoring_method:{m}, feature_id:{f}_v1{more}]") for i in range(300)
            for m, more in [(("rank_scoring", ", require_aggregation:True"), ("log_based_scoring", ""), ("zscore", ""))[i % 3]] for f in ["abc"[i % 3]]]
    began = time.time()
    out = backfill_from_registry(spark.createDataFrame(rows, REGISTRY), fv, None, SPAN)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 30
    assert out.select("feature_id").distinct().count() == 300


def tables(spark):
    root = f"{ensure_checkpoint_dir(spark)}/outcomes-{uuid.uuid4().hex}"
    return score_table(spark, f"{root}/scores"), outcomes.Ledger(spark, f"{root}/ledger")


def shown(frame):
    return {(r.feature_id, str(r.target_date)[-2:]): r.outcome for r in frame.collect()}


def test_run_isolates_failures_and_resumes(spark, fv):
    broken = fv.where("feature_id = 'c_v1'").withColumn("feature_id", F.lit("poison_v1")).withColumn(
        "feature_value", F.raise_error(F.lit("bad cell")).cast("double"))
    rows = [("ok_v1", "ok", "1", "[scoring_method:log_based_scoring, feature_id:a_v1]"), ("ok2_v1", "ok2", "1", "[scoring_method:log_based_scoring, feature_id:b_v1]"),
            ("bad_v1", "bad", "1", "[scoring_method:log_based_scoring, feature_id:poison_v1]"), ("none_v1", "none", "1", "[scoring_method:log_based_scoring, feature_id:absent_v1]"),
            ("odd_v1", "odd", "1", "[scoring_method:magic, feature_id:a_v1]"), ("plain_v1", "plain", "1", "[note:x]")]
    registry = spark.createDataFrame(rows, REGISTRY)
    table, ledger = tables(spark)
    day = dt.date(2024, 1, 30)
    dry = shown(outcomes.run_backfill(registry, fv, table, day, ledger, "dry", dry_run=True))
    assert dry["ok_v1", "30"] == "DRYRUN" and dry["odd_v1", "30"] == "FAIL" and table.version() == 0
    first = outcomes.run_backfill(registry, fv.unionByName(broken), table, day, ledger, "r1",
                                  requested=spark.createDataFrame([(r[1], "1") for r in rows] + [("ghost", "9")], "feature_name string, version string"))
    assert shown(first) == {("ok_v1", "30"): "OK", ("ok2_v1", "30"): "OK", ("bad_v1", "30"): "FAIL", ("none_v1", "30"): "EMPTY",
                            ("odd_v1", "30"): "FAIL", ("plain_v1", "30"): "SKIP", ("ghost_v9", "30"): "SKIP"}
    reasons = {r.feature_id: r.reason for r in first.collect()}
    assert "bad cell" in reasons["bad_v1"] and "magic" in reasons["odd_v1"] and reasons["ghost_v9"] == "not found in registry"
    written = {r.feature_id: r.rows_written for r in first.collect()}
    assert written["ok_v1"] == table.read(["ok_v1"]).count() > 0
    # the same run again, its source mended: what failed is tried again, what was done is left out
    version = table.version()
    mended = fv.unionByName(fv.where("feature_id = 'c_v1'").withColumn("feature_id", F.lit("poison_v1")))
    again = shown(outcomes.run_backfill(registry, mended, table, day, ledger, "r1"))
    assert again["bad_v1", "30"] == "OK" and again["ok_v1", "30"] == "OK" and table.version() == version + 1
    # another run skips rows that exist, unless forced
    assert shown(outcomes.run_backfill(registry, mended, table, day, ledger, "r2"))["ok_v1", "30"] == "SKIP"
    forced = outcomes.run_backfill(registry, mended, table, day, ledger, "r3", force=True)
    assert shown(forced)["ok_v1", "30"] == "OK" and shown(forced)["none_v1", "30"] == "EMPTY"
    assert {r.outcome: r.n_jobs for r in outcomes.summary(forced).collect()} == {"OK": 3, "EMPTY": 1, "FAIL": 1, "SKIP": 1}


def test_forced_run_keeps_other_days_and_features(spark, fv):
    table, ledger = tables(spark)
    registry = spark.createDataFrame([("ok_v1", "ok", "1", "[scoring_method:rank_scoring, feature_id:a_v1, require_aggregation:True]")], REGISTRY)
    outcomes.run_backfill(registry, fv, table, SPAN, ledger, "r1")
    before = {(r.entity_id, r.ds): r.feature_value for r in table.read().collect()}
    outcomes.run_backfill(registry, fv, table, dt.date(2024, 1, 29), ledger, "r2", force=True)
    assert {(r.entity_id, r.ds): r.feature_value for r in table.read().collect()} == before
    assert len({d for _, d in before}) == 3
