"""Hand-built edge rows for the scoring, master, upsert, status and registry operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.functions.columns import dms_to_decimal, infer_category, parse_bool, sanitize_run_id, to_float
from riskweave.operators import category as cat
from riskweave.operators import instance as inst
from riskweave.operators import quality as q
from riskweave.operators.combine import combine_features
from riskweave.operators.cumulative import cumulative_feature
from riskweave.operators.master import risk_buckets, top_anomaly
from riskweave.operators.upsert import compare_and_set, upsert
from riskweave.sources.feature_values import load_feature_values, load_feature_values_asof

D = dt.date(2024, 3, 31)
FV = "entity_id string, feature_id string, feature_value double, timestamp timestamp_ntz"


def ts(d, h=12):
    return dt.datetime.combine(d, dt.time(h))


def fv(spark, rows):
    return spark.createDataFrame(rows, FV)


def by_entity(df, col="score"):
    return {r.entity_id: getattr(r, col) for r in df.collect()}


def test_window_edges_are_closed(spark):
    days = [0, 30, 31, 365, 366, -1]
    rows = [(f"e{n}", "f", 1.0, ts(D - dt.timedelta(days=n))) for n in days]
    got = {r.entity_id for r in load_feature_values(fv(spark, rows), ["f"], D - dt.timedelta(days=30), D).collect()}
    assert got == {"e0", "e30"}


def test_latest_skips_null_values(spark):
    rows = [("a", "f", 1.0, ts(D, 1)), ("a", "f", None, ts(D, 5)), ("b", "f", 2.0, ts(D + dt.timedelta(days=1)))]
    df = fv(spark, rows).withColumn("feature_name", F.lit("f"))
    got = {r.entity_id: r.feature_value for r in load_feature_values_asof(df, ["f"], D).collect()}
    assert got == {"a": 1.0}


def test_combine_corner_cases(spark):
    rows = [("a", "x", -2.0, ts(D)), ("a", "x", -4.0, ts(D)), ("b", "y", 5.0, ts(D)), ("n", "x", None, ts(D))]
    df = fv(spark, rows)
    s = by_entity(combine_features(df, ["x", "y"], D, 3, "sum"), "final_value")
    assert s == {"a": -6.0, "b": 5.0, "n": 0.0}                     # all-NULL entity scores 0 under SUM
    m = by_entity(combine_features(df, ["x", "y"], D, 3, "max"), "final_value")
    assert m == {"a": 0.0, "b": 5.0}                                # zero fill beats negatives; NULL entity gone
    avg = by_entity(combine_features(df, ["x", "y"], D, 3, "average", compat=True), "final_value")
    assert avg["a"] == pytest.approx(-3.0 / 2) and avg["b"] == 5.0  # sum of means / row count
    mean = by_entity(combine_features(df, ["x", "y"], D, 3, "average"), "final_value")
    assert mean == {"a": -3.0, "b": 5.0}                            # mean of all values; NULL entity gone
    with pytest.raises(ZeroDivisionError):
        combine_features(df, ["x", "y"], D, 3, "weighted_average", {"x": 0, "y": 0})


def test_zscore_constant_and_wilson(spark):
    rows = [(e, "c", 3.0, ts(D)) for e in "abc"]
    z = by_entity(inst.zscore(fv(spark, rows), "c", D, require_aggregation=True))
    assert set(z.values()) == {0.0}
    w = [("a", "u", 0.0, ts(D)), ("a", "n", 10.0, ts(D)), ("b", "u", 10.0, ts(D)), ("b", "n", 10.0, ts(D)),
         ("c", "u", 12.0, ts(D)), ("c", "n", 10.0, ts(D)), ("d", "u", 1.0, ts(D)), ("e", "n", 0.0, ts(D)), ("e", "u", 0.0, ts(D))]
    got = by_entity(inst.wilson_fraud_scoring(fv(spark, w), "u", "n", D))
    assert got["a"] == 0.0 and 0 < got["b"] < 1 and got["c"] is None and "d" not in got and "e" not in got


def test_decay_all_equal_and_log(spark):
    rows = [(e, "c", 2.0, ts(D, 3)) for e in "ab"]
    assert set(by_entity(inst.exponential_decay_scoring(fv(spark, rows), "c", D, 7)).values()) == {0.5}
    rows = [("a", "c", 0.0, ts(D)), ("b", "c", 3.0, ts(D)), ("c", "c", 9.0, ts(D))]
    got = by_entity(inst.log_based_scoring(fv(spark, rows), "c", D))
    assert "a" not in got and got["c"] == pytest.approx(1.0)


def test_softmax_alpha_checks(spark):
    df = fv(spark, [("a", "x", 0.5, ts(D))]).withColumn("feature_name", F.lit("x"))
    with pytest.raises(ValueError):
        cat.softmax_scoring(df, D, {"x": 1.0}, softmax_weightage=1.1)
    with pytest.raises(ValueError):
        cat.softmax_scoring(df, D, {})
    v = cat.softmax_scoring(df, D, {"x": 1.0, "y": 1.0}, softmax_weightage=0.0).first().risk_value
    assert v == pytest.approx(0.25)                                  # weight normalised over all configured features


def test_risk_bucket_boundaries(spark):
    vals = [0.95, 0.9] + [0.5 - i * 0.004 for i in range(100)] + [0.005]
    rows = [(f"e{i}", "r", v, ts(D)) for i, v in enumerate(vals)]
    got = {r.entity_id: r.risk_bucket for r in risk_buckets(fv(spark, rows), "r").collect()}
    assert got["e0"] == "Critical" and got["e1"] == "High"         # exactly 0.9 is General
    assert got[f"e{len(vals) - 1}"] == "No"
    assert list(got.values()).count("Medium") == 19


def test_top_anomaly_tie_goes_to_first_code(spark):
    rows = [("a", "risk_score", 0.4), ("a", "x_score", 0.7), ("a", "y_score", 0.7), ("b", "y_score", 0.2), ("c", "x_score", None)]
    df = spark.createDataFrame([(e, n, v, ts(D)) for e, n, v in rows], "entity_id string, feature_name string, feature_value double, timestamp timestamp_ntz")
    store = spark.createDataFrame([("A", "ro", "d", "s"), ("B", None, "d", "s")], "opt_id string, opt_ro string, opt_district string, opt_state string")
    got = {r.opt_id: (r.anomaly_code_with_highest_score, r.risk_score) for r in top_anomaly(df, ["x", "y"], D, store).collect()}
    assert got == {"A": ("x", 0.4), "B": ("y", None)}


def test_cumulative_gap_and_seed(spark):
    rows = [("a", "d", 1.0, ts(D - dt.timedelta(days=3))), ("a", "d", 2.0, ts(D - dt.timedelta(days=1))), ("b", "d", 5.0, ts(D))]
    seed = fv(spark, [("a", "c", 10.0, ts(D - dt.timedelta(days=9)))])
    got = {(r.entity_id, r.day): r.feature_value for r in cumulative_feature(fv(spark, rows), "d", D - dt.timedelta(days=5), D, seed, "c").collect()}
    assert got == {("a", D - dt.timedelta(days=3)): 11.0, ("a", D - dt.timedelta(days=1)): 13.0, ("b", D): 5.0}


def test_dms_parsing(spark):
    cases = {"16°32'26.9604\" N": 16 + 32 / 60 + 26.9604 / 3600, "81°31'30\" W": -(81 + 31 / 60 + 30 / 3600),
             "12.5": 12.5, "n/a": None, "": None, "nan": None, "7 8 9 s": -(7 + 8 / 60 + 9 / 3600)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.v for r in df.select("s", dms_to_decimal("s").alias("v")).collect()}
    for k, v in cases.items():
        assert got[k] == (pytest.approx(v) if v is not None else None), k


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("run 1/ü-x", "work_a", " Yes ", "1.5"), ("r", "risk_score", None, "abc")],
                               "r string, k string, b string, f string")
    got = df.select(sanitize_run_id("r").alias("r"), infer_category("k").alias("c"), parse_bool("b").alias("b"),
                    to_float("f").alias("f")).collect()
    assert tuple(got[0]) == ("run_1_ü-x", "work", True, 1.5)
    assert tuple(got[1]) == ("r", None, False, 0.0)


def test_upsert_fill_missing_uses_pre_image(spark):
    tgt = spark.createDataFrame([("1", None, "None", "old", None)], "id string, name string, reg string, reg_code string, updated_at string")
    src = spark.createDataFrame([("1", "n", "R", "RC"), ("2", "m", "S", "SC")], "id string, name string, reg string, reg_code string")
    got = {r.id: r for r in upsert(tgt, src, "id", {"name": "fill_missing", "reg": "fill_sentinel", "reg_code": ("follow", "reg")},
                                   F.lit("now"), touch="missing").collect()}
    assert (got["1"].name, got["1"].reg, got["1"].reg_code, got["1"].updated_at) == ("n", "R", "RC", "now")
    assert got["2"].reg_code == "SC"


def test_compare_and_set_outcomes(spark):
    reg = spark.createDataFrame([("a", "[x:1]"), ("b", "[y:2]")], "feature_id string, dependent_features string")
    mig = spark.createDataFrame([("a", " [x:1] ", "[x:9]"), ("b", "[nope]", "[y:9]"), ("z", "", "")], "feature_id string, expected_old string, new string")
    got = {r.feature_id: (r.outcome, r.final_value) for r in compare_and_set(reg, mig, apply=False).collect()}
    assert got == {"a": ("dry_run", "[x:1]"), "b": ("skip_mismatch", "[y:2]"), "z": ("skip_not_found", None)}
    got = {r.feature_id: r.outcome for r in compare_and_set(reg, mig, apply=True, force=True).collect()}
    assert got == {"a": "applied", "b": "applied", "z": "skip_not_found"}


def test_category_verdict_rules(spark):
    rows = [("r", "all_skipped", "skipped", "daily"), ("r", "hourly_only", "success", "hourly"),
            ("r", "missing_status", None, "daily"), ("r", "missing_status", "success", None),
            ("r", "good", "success", "daily"), ("r", "good", "skipped", "daily")]
    df = spark.createDataFrame(rows, "run_id string, category string, status string, cadence string")
    got = {r.category: r.valid for r in q.category_verdicts(df).collect()}
    assert got == {"all_skipped": False, "hourly_only": False, "missing_status": False, "good": True}


def test_registry_parse(spark, sf_small):
    from riskweave.plans.catalog2 import _ids_with_any, registry_texts
    from riskweave.sources.registry import parse_dependent_features
    rows = {(r.feature_id, r.param): (r.kind, r.value_text, r.list_value, r.map_value)
            for r in parse_dependent_features(registry_texts(_ids_with_any(spark, sf_small))).collect()}
    assert rows[("click_count_daily_v1", "range_start")] == ("text", "0.5", None, None)
    assert rows[("click_count_daily_v1", "require_aggregation")][0] == "bool"
    assert rows[("purchase_count_daily_v1", "feature_id")][2] == ["purchase_count_daily_v1", "click_count_daily_v1"]
    assert rows[("purchase_count_daily_v1", "weights")][3] == {"purchase_count_daily_v1": "2", "click_count_daily_v1": "3"}
    assert rows[("signup_count_daily_v1", "risk_weightage")][3] == {"a": "1", "b": "2.5"}
    assert rows[("view_count_daily_v1", "filter_condition")][1] == "x in (1"
    assert rows[("view_count_daily_v1", "feature_ids")][2] == ["a", "b"]          # a list last keeps its bracket
    assert rows[("error_count_daily_v1", "period_in_days")][:2] == ("int", "30")
    assert not [k for k in rows if k[0] == "any_count_daily_v1"]                   # empty text -> no params


def test_write_scores_counts_dropped_and_replaces(spark):
    from riskweave.plans.backfill import score_table, scratch_table_path, write_scores
    scores = spark.createDataFrame([(D, "a", 0.123), (D, "b", None), (D, "c", float("nan")), (D, "d", 0.995)],
                                   "target_date date, entity_id string, score double")
    table = score_table(spark, scratch_table_path(spark, "t"))
    s1 = write_scores(scores, table, "f_v1", "f", 1)
    s2 = write_scores(scores, table, "f_v1", "f", 1)
    assert s1 == s2 == {"feature_id": "f_v1", "rows_written": 2, "rows_dropped": 2}
    got = {r.entity_id: r.feature_value for r in table.read().collect()}
    assert got == {"a": 0.12, "d": 1.0}                     # rounded to 2 decimals, slice replaced not appended


def test_cumulative_day_category_window_and_filter(spark):
    """S18 with P5/P6: work reads D's daily value, bio reads D-1's; a registry predicate filters the
    daily input; the prior cumulative value (< D) is added; the stamp is D 23:59:59."""
    from riskweave.plans.backfill import render_cumulative_day
    daily = fv(spark, [("a", "d", 2.0, ts(D - dt.timedelta(days=1))), ("a", "d", 5.0, ts(D)),
                       ("b", "d", 7.0, ts(D)), ("c", "d", 1.0, ts(D - dt.timedelta(days=1)))])
    store = fv(spark, [("a", "c", 10.0, ts(D - dt.timedelta(days=2))), ("b", "c", 3.0, ts(D))])
    got = lambda **kw: {r.entity_id: (r.feature_value, r.timestamp) for r in
                        render_cumulative_day(spark, daily, store, "d", "c", D, **kw).collect()}
    stamp = dt.datetime(D.year, D.month, D.day, 23, 59, 59)
    assert got() == {"a": (15.0, stamp), "b": (7.0, stamp)}
    assert got(category="work") == got()
    assert got(category="bio") == {"a": (12.0, stamp), "c": (1.0, stamp)}
    assert got(filter_condition="feature_value > 5") == {"b": (7.0, stamp)}
