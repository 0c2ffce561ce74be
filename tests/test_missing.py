"""NaN, NULL and NULL-entity rows must not disturb the other entities; status runs must not replace each other."""

import datetime as dt

from pyspark.sql import functions as F

from riskweave.operators.instance import exponential_decay_scoring, rank_scoring, wilson_fraud_scoring
from riskweave.operators.windows import normalised, target_window


def test_normalised_and_window(spark):
    rows = [("a", "f", 1.0), ("b", "f", float("nan")), (None, "f", 3.0), ("c", "f", None)]
    fv = spark.createDataFrame(rows, "entity_id string, feature_id string, feature_value double").withColumn(
        "timestamp", F.lit(dt.datetime(2024, 1, 30, 5)).cast("timestamp_ntz"))
    got = {r.entity_id: r.feature_value for r in normalised(fv).collect()}
    assert got == {"a": 1.0, "b": None, "c": None}
    seen = target_window(fv, dt.date(2024, 1, 30), 1)
    assert {r.entity_id: r.feature_value for r in seen.collect()} == got


def test_sums_of_missing_values_are_zero(spark):
    day = dt.date(2024, 1, 30)
    rows = [("a", "up", None), ("a", "n", 10.0), ("b", "up", 4.0), ("b", "n", 10.0)]
    fv = spark.createDataFrame(rows, "entity_id string, feature_id string, feature_value double").withColumn(
        "timestamp", F.lit(dt.datetime(2024, 1, 30, 5)).cast("timestamp_ntz"))

    def scores(df):
        return {r.entity_id: r.score for r in df.collect()}

    wilson = scores(wilson_fraud_scoring(fv, "up", "n", day))
    assert abs(wilson["a"]) < 1e-12 and wilson["b"] > 0.1
    assert scores(exponential_decay_scoring(fv, "up", day, 30)) == {"a": 0.0, "b": 1.0}
    assert scores(rank_scoring(fv, "up", day, require_aggregation=True)) == {"a": 0.0, "b": 1.0}


def test_two_status_runs_survive(spark, tmp_path):
    from riskweave.sources.status import read_layer_status, write_status_records

    def run(name):
        return spark.createDataFrame([(name, "d", "t", "c", "OK", None, None, "daily", dt.datetime(2024, 1, 1), "Oops", 3)],
                                     "run_id string, dag_id string, task_key string, category string, status string, error string, traceback string, "
                                     "cadence string, written_at timestamp, error_type string, try_number int")

    path = str(tmp_path / "log")
    for name in ("run1", "run2"):
        write_status_records(run(name), path, name)
    got = read_layer_status(spark, path).collect()
    assert sorted(r.run_id for r in got) == ["run1", "run2"] and {r.error_type for r in got} == {"Oops"}
