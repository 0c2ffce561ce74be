"""Templates that must not run, named inputs and their contracts, incremental refresh, preflight edges and failed pushes."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from riskweave.operators.quality import preflight_many, preflight_verdicts
from riskweave.operators.upsert import upsert
from riskweave.plans.master_refresh import changed_rows, users_to_refresh
from riskweave.plans.serving import SERVING_SCHEMA, push_serving, pushed_values
from riskweave.plans.template import CUMULATIVE_DAY, TemplateError, check_template, run_template
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.named import ContractError, named_table
from riskweave.sources.versioned import VersionedTable

D = dt.date(2024, 1, 30)
FV = "entity_id string, feature_id string, feature_value double, timestamp timestamp_ntz"


def test_templates_that_must_not_run():
    check_template(CUMULATIVE_DAY)
    for text in ("SELECT 1", "SELECT :stamp, :stamp", "SELECT :stamp, current_timestamp", "SELECT :stamp, now()", "SELECT :stamp, CURRENT_DATE",
                 "SELECT :stamp, unix_timestamp()", "SELECT :stamp, :other", "SELECT ':stamp'", "SELECT 1 -- :stamp"):
        with pytest.raises(TemplateError):
            check_template(text)
    check_template("SELECT :stamp, 'now() :other' AS a, unix_timestamp(x) AS b, x::string AS current_timestamped -- now()")


def test_values_are_bound_not_pasted(spark):
    rows = spark.createDataFrame([("a", "d_v1", 2.0, dt.datetime(2024, 1, 29, 5)), (None, "d_v1", 2.0, dt.datetime(2024, 1, 29, 5))], FV)
    name = "x' OR '1'='1"
    got = run_template(spark, CUMULATIVE_DAY, rows, rows.limit(0), name, 3, D, dependent_feature_id="d_v1").collect()
    assert [(r.entity_id, r.feature_id, r.feature_value, r.timestamp) for r in got] == [("a", name + "_v3", 2.0, dt.datetime(2024, 1, 30, 23, 59, 59))]


def test_named_table_keeps_its_contract(spark):
    name = "t" + uuid.uuid4().hex
    spark.range(3).select(F.col("id"), F.lit("x").alias("more")).createOrReplaceTempView(name)
    assert named_table(spark, name, "id long").columns == ["id"]
    for contract, said in (("id string", "bigint, not string"), ("gone int", "gone is missing")):
        with pytest.raises(ContractError, match=said):
            named_table(spark, name, contract)


def test_updated_at_moves_with_values_only(spark):
    target = spark.createDataFrame([("1", "a", None, "old"), ("2", None, 1, "old"), ("3", "c", 3, "old")], "id string, name string, n int, updated_at string")
    source = spark.createDataFrame([("1", "a", None), ("2", "b", 1), ("4", None, None)], "id string, name string, n int")
    how = dict(policies={"name": "overwrite", "n": "overwrite"}, now=F.lit("new"), touch="changed")
    once = upsert(target, source, "id", **how)
    assert {r.id: r.updated_at for r in once.collect()} == {"1": "old", "2": "new", "3": "old", "4": "new"}
    twice = upsert(once, source, "id", **{**how, "now": F.lit("newer")})
    assert changed_rows(once, twice).count() == 0
    assert sorted(r.id for r in changed_rows(target, once).collect()) == ["2", "4"]


def test_users_to_refresh(spark):
    users = spark.createDataFrame([("a", D), ("b", dt.date(2024, 1, 22)), ("c", None), ("d", dt.date(2024, 1, 23)), ("E", dt.date(2023, 1, 1))], "user_code string, last_updated_date date")
    master = spark.createDataFrame([("B ", "Unknown"), ("C", "x"), ("e", "Unknown")], "id string, ro string")
    assert sorted(r.user_code for r in users_to_refresh(users, master, D).collect()) == ["E", "a", "b", "d"]
    asked = spark.createDataFrame([("c",), ("c",)], "id string")
    assert [r.user_code for r in users_to_refresh(users, master, D, custom_ids=asked).collect()] == ["c"]


def test_preflight_edges(spark):
    day = lambda d: dt.datetime(2024, 1, d, 3)
    store = spark.createDataFrame([("e", "f_v1", 1.0, day(1)), ("e", "f_v1", 1.0, day(5)), ("e", "d_v1", 1.0, day(4)), ("e", "d_v1", 1.0, day(7)), ("e", "f_v1", 1.0, day(20))], FV)
    features = spark.createDataFrame([("f_v1", "d_v1"), ("g_v1", "none_v1"), ("h_v1", None)], "feature_id string, daily_feature_id string")
    report = preflight_many(store, features, dt.date(2024, 1, 3), dt.date(2024, 1, 8), spark.createDataFrame([("f_v1", "later_rows")], "feature_id string, check_kind string"))
    got = {(r.feature_id, r.check_kind, r.first_day.day, r.last_day.day, r.n, r.blocking, r.waived) for r in report.collect()}
    assert got == {("f_v1", "existing_rows", 5, 5, 1, False, False), ("f_v1", "seed_history", 1, 1, 1, False, False), ("f_v1", "later_rows", 20, 20, 1, False, True),
                   ("f_v1", "missing_daily", 3, 3, 1, True, False), ("f_v1", "missing_daily", 5, 6, 2, True, False), ("f_v1", "missing_daily", 8, 8, 1, True, False),
                   ("g_v1", "missing_daily", 3, 8, 6, True, False)}
    assert {r.feature_id: r.blocked for r in preflight_verdicts(report, features).collect()} == {"f_v1": True, "g_v1": True, "h_v1": False}


def test_a_failed_push_leaves_rows_and_marks(spark):
    table = VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/serving-{uuid.uuid4().hex}", SERVING_SCHEMA)
    rows = spark.createDataFrame([("a", "f_v1", 1.0, dt.datetime(2024, 1, 29)), ("b", "f_v1", 2.0, dt.datetime(2024, 1, 30)), ("x", "f_v1", 9.0, dt.datetime(2024, 1, 30))], FV)
    active = spark.createDataFrame([("a",), ("b",), ("b",)], "entity_id string")
    push_serving(table, rows, active, ["f_v1"], dt.date(2024, 1, 29), D, "p1")
    before = sorted(map(tuple, pushed_values(table).collect()))
    broken = rows.withColumn("feature_value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        push_serving(table, broken, active, ["f_v1"], dt.date(2024, 1, 29), dt.date(2024, 2, 5), "p2")
    assert sorted(map(tuple, pushed_values(table).collect())) == before and len(before) == 2
    push_serving(table, rows, active, ["f_v1"], dt.date(2024, 1, 29), dt.date(2024, 1, 29), "p3")     # an older end moves no mark back
    assert {r.last_successful_run for r in pushed_values(table).collect()} == {"2024-01-30"}
