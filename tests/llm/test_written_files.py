"""op2, components: tables of a few bytes a row take no file for each shuffle partition."""

from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import functions as F

from riskweave.llm import op02_neardup
from riskweave.llm.components import components
from riskweave.llm.shared import LEAST_PARTS, PARTS_A_CORE, shared_dir


@contextmanager
def many_partitions(spark):
    most = max(LEAST_PARTS, PARTS_A_CORE * spark.sparkContext.defaultParallelism)
    held = {"spark.sql.shuffle.partitions": str(most + 9), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_labels_of_components(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(600) if i % 7], "a string, b string")
    with many_partitions(spark) as most:
        got = components(edges)
        assert got.rdd.getNumPartitions() <= most
        rows = got.collect()
    assert {r["id"]: r["part"] for r in rows} == {f"n{i:03d}": f"n{(i - 1) // 7 * 7 + 1:03d}" for i in range(1, 601)}


def test_tables_of_near_duplicates(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(400)]
    rows = [(i, t + (" end" if i >= len(texts) else "")) for i, t in enumerate(texts + texts)]
    there = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(there.glob("dup-*"))
    with many_partitions(spark) as most:
        kept = op02_neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select(F.sort_array(F.collect_list("doc_id"))).first()[0]
    assert kept == list(range(len(texts)))
    made = {p.name.rpartition("-")[0]: len(list(p.glob("part-*"))) for p in set(there.glob("dup-*")) - before}
    for name in ("dup-low", "dup-shared", "dup-mixed", "dup-nodes", "dup-held"):
        assert made[name] <= most, (name, made)
