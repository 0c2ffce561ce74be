"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import cut, narrow


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, part) for every id in ``edges`` (a, b); part is the smallest id of the component.

    A round moves the smallest label seen over the edges, hands it to the id that the old label named (so
    whole trees move at once) and shortcuts labels of labels: the rounds grow with the logarithm of the
    longest path. Joins and pre-aggregated minima only; nothing is collected but one flag per round."""
    both = cut(narrow(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()))
    labels = cut(narrow(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("part"))))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        seen = labels.join(near, "id").select("id", "part", F.least("part", "near").alias("low"))
        handed = seen.where("low < part").groupBy(F.col("part").alias("id")).agg(F.min("low").alias("given"))
        moved = seen.join(handed, "id", "left").select("id", "part", F.least("low", F.coalesce("given", "low")).alias("low"))
        moved = cut(narrow(moved))
        up = moved.select(F.col("id").alias("low"), F.col("low").alias("upper"))
        after = moved.join(up, "low", "left").select("id", "part", F.least("low", F.coalesce("upper", "low")).alias("low"))
        after = cut(narrow(after))
        if after.where("low != part").isEmpty():
            return after.select("id", "part")
        labels = after.select("id", F.col("low").alias("part"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
