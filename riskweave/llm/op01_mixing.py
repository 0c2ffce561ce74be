"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed point in a hash space of 60 bits (from the MD5 of its id, so reruns, other
engines and other budgets agree). For each source the operator sums sizes by the leading hash bits,
finds the bucket in which the running sum meets the budget, and refines that bucket alone by the next
bits, until the cut is exact to one document. A document is taken when its hash is under its source's
cut: thresholds of growing budgets are nested, nothing is sorted, and each level moves at most
``2**BITS`` pre-aggregated rows per source.

A target over the source's size takes whole copies first and a threshold for the rest.

Rules: null text has size 0; null sources form one source that sorts last; null ids share one hash (as
repeated ids do: they are taken together); an empty table gives an empty result; other columns of the
input pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import stored

BITS = 12
LEVELS = 4
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point_of(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id as text, as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights by rank of the source, ``share``
    of all sizes spread by weight, no source above ``cap`` times its size, the excess spread again.

    Water filling in closed form: sources in the order in which they reach their cap share one level
    ``(budget - caps reached) / weights not reached``; the first source that stays under its cap at its
    level fixes the level for it and all after it. One row per source passes through one task.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                                                       ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = ((F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("cap").over(upto) - F.col("cap")))
             / (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    fixed = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.select("source", "source_size",
                         F.coalesce(F.least(fixed * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): documents of the source with ``point < cut`` hold about ``goal`` words.

    Level by level: ``base`` is the left edge of the bucket still open, ``need`` what the budget has
    left there."""
    state = goals.select("source", F.lit(0).cast("long").alias("base"), F.col("goal").alias("need"))
    for depth in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - depth))
        held = state.select(F.col("source").alias("s_"), "base", "need")
        rows = sized.join(held, F.col("source").eqNullSafe(F.col("s_")) &
                          (F.col("point") >= F.col("base")) &
                          (F.col("point") < F.col("base") + F.lit(width << BITS)), "inner")
        bins = (rows.groupBy("source", "base", "need", F.floor(F.col("point") / width).alias("bin"))
                .agg(F.sum("size").alias("held")))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("total", F.sum("held").over(run))
        before = F.col("total") - F.col("held")
        last = depth == LEVELS
        # the open bucket is the first whose running sum exceeds the need; past the last level it is
        # taken whole if that comes nearer to the need
        opened = F.when(F.col("total") > F.col("need"),
                        F.struct(F.col("bin"), (F.col("need") - before).alias("rest"), F.col("held")))
        found = bins.groupBy("source", "base").agg(F.min(opened).alias("o"))
        edge = F.col("o.bin") * F.lit(width)
        if last:
            edge = edge + F.when(F.col("o.rest") * 2 > F.col("o.held"), F.lit(width)).otherwise(F.lit(0))
        state = found.select("source", F.coalesce(edge, F.col("base") + F.lit(width << BITS)).cast("long").alias("base"),
                             F.coalesce(F.col("o.rest"), F.lit(0.0)).alias("need"))
        state = stored(state, "mix-cut")
    return state.select(F.col("source").alias("s_"), F.col("base").alias("cut"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                              size_of(F.col(text)).alias("size"), point_of(F.col(doc_id)).alias("point")), "mix-sized")


def _plan(sized: DataFrame, share: float, cap: float) -> DataFrame:
    """(s_, source_size, target, whole, cut) by source: every document is taken ``whole`` times, those with
    ``point < cut`` once more."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(per_source, share, cap), "mix-target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    goals = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("goal"))
    plan = plan.join(_cuts(sized, goals), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    return stored(plan.select(F.col("source").alias("s_"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-plan")


def _copies(point: Column) -> Column:
    return (F.col("whole") + F.when(point < F.col("cut"), F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per input row."""
    sized = _sized(docs, doc_id, text, source)
    out = sized.join(_plan(sized, share, cap), F.col("source").eqNullSafe(F.col("s_")))
    return out.withColumn("copies", _copies(F.col("point"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The input rows, each as many times as the mix takes it. Texts stay where they are: only the plan, a
    row per source, is joined to them."""
    plan = _plan(_sized(docs, doc_id, text, source), share, cap)
    plan = plan.select(F.col("s_").alias("_mix_source"), "whole", "cut").withColumnsRenamed({"whole": "_mix_whole", "cut": "_mix_cut"})
    copies = F.col("_mix_whole") + F.when(point_of(F.col(doc_id)) < F.col("_mix_cut"), F.lit(1)).otherwise(F.lit(0))
    rows = docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", copies.cast("int"))
    each = F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))).alias("_mix_one")
    return rows.select(*[F.col(c) for c in docs.columns], each).select(*docs.columns)
