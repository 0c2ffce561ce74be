"""Per-feature job cost roll-up from stage metrics (the data side of the metrics exporter).

Stage rows carry ``jobIds`` (array) and CPU time in nanoseconds; a tag table maps job -> feature.
CPU is summed over stages (not overwritten per stage, Q12) and converted with /1e9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_cost_by_feature(stages: DataFrame, job_tags: DataFrame) -> DataFrame:
    per_job = stages.select("stageId", F.explode("jobIds").alias("jobId"), "executorCpuTime", "peakMemory")
    j = per_job.join(job_tags, "jobId")
    return j.groupBy("feature").agg(
        (F.sum("executorCpuTime") / F.lit(1e9)).alias("cpu_seconds"),
        F.max("peakMemory").alias("peak_memory_bytes"),
        F.count_distinct("stageId").alias("n_stages"),
        F.count_distinct("jobId").alias("n_jobs"))
