"""Jobs whose results come in one by one and that are forgotten some time after they began: keyed state with a time to live."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from spendlens import shared

from .files import Versions, results, run

#: How long a job lives, counted from its start.
JOB_TTL_MS = 10 * 60 * 1000
_OUT = "job_id long, total long, completed long, status string"
_STATE = "job_id long, total long, completed long, began_ms long, changed boolean"


def run_jobs(events: DataFrame, base: str | None = None, ttl_ms: int = JOB_TTL_MS) -> DataFrame:
    """job_id, total, completed, status (running, done; unknown: never begun or forgotten) of `events` (job_id, kind start or item, total).

    A job's start must come in the batch of its first result or earlier. A batch's
    rows are summed with the jobs that live, all in one grouping, and it writes the
    jobs it changes only; `began_ms` is set once, so that a job's time runs from its start.
    """
    spark, base = events.sparkSession, base or shared.new_path(events.sparkSession, "stream")
    jobs = Versions(spark, f"{base}/jobs", _STATE)

    def merge(batch: DataFrame, n: int) -> None:
        now = int(time.time() * 1000)
        begins = F.col("kind").eqNullSafe("start")
        new = batch.select("job_id", F.when(begins, F.col("total")).alias("begun"), F.when(begins, 0).otherwise(1).cast("long").alias("items"), F.lit(True).alias("changed"))
        live = jobs.read(n - 1).where(F.col("total").isNotNull() & (F.col("began_ms") + ttl_ms > now))
        both = new.unionByName(live.select("job_id", "total", F.col("completed").alias("items"), "began_ms", F.lit(False).alias("changed")), allowMissingColumns=True)
        summed = both.groupBy("job_id").agg(*(F.max(c).alias(c) for c in ("total", "begun", "began_ms", "changed")), F.sum("items").alias("items"))
        total = F.coalesce("total", "begun")
        known = summed.select("job_id", total.alias("total"), F.when(total.isNotNull(), F.col("items")).alias("completed"), F.coalesce("began_ms", F.lit(now)).alias("began_ms"), "changed")
        sent = jobs.write(known, n).where("changed")
        status = F.when(F.col("total").isNull(), "unknown").when(F.col("completed") >= F.col("total"), "done").otherwise("running")
        sent.select("job_id", "total", "completed", status.alias("status")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    run(events.select("job_id", "kind", "total"), "append", base, _OUT, merge)
    newest = results(spark, base, _OUT).groupBy("job_id").agg(F.max_by(F.struct("total", "completed", "status"), "batch").alias("s"))
    return newest.select("job_id", "s.total", "s.completed", "s.status")
