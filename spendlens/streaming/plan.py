"""Plan state as keyed state of each user, with a timer at the plan's end."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from spendlens import shared
from spendlens.operators import plans_state

from .files import Versions, results, run

_OUT = "user_id long, plan string, expires_ms long, changes long, active boolean, step int"
#: `ends_ms`: the timer that is set. `changed` and `fired`: what this batch has to send of the user.
_STATE = "user_id long, seq long, plan string, expires_ms long, changes long, ends_ms long, changed boolean, fired boolean"
_SEEN = "user_id long, seq long, plan string, expires_ms long, at_ms long, is_new boolean"


def run_plan_state(events: DataFrame, base: str | None = None, remember_ms: int = 86_400_000) -> DataFrame:
    """user_id, plan, expires_at, changes, active: the last row that each user's state has sent. A batch writes the users it changes only.

    The plan is the one that the event of the greatest seq gave, whatever order
    events come in. The seqs of the last `remember_ms` are held, so that an event
    delivered again within that time isn't counted again; the plan itself doesn't
    depend on it. When a plan ends by the clock, its timer sends the user's row as inactive.
    """
    spark, base = events.sparkSession, base or shared.new_path(events.sparkSession, "stream")
    rows = plans_state.states(events).select("user_id", "seq", "state.plan", F.when(F.col("state.expires_at").isNotNull(), F.col("expiration_ms")).alias("expires_ms"))
    users, seen = Versions(spark, f"{base}/users", _STATE), Versions(spark, f"{base}/seen", _SEEN)

    def merge(batch: DataFrame, n: int) -> None:
        now = int(time.time() * 1000)
        known = seen.read(n - 1).where(F.col("at_ms") + remember_ms > now).select("user_id", "seq", "at_ms")
        both = batch.withColumn("given", F.struct("plan", "expires_ms")).unionByName(known, allowMissingColumns=True)
        events = both.groupBy("user_id", "seq").agg(F.max("given").alias("given"), F.max("at_ms").alias("at_ms"))
        events = events.select("user_id", "seq", "given.*", F.coalesce("at_ms", F.lit(now)).alias("at_ms"), F.col("at_ms").isNull().alias("is_new"))
        new = seen.write(events, n).where("is_new").select("user_id", "seq", "plan", "expires_ms", F.lit(1).cast("long").alias("changes"), F.when(F.col("expires_ms") > now, F.col("expires_ms")).alias("ends_ms"), F.lit(True).alias("changed"))
        old = users.read(n - 1).drop("fired").withColumn("changed", F.lit(False))
        # Of two equal seqs the one that is held counts.
        last = F.max_by(F.struct("seq", "plan", "expires_ms", "ends_ms"), F.struct("seq", ~F.col("changed")))
        merged = new.unionByName(old).groupBy("user_id").agg(last.alias("s"), F.sum("changes").alias("changes"), F.max("changed").alias("changed"))
        fired = F.coalesce(F.col("ends_ms") <= now, F.lit(False))
        timed = merged.select("user_id", "s.*", "changes", "changed").withColumn("fired", fired).withColumn("ends_ms", F.when(~F.col("fired"), F.col("ends_ms")))
        sent = users.write(timed, n).where("changed or fired")
        active = (F.col("plan") == "premium") & F.coalesce(F.col("expires_ms") > now, F.lit(True))
        sent.select("user_id", "plan", "expires_ms", "changes", active.alias("active"), F.col("fired").cast("int").alias("step")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    run(rows, "append", base, _OUT, merge)
    newest = results(spark, base, _OUT).groupBy("user_id").agg(F.max_by(F.struct("plan", "expires_ms", "changes", "active"), F.struct("batch", "step")).alias("s"))
    return newest.select("user_id", "s.plan", F.timestamp_millis("s.expires_ms").cast("timestamp_ntz").alias("expires_at"), "s.changes", "s.active")
