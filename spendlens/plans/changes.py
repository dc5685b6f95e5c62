"""The write path, plan state, rate windows and their streaming forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlens import shared, streaming
from spendlens.functions import rules
from spendlens.functions.numbers import rounded
from spendlens.operators import plans_state, writes
from spendlens.operators.tables import MonthTable
from spendlens.registry import query
from spendlens.sources import domain

from .views import BUDGETS, GOALS, LEDGER, LONG_LEDGER, PLAN_EVENTS, USERS, named


@query("k1_append", f"{named(LEDGER)} SELECT type, count(*) AS n, sum(amount)::DOUBLE AS total FROM (SELECT type, amount FROM ledger UNION ALL SELECT type, amount FROM ledger WHERE id % 3 = 0) GROUP BY 1")
def k1_append(spark, sf_dir):
    rows = domain.ledger(spark, sf_dir)
    return writes.append(rows, rows.where("id % 3 = 0")).groupBy("type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("k2_append_new", f"""{named(LEDGER)}, old AS (SELECT * FROM ledger WHERE id % 2 = 0), new AS (SELECT DISTINCT user_id, date, amount FROM ledger WHERE id % 3 = 0)
  SELECT user_id, count(*) AS n, sum(amount)::DOUBLE AS total FROM (SELECT user_id, amount FROM old UNION ALL SELECT user_id, amount FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.date = n.date AND o.amount = n.amount)) GROUP BY 1""")
def k2_append_new(spark, sf_dir):
    rows = domain.ledger(spark, sf_dir)
    out = writes.append_new(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), "user_id", "date", "amount")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("k3_budget_upsert", f"""{named(LEDGER, BUDGETS)}, c AS (SELECT user_id, category, arg_max(amount, id)::DOUBLE AS budget FROM ledger WHERE type = 'debit' GROUP BY 1, 2)
  SELECT user_id, category, coalesce(c.budget, b.budget) AS budget FROM budgets b FULL JOIN c USING (user_id, category)""")
def k3_budget_upsert(spark, sf_dir):
    table = domain.budgets(spark, sf_dir).withColumn("budget", F.col("budget").cast("double"))
    changes = domain.ledger(spark, sf_dir).where("type = 'debit'").select("user_id", "category", F.col("amount").cast("double").alias("budget"), F.col("id").alias("seq"))
    return writes.upsert(table, changes, "user_id", "category")


@query("k4_partial_update", f"""{named(USERS)} SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new ' || user_id ELSE name END AS name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE push_token END AS push_token,
  CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS updated_at FROM users""")
def k4_partial_update(spark, sf_dir):
    table = domain.users(spark, sf_dir).select("user_id", "name", "push_token", F.lit(dt.date(2024, 1, 1)).alias("updated_at"))
    fields = F.concat(F.when(F.col("user_id") % 2 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("push_token"))).otherwise(F.array().cast("array<string>")))
    patches = table.select("user_id", fields.alias("fields"), F.concat(F.lit("new "), F.col("user_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("push_token")).where(F.size("fields") > 0)
    return writes.patch(table, patches, "user_id", F.lit(dt.date(2024, 2, 1)))


@query("k5_delete", f"{named(BUDGETS)} SELECT user_id, category, budget FROM budgets WHERE NOT (user_id % 4 = 1 AND category = 'view')")
def k5_delete(spark, sf_dir):
    rows = domain.budgets(spark, sf_dir).withColumn("budget", F.col("budget").cast("double"))
    return writes.delete(rows, rows.where("user_id % 4 = 1 and category = 'view'"), "user_id", "category")


_WRITTEN = """start AS (SELECT id, date, amount::DOUBLE AS amount FROM ledger WHERE id % 4 <> 0), appended AS (SELECT id, date, amount::DOUBLE AS amount FROM ledger WHERE id % 4 = 0 AND strftime(date, '%Y-%m') = '1997-03'),
  held AS (SELECT * FROM start UNION ALL SELECT * FROM appended), gone AS (SELECT id FROM held WHERE id % 4 = 2 AND strftime(date, '%Y-%m') = '1993-02'),
  upserted AS (SELECT id, date, CASE WHEN id % 4 = 1 AND strftime(date, '%Y-%m') = '1995-06' THEN amount + 1 ELSE amount END AS amount FROM held),
  kept AS (SELECT strftime(date, '%Y-%m') AS month, amount FROM upserted WHERE id NOT IN (SELECT id FROM gone))"""


@query("k1_written_ledger", f"""{named(LONG_LEDGER)}, {_WRITTEN} SELECT month, count(*) AS n, round(sum(amount), 2) AS total, month IN ('1993-02', '1995-06', '1997-03') AS rewritten FROM kept GROUP BY 1""")
def k1_written_ledger(spark, sf_dir):
    """A written ledger after a batch that came twice, an upsert and a delete: its months, and which of them have other files than at first."""
    rows = domain.long_ledger(spark, sf_dir).select("id", "date", F.col("amount").cast("double").alias("amount"))
    month = F.date_format("date", "yyyy-MM")
    table = MonthTable.create(rows.where("id % 4 <> 0"))
    first = shared.written(table.files(), "files")
    for _ in range(2):
        table.append(rows.where((F.col("id") % 4 == 0) & (month == "1997-03")), 1)
    changed = rows.where((F.col("id") % 4 == 1) & (month == "1995-06")).withColumn("amount", F.col("amount") + 1).withColumn("seq", F.lit(1))
    table.upsert(changed, 2, "id")
    table.delete(rows.where((F.col("id") % 4 == 2) & (month == "1993-02")), "id")
    months = table.read().groupBy("month").agg(F.count("*").alias("n"), rounded(F.sum("amount"), 2).alias("total"))
    same = first.withColumnRenamed("files", "before")
    return months.join(table.files(), "month").join(same, "month", "left").select("month", "n", "total", (~F.col("files").eqNullSafe(F.col("before"))).alias("rewritten"))


_LISTS = "lists AS (SELECT o_orderkey AS list_id, o_custkey AS user_id, 'list ' || o_orderkey AS name FROM orders), items AS (SELECT l_orderkey AS list_id, l_orderkey * 10 + l_linenumber AS item_id, l_partkey AS part FROM lineitem)"


def lists(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("list_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("list "), F.col("o_orderkey").cast("string")).alias("name"))


def items(spark, sf_dir):
    return domain.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_partkey").alias("part"))


@query("k6_delete_owned", f"WITH {_LISTS}, g AS (SELECT item_id FROM items WHERE item_id BETWEEN 100 AND 400 AND list_id IN (SELECT list_id FROM lists WHERE user_id = 11)) SELECT list_id, count(*) AS n FROM items WHERE item_id NOT IN (SELECT item_id FROM g) GROUP BY 1")
def k6_delete_owned(spark, sf_dir):
    left = writes.delete_owned(items(spark, sf_dir), lists(spark, sf_dir), 11, list(range(100, 401)))
    return left.groupBy("list_id").agg(F.count("*").alias("n"))


@query("k10_default_list", f"{named(USERS)}, {_LISTS} SELECT user_id, min(list_id) AS list_id, coalesce(arg_min(l.name, list_id), 'Mi lista') AS name FROM users LEFT JOIN lists l USING (user_id) GROUP BY 1")
def k10_default_list(spark, sf_dir):
    return writes.with_default_list(domain.users(spark, sf_dir), lists(spark, sf_dir))


_POSTED = "more AS (SELECT event_id, user_id AS goal_id, value::DECIMAL(14,2) AS amount, ts::DATE AS date FROM events WHERE event_type = 'click')"


def posted(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("goal_id"), F.col("value").cast("decimal(14,2)").alias("amount"), F.to_date("ts").alias("date"))
    goals = domain.goals(spark, sf_dir).withColumn("current_amount", F.lit(100).cast("decimal(14,2)"))
    return writes.post_deposits(goals, domain.ledger(spark, sf_dir), rows, rules.SAVINGS_CATEGORY)


@query("d12_posted_goals", f"{named(GOALS, _POSTED)} SELECT g.goal_id, (100 + coalesce(sum(amount), 0))::DOUBLE AS current_amount FROM goals g LEFT JOIN more USING (goal_id) GROUP BY 1")
def d12_posted_goals(spark, sf_dir):
    return posted(spark, sf_dir)[0].select("goal_id", F.col("current_amount").cast("double").alias("current_amount"))


@query("d12_posted_ledger", f"{named(LEDGER, GOALS, _POSTED)} SELECT category, count(*) AS n, sum(amount)::DOUBLE AS total FROM (SELECT category, amount FROM ledger UNION ALL SELECT 'Ahorro', amount FROM more JOIN goals USING (goal_id)) GROUP BY 1")
def d12_posted_ledger(spark, sf_dir):
    return posted(spark, sf_dir)[1].groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("d12_linked_transactions", f"{named(LEDGER, GOALS)} SELECT id, user_id, CASE WHEN id % 5 = 0 AND EXISTS (SELECT 1 FROM goals g WHERE g.goal_id = l.user_id) THEN user_id END AS goal_id FROM ledger l")
def d12_linked_transactions(spark, sf_dir):
    ledger, goals = domain.ledger(spark, sf_dir), domain.goals(spark, sf_dir)
    links = ledger.where("id % 5 = 0").select("id", F.col("user_id").alias("goal_id")).unionByName(ledger.where("id % 5 = 1").select("id", (F.col("user_id") + 1).alias("goal_id")))
    return writes.link_transactions(ledger, goals, links).select("id", "user_id", "goal_id")


@query("p15_validation", f"""{named(LONG_LEDGER)}, e AS (SELECT id, CASE WHEN NOT amount >= 100000 THEN 'amount' END AS a, CASE WHEN type NOT IN ('debit') THEN 'type' END AS t, CASE WHEN NOT day(date) BETWEEN 1 AND 28 THEN 'day' END AS d FROM ledger)
  SELECT concat_ws(',', a, t, d) AS errors, count(*) AS n FROM e GROUP BY 1""")
def p15_validation(spark, sf_dir):
    checks = {"amount": F.col("amount") >= 100000, "type": F.col("type").isin("debit"), "day": F.dayofmonth("date").between(1, 28)}
    return writes.validated(domain.long_ledger(spark, sf_dir), checks).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


_GRANTS = "type IN ('INITIAL_PURCHASE', 'RENEWAL')"
_STATE = f"""{named(PLAN_EVENTS)}, last AS (SELECT user_id, max(seq) AS seq, count(*) AS changes FROM plan_events WHERE type <> 'TEST' GROUP BY 1)
  SELECT user_id, CASE WHEN {_GRANTS} THEN 'premium' ELSE 'free' END AS plan, CASE WHEN {_GRANTS} THEN make_timestamp(expiration_ms * 1000) END AS expires_at, changes FROM last JOIN plan_events USING (user_id, seq)"""


@query("t1_plan_state", _STATE)
def t1_plan_state(spark, sf_dir):
    return plans_state.plan_state(domain.plan_events(spark, sf_dir))


def arriving(spark, sf_dir, table: str, *order: str):
    """A table's rows as a stream of several batches."""
    return streaming.in_batches(domain.table(spark, sf_dir, table), BATCHES, *order)


BATCHES = 4


@query("t1_plan_state_stream", _STATE)
def t1_plan_state_stream(spark, sf_dir):
    return streaming.run_plan_state(domain.plan_events_of(arriving(spark, sf_dir, "events", "ts", "event_id"))).drop("active")


@query("t5_job_progress_stream", "SELECT o_custkey AS job_id, count(*) AS total, count(*) AS completed, 'done' AS status FROM orders GROUP BY 1")
def t5_job_progress_stream(spark, sf_dir):
    """Jobs are customers, whose orders are the results that come in; the start names how many there will be."""
    orders = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderdate")
    starts = orders.groupBy("job_id").agg(F.count("*").alias("total"), F.min("o_orderdate").alias("at")).withColumn("kind", F.lit("start"))
    items = orders.select("job_id", F.lit(None).cast("long").alias("total"), F.col("o_orderdate").alias("at"), F.lit("item").alias("kind"))
    return streaming.run_jobs(streaming.in_batches(starts.unionByName(items), BATCHES, "at"))


@query("t8_budget_alerts_stream", f"""{named(LEDGER, BUDGETS)} SELECT user_id, strftime(ts, '%Y-%m') AS month, category FROM ledger JOIN budgets USING (user_id, category)
  WHERE type = 'debit' GROUP BY ALL HAVING sum(amount) > max(budget)""")
def t8_budget_alerts_stream(spark, sf_dir):
    events = arriving(spark, sf_dir, "events", "ts", "event_id")
    return streaming.run_budget_alerts(domain.ledger_of(events), domain.budgets(spark, sf_dir))[0].select("user_id", "month", "category")


@query("p10_entitled", f"{named(USERS)} SELECT user_id, plan = 'premium' AND (plan_expires_at IS NULL OR plan_expires_at > TIMESTAMP '2024-01-20') AS entitled FROM users")
def p10_entitled(spark, sf_dir):
    return domain.users(spark, sf_dir).select("user_id", plans_state.entitled(F.col("plan"), F.col("plan_expires_at"), dt.datetime(2024, 1, 20)).alias("entitled"))


_WINDOWS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS requests, greatest(count(*) - 3, 0) AS rejected FROM events GROUP BY 1, 2"


@query("t2_rate_windows", _WINDOWS)
def t2_rate_windows(spark, sf_dir):
    return plans_state.rate_windows(domain.table(spark, sf_dir, "events"), 24 * 60, 3)


@query("t2_rate_windows_stream", _WINDOWS)
def t2_rate_windows_stream(spark, sf_dir):
    return streaming.run_rate_windows(arriving(spark, sf_dir, "events", "ts", "event_id"), 24 * 60, 3, "40 days")


@query("t4_progress_stream", "SELECT event_type, count(*) AS n, sum(value::DECIMAL(14,2))::DOUBLE AS total FROM events GROUP BY 1")
def t4_progress_stream(spark, sf_dir):
    return streaming.run_progress(arriving(spark, sf_dir, "events", "ts", "event_id"), "event_type")
