"""Ledger queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlens.functions.numbers import rounded
from spendlens.operators import ledger as op
from spendlens.registry import query
from spendlens.sources import domain

from .views import BUDGETS, GOALS, LEDGER, LONG_LEDGER, SUBSCRIPTIONS, named

MONTH = "2024-01"
AS_OF = dt.datetime(2024, 1, 20, 12)
LONG_AS_OF = dt.datetime(1998, 8, 2)
_IN_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
_SUMS = """sum(CASE WHEN type = 'debit' THEN amount ELSE 0 END)::DOUBLE AS spent, sum(CASE WHEN type = 'credit' THEN amount ELSE 0 END)::DOUBLE AS income, count(*) AS n"""
_BY_CATEGORY = f"s AS (SELECT user_id, category, {_SUMS} FROM ledger WHERE {_IN_MONTH} GROUP BY 1, 2)"
_LONG_RANGE = "ts >= TIMESTAMP '1998-08-02' - INTERVAL {} MONTH AND ts <= TIMESTAMP '1998-08-02'"


def by_category(spark, sf_dir):
    return op.summary(domain.ledger(spark, sf_dir), MONTH, "user_id", "category")


@query("a2_summary_by_category", f"{named(LEDGER)} SELECT category, {_SUMS} FROM ledger WHERE {_IN_MONTH} GROUP BY category ORDER BY spent + income DESC")
def a2_summary_by_category(spark, sf_dir):
    return op.summary(domain.ledger(spark, sf_dir), MONTH, "category").orderBy((F.col("spent") + F.col("income")).desc())


@query("a3_month_totals", f"{named(LEDGER)} SELECT {_SUMS} FROM ledger WHERE {_IN_MONTH}")
def a3_month_totals(spark, sf_dir):
    return op.summary(domain.ledger(spark, sf_dir), MONTH)


@query("d2_ledger_summary", f"""{named(LEDGER)} SELECT user_id, category, {_SUMS}, grouping(category) = 1 AS is_total FROM ledger WHERE {_IN_MONTH}
  GROUP BY GROUPING SETS ((user_id, category), (user_id))""")
def d2_ledger_summary(spark, sf_dir):
    return op.summary_with_totals(domain.ledger(spark, sf_dir), MONTH)


@query("a4_monthly_trend", f"""{named(LONG_LEDGER)} SELECT strftime(date, '%Y-%m') AS month, sum(amount)::DOUBLE AS total FROM ledger
  WHERE {_LONG_RANGE.format(6)} AND type = 'debit' GROUP BY 1 ORDER BY 1""")
def a4_monthly_trend(spark, sf_dir):
    return op.trend(domain.long_ledger(spark, sf_dir), LONG_AS_OF).orderBy("month")


@query("a5_category_months", f"""{named(LONG_LEDGER)} SELECT category, strftime(date, '%Y-%m') AS month, sum(amount)::DOUBLE AS total FROM ledger
  WHERE {_LONG_RANGE.format(3)} AND type = 'debit' GROUP BY 1, 2 ORDER BY month DESC, total DESC""")
def a5_category_months(spark, sf_dir):
    return op.category_months(domain.long_ledger(spark, sf_dir), LONG_AS_OF).orderBy(F.col("month").desc(), F.col("total").desc())


@query("o1_ledger_page", f"{named(LEDGER)} SELECT id, date, amount::DOUBLE AS amount, category, type FROM ledger WHERE user_id = 7 AND {_IN_MONTH} ORDER BY date DESC, id DESC LIMIT 10 OFFSET 10")
def o1_ledger_page(spark, sf_dir):
    return op.page(domain.ledger(spark, sf_dir), 7, 10, 10, MONTH).select("id", "date", F.col("amount").cast("double").alias("amount"), "category", "type")


@query("a1_entry_counts", f"{named(LEDGER)} SELECT user_id, count(*) AS total FROM ledger GROUP BY 1")
def a1_entry_counts(spark, sf_dir):
    return op.count_entries(domain.ledger(spark, sf_dir), "user_id")


@query("w7_category_shares", f"{named(LEDGER, _BY_CATEGORY)} SELECT user_id, category, spent, floor(spent / sum(spent) OVER (PARTITION BY user_id) * 100 * 1000 + 0.5) / 1000 AS share FROM s WHERE spent > 0")
def w7_category_shares(spark, sf_dir):
    return op.shares(by_category(spark, sf_dir)).withColumn("share", rounded(F.col("share"), 3))


@query("p14_top_categories", f"""{named(LEDGER, _BY_CATEGORY)} SELECT * FROM (SELECT user_id, category, spent, income, n,
  row_number() OVER (PARTITION BY user_id ORDER BY spent + income DESC, category) AS place FROM s WHERE spent > 0) WHERE place <= 3""")
def p14_top_categories(spark, sf_dir):
    return op.top_categories(by_category(spark, sf_dir), 3)


_STATUS = """st AS (SELECT b.user_id, b.category, b.budget, coalesce(s.spent, 0) AS spent, coalesce(s.spent, 0) / b.budget * 100 AS percent FROM budgets b LEFT JOIN s USING (user_id, category))"""
_TIER = "CASE WHEN percent >= 100 THEN 'danger' WHEN percent >= 75 THEN 'warn' ELSE 'ok' END AS tier"


@query("d15_budget_status", f"""{named(LEDGER, BUDGETS, _BY_CATEGORY, _STATUS)} SELECT user_id, category, budget, spent, {_TIER}, floor(least(percent, 100) * 1000 + 0.5) / 1000 AS bar,
  CASE WHEN percent > 100 THEN floor(spent - budget + 0.5)::BIGINT END AS over FROM st""")
def d15_budget_status(spark, sf_dir):
    return op.budget_status(by_category(spark, sf_dir), domain.budgets(spark, sf_dir)).withColumn("bar", rounded(F.col("bar"), 3))


@query("p14_top_income", f"""{named(LEDGER, _BY_CATEGORY)} SELECT * FROM (SELECT user_id, category, spent, income, n,
  row_number() OVER (PARTITION BY user_id ORDER BY spent + income DESC, category) AS place FROM s WHERE income > 0) WHERE place <= 8""")
def p14_top_income(spark, sf_dir):
    return op.top_categories(by_category(spark, sf_dir), 8, "income")


@query("t8_budget_alerts", f"{named(LEDGER, BUDGETS, _BY_CATEGORY, _STATUS)} SELECT user_id, '2024-01' AS month, category, floor(spent - budget + 0.5)::BIGINT AS over FROM st WHERE spent > budget")
def t8_budget_alerts(spark, sf_dir):
    return op.new_alerts(op.budget_status(by_category(spark, sf_dir), domain.budgets(spark, sf_dir)), MONTH)


@query("d1_page_with_total", f"""{named(LEDGER)}, own AS (SELECT * FROM ledger WHERE user_id = 7 AND category = 'view' AND {_IN_MONTH})
  SELECT (SELECT count(*) FROM own) AS total, string_agg(id::VARCHAR, ',' ORDER BY date DESC, id DESC) AS ids FROM (SELECT * FROM own ORDER BY date DESC, id DESC LIMIT 5 OFFSET 2)""")
def d1_page_with_total(spark, sf_dir):
    page = op.page_with_total(domain.ledger(spark, sf_dir), 7, 5, 2, MONTH, "view")
    return page.select("total", F.array_join(F.transform("transactions", lambda t: t["id"].cast("string")), ",").alias("ids"))


@query("s2_owned_entries", f"""{named(LEDGER)} SELECT id, user_id, amount::DOUBLE AS amount FROM ledger WHERE (id = 25 AND user_id = (SELECT user_id FROM ledger WHERE id = 25))
  OR (id = 26 AND user_id = -1)""")
def s2_owned_entries(spark, sf_dir):
    ledger = domain.ledger(spark, sf_dir)
    owner = ledger.where("id = 25").first().user_id  # the one who asks
    return op.owned(ledger, 25, owner).unionByName(op.owned(ledger, 26, -1)).select("id", "user_id", F.col("amount").cast("double").alias("amount"))


_PACE = """pace AS (SELECT user_id, sum(total)::DOUBLE / count(*) AS avg_monthly, coalesce(max(CASE WHEN month = {now} THEN total END)::DOUBLE, 0) AS current_month FROM
  (SELECT user_id, date_trunc('month', date)::DATE AS month, sum(abs(amount)) AS total FROM ledger WHERE {range} AND type = 'debit' GROUP BY 1, 2) GROUP BY 1)"""


SURPLUS = _PACE.format(now="DATE '1998-08-01'", range=_LONG_RANGE.format(12)) + """, surplus AS (SELECT user_id, CASE WHEN avg_monthly > 0 AND current_month < avg_monthly
  THEN floor(avg_monthly - current_month + 0.5)::BIGINT ELSE 0 END AS surplus FROM pace)"""


@query("a6_spending_pace", f"""{named(LONG_LEDGER, _PACE.format(now="DATE '1998-08-01'", range=_LONG_RANGE.format(12)))} SELECT user_id, floor(avg_monthly * 100 + 0.5) / 100 AS avg_monthly, current_month,
  CASE WHEN avg_monthly > 0 AND current_month < avg_monthly THEN floor(avg_monthly - current_month + 0.5)::BIGINT ELSE 0 END AS surplus FROM pace""")
def a6_spending_pace(spark, sf_dir):
    return op.surplus(op.spending_pace(domain.long_ledger(spark, sf_dir), LONG_AS_OF, 12)).withColumn("avg_monthly", rounded(F.col("avg_monthly"), 2))


_MONTHS = f"""m AS (SELECT user_id, category, strftime(date, '%Y-%m') AS month, sum(amount)::DOUBLE AS total FROM ledger
  WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 3 MONTH AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND type = 'debit' GROUP BY 1, 2, 3)"""


@query("a21_month_maps", f"{named(LEDGER, _MONTHS)} SELECT user_id, month, string_agg(category || '=' || floor(total + 0.5)::BIGINT, ';' ORDER BY category) AS spending FROM m GROUP BY 1, 2")
def a21_month_maps(spark, sf_dir):
    maps = op.month_maps(op.category_months(domain.ledger(spark, sf_dir), AS_OF, 3, "user_id"))
    return maps.select("user_id", "month", F.array_join(F.transform(F.map_entries("spending"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] + 0.5).cast("string"))), ";").alias("spending"))


@query("d10_advice_context", f"""{named(LEDGER, SUBSCRIPTIONS, GOALS, _MONTHS)}, b AS (SELECT user_id, month, month || ':' || chr(10) || string_agg('  - ' || category || ': ' || floor(total + 0.5)::BIGINT, chr(10) ORDER BY category) AS block FROM m GROUP BY 1, 2),
  t AS (SELECT user_id, string_agg(block, chr(10) ORDER BY month DESC) AS months FROM b GROUP BY 1),
  u AS (SELECT user_id, string_agg(line, chr(10) ORDER BY line) AS subs FROM (SELECT user_id, '- ' || name || ': ' || coalesce(floor(amount::DOUBLE + 0.5)::BIGINT::VARCHAR, '?') AS line FROM subscriptions WHERE is_active) GROUP BY 1),
  g AS (SELECT user_id, string_agg('- goal ' || goal_id || ': ' || floor(target_amount::DOUBLE + 0.5)::BIGINT, chr(10)) AS open FROM goals GROUP BY 1)
  SELECT user_id, months || chr(10) || chr(10) || coalesce(subs, '-') || chr(10) || chr(10) || coalesce(open, '-') AS context FROM t LEFT JOIN u USING (user_id) LEFT JOIN g USING (user_id)""")
def d10_advice_context(spark, sf_dir):
    return op.advice_context(op.category_months(domain.ledger(spark, sf_dir), AS_OF, 3, "user_id"), domain.subscriptions(spark, sf_dir), domain.goals(spark, sf_dir))
