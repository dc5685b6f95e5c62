"""Recurring charges, goals, calendar and reminders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlens.functions.numbers import rounded
from spendlens.operators import calendar, goals as goal_op, ledger as ledger_op, ranks, recurring
from spendlens.registry import query
from spendlens.sources import domain

from .ledger import LONG_AS_OF, SURPLUS
from .views import BILLS, CHARGES, DEPOSITS, GOALS, LONG_LEDGER, SUBSCRIPTIONS, USERS, named

END = dt.datetime(1998, 12, 31)
AS_OF = dt.datetime(2024, 1, 20)
TODAY = AS_OF.date()
_REGISTERED = "registered AS (SELECT DISTINCT l_suppkey AS user_id, 'PART ' || l_partkey || '!' AS name FROM lineitem WHERE l_partkey % 10 = 0)"
_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def registered(spark, sf_dir):
    items = domain.table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 10 == 0)
    return items.select(F.col("l_suppkey").alias("user_id"), F.concat(F.lit("PART "), F.col("l_partkey").cast("string"), F.lit("!")).alias("name")).distinct()


@query("d5_recurring_candidates", f"""{named(CHARGES, _REGISTERED)}, g AS (SELECT user_id, {_KEY.format('description')} AS key, count(*) AS occurrences, min(ts::DATE) AS first, max(ts::DATE) AS last_charge,
    avg(amount::DOUBLE) AS mean, max(amount::DOUBLE) AS high, min(amount::DOUBLE) AS low, any_value(description) AS description FROM charges
    WHERE amount > 0 AND ts >= TIMESTAMP '1998-12-31' - INTERVAL 96 MONTH AND ts <= TIMESTAMP '1998-12-31' GROUP BY 1, 2 HAVING count(*) >= 2),
  f AS (SELECT * FROM g WHERE (last_charge - first) / (occurrences - 1) BETWEEN 20 AND 60 AND greatest(high - mean, mean - low) / mean <= 0.15
    AND NOT EXISTS (SELECT 1 FROM registered r WHERE r.user_id = g.user_id AND (contains(g.key, {_KEY.format('r.name')}) OR contains({_KEY.format('r.name')}, g.key))))
  SELECT * FROM (SELECT user_id, key, description, floor(mean + 0.5)::BIGINT AS amount, occurrences, last_charge,
    row_number() OVER (PARTITION BY user_id ORDER BY floor(mean + 0.5) DESC, key) AS place FROM f) WHERE place <= 10""")
def d5_recurring_candidates(spark, sf_dir):
    found = recurring.candidates(domain.charges(spark, sf_dir), registered(spark, sf_dir), END, 96)
    return found.withColumn("place", F.expr("row_number() over (partition by user_id order by amount desc, key)"))


_MATCHED = f"""c AS (SELECT user_id, id, ts, amount, {_KEY.format('description')} AS key FROM (SELECT l_partkey % 150 AS user_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS ts,
    'Part ' || l_partkey AS description, (floor(l_extendedprice / l_quantity * 100 + 0.5) / 100)::DECIMAL(14,2) AS amount FROM lineitem) WHERE amount > 0 AND ts >= TIMESTAMP '1998-08-02' - INTERVAL 2 MONTH AND ts <= TIMESTAMP '1998-08-02'),
  l AS (SELECT s.id, s.user_id, s.name, s.amount::DOUBLE AS registered, arg_max(c.amount, (c.ts, c.id))::DOUBLE AS last_amount FROM subscriptions s
    JOIN c ON c.user_id = s.user_id AND (contains({_KEY.format('s.name')}, c.key) OR contains(c.key, {_KEY.format('s.name')})) WHERE s.is_active AND s.amount IS NOT NULL GROUP BY ALL)"""


def part_charges(spark, sf_dir):
    """Charges whose user is the one that `subscriptions` gives a part's subscription to."""
    return domain.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 150).alias("user_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"), domain.unit_price().alias("amount"), F.lit("debit").alias("type"),
    )


@query("d8_price_alerts", f"{named(SUBSCRIPTIONS, _MATCHED)} SELECT id, user_id, name, registered, last_amount, floor(last_amount - registered + 0.5)::BIGINT AS difference FROM l WHERE last_amount > registered * 1.02")
def d8_price_alerts(spark, sf_dir):
    return recurring.price_alerts(recurring.latest_charges(domain.subscriptions(spark, sf_dir), part_charges(spark, sf_dir), dt.datetime(1998, 8, 2)))


@query("a9_subscription_totals", f"""{named(SUBSCRIPTIONS)}, t AS (SELECT user_id, coalesce(sum(CASE WHEN is_active AND frequency = 'monthly' THEN amount END), 0)::DOUBLE AS monthly,
  count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM subscriptions GROUP BY 1)
  SELECT user_id, monthly, monthly * 12 AS yearly, floor(monthly * 0.2 + 0.5)::BIGINT AS optimisable, active, inactive FROM t""")
def a9_subscription_totals(spark, sf_dir):
    return recurring.totals(domain.subscriptions(spark, sf_dir))


@query("o2_subscriptions_nulls_first", f"{named(SUBSCRIPTIONS)} SELECT id, name, amount::DOUBLE AS amount FROM subscriptions WHERE user_id = 3 AND is_active ORDER BY amount DESC NULLS FIRST, id")
def o2_subscriptions_nulls_first(spark, sf_dir):
    return domain.subscriptions(spark, sf_dir).where("user_id = 3 and is_active").orderBy(F.desc_nulls_first("amount"), "id").select("id", "name", F.col("amount").cast("double").alias("amount"))


#: Descriptions that `merchant_charges` deals to orders by key.
DESCRIPTIONS = ["NETFLIX.COM 610", "SPOTIFY P2", "HBOMAX", "Disney Plus UY", "ANTEL factura", "antelope", "Steam Games", "PEDIDOS YA", "Kiosco 18", "APPLE TV", "xbox game pass", "Smart Fit"]
_MERCHANT = """CASE WHEN d ILIKE '%netflix%' THEN 'Netflix' WHEN d ILIKE '%spotify%' THEN 'Spotify' WHEN d ILIKE '%disney plus%' THEN 'Disney+' WHEN d ILIKE '%hbomax%' THEN 'HBO Max' WHEN d ILIKE '%apple tv%' THEN 'Apple TV+'
  WHEN d ILIKE '%xbox%' THEN 'Xbox Game Pass' WHEN d ILIKE '%steam%' THEN 'Steam' WHEN d ILIKE '%smart fit%' THEN 'Gimnasio' WHEN d ILIKE '%pedidos ya%' THEN 'PedidosYa+' WHEN regexp_matches(d, '\\bantel\\b', 'i') THEN 'Antel' END"""


def merchant_charges(spark, sf_dir):
    listed = F.array(*map(F.lit, DESCRIPTIONS))
    return domain.long_ledger(spark, sf_dir).withColumn("description", F.get(listed, (F.col("id") % len(DESCRIPTIONS)).cast("int")))


@query("j4_known_merchants", f"""{named(LONG_LEDGER)}, c AS (SELECT *, (['{"','".join(DESCRIPTIONS)}'])[id % {len(DESCRIPTIONS)} + 1] AS d FROM ledger WHERE type = 'debit'), k AS (SELECT *, {_MERCHANT} AS merchant FROM c)
  SELECT user_id, merchant, arg_max(amount, (date, -id))::DOUBLE AS amount, max(date) AS last_charged, count(*) AS charges FROM k WHERE merchant IS NOT NULL GROUP BY 1, 2""")
def j4_known_merchants(spark, sf_dir):
    return recurring.known_merchants(merchant_charges(spark, sf_dir))


_STREAK = """streaks AS (SELECT goal_id, least(count(*), 365) AS streak FROM (SELECT goal_id, day, day - row_number() OVER (PARTITION BY goal_id ORDER BY day)::INTEGER AS island FROM
  (SELECT DISTINCT goal_id, created_at::DATE AS day FROM deposits WHERE created_at::DATE <= DATE '2024-01-20')) GROUP BY goal_id, island HAVING max(day) >= DATE '2024-01-19')"""


@query("w2_deposit_streaks", f"{named(DEPOSITS, _STREAK)} SELECT * FROM streaks")
def w2_deposit_streaks(spark, sf_dir):
    return goal_op.streaks(domain.deposits(spark, sf_dir), TODAY)


_INSIGHTS = """sums AS (SELECT goal_id, sum(amount)::DOUBLE AS current, min(created_at) AS first, count(*) AS n FROM deposits WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY 1),
  p AS (SELECT g.*, g.target_amount::DOUBLE AS target, coalesce(s.current, 0) AS now, n, s.current / greatest((epoch(TIMESTAMP '2024-01-20') - floor(epoch(first))) / (86400 * 30.44), 1) AS pace FROM goals g LEFT JOIN sums s USING (goal_id)),
  q AS (SELECT *, CASE WHEN now >= target THEN 'completed' WHEN n IS NULL OR pace <= 0 THEN 'no_data' ELSE 'ok' END AS status, greatest((target - now) / pace, 0.5) AS months FROM p),
  insight AS (SELECT q.goal_id, user_id, status, now AS current, target, CASE WHEN status = 'ok' THEN floor(pace + 0.5)::BIGINT END AS avg_per_month,
    CASE WHEN status = 'ok' THEN floor(months * 10 + 0.5) / 10 END AS months_left, CASE WHEN status = 'ok' THEN DATE '2024-01-20' + floor(months * 30.44 + 0.5)::INTEGER END AS projected_date,
    CASE WHEN target_date IS NULL OR target_date <= DATE '2024-01-20' THEN NULL WHEN target - now <= 0 THEN 0 ELSE ceil((target - now) / ((target_date - DATE '2024-01-20') / 30.44))::BIGINT END AS quota,
    coalesce(streak, 0) AS streak, now / target >= 0.25 AS p25, now / target >= 0.5 AS p50, now / target >= 0.75 AS p75, now / target >= 1 AS p100 FROM q LEFT JOIN streaks USING (goal_id))"""
_EARLY = DEPOSITS.replace("'purchase'", "'purchase' AND ts < TIMESTAMP '2024-01-20'")
_EARLY_STREAK = _STREAK


def goal_insights(spark, sf_dir):
    early = domain.deposits(spark, sf_dir).where(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return goal_op.insights(domain.goals(spark, sf_dir), early, AS_OF)


@query("d4_goal_insights", f"{named(GOALS, _EARLY, _EARLY_STREAK, _INSIGHTS)} SELECT * EXCLUDE (target) FROM insight")
def d4_goal_insights(spark, sf_dir):
    return goal_insights(spark, sf_dir)


# The users' spending and their goals' deposits lie years apart in the given tables, so each has its own date.
@query("j7_goal_surplus", f"""{named(GOALS, _EARLY, _EARLY_STREAK, _INSIGHTS, LONG_LEDGER, SURPLUS)} SELECT insight.* EXCLUDE (target), coalesce(surplus, 0) AS surplus FROM insight LEFT JOIN surplus USING (user_id)""")
def j7_goal_surplus(spark, sf_dir):
    return goal_op.with_surplus(goal_insights(spark, sf_dir), ledger_op.surplus(ledger_op.spending_pace(domain.long_ledger(spark, sf_dir), LONG_AS_OF, 12)))


@query("a11_goal_totals", f"""{named(GOALS, _EARLY, _EARLY_STREAK, _INSIGHTS)} SELECT user_id, sum(current) AS saved, sum(target) AS wanted, floor(sum(current) / sum(target) * 1000000 + 0.5) / 1000000 AS ratio,
  count(*) FILTER (status <> 'completed') AS open, count(*) FILTER (status = 'completed') AS completed FROM insight GROUP BY 1""")
def a11_goal_totals(spark, sf_dir):
    return goal_op.totals(goal_insights(spark, sf_dir), domain.goals(spark, sf_dir)).withColumn("ratio", rounded(F.col("ratio"), 6))


@query("p11_goal_quota", f"{named(USERS, GOALS)} SELECT user_id, count(*) AS goals FROM users JOIN goals USING (user_id) WHERE plan <> 'premium' GROUP BY 1 HAVING count(*) >= 1")
def p11_goal_quota(spark, sf_dir):
    return goal_op.over_quota(domain.users(spark, sf_dir), domain.goals(spark, sf_dir))


_NEXT = """CASE WHEN date_trunc('month', DATE '2024-01-20')::DATE + ({d} - 1) > DATE '2024-01-20' THEN date_trunc('month', DATE '2024-01-20')::DATE + ({d} - 1)
  ELSE DATE '2024-02-01' + ({d} - 1) END"""
_CALENDAR = f"""calendar AS (SELECT *, next_date - DATE '2024-01-20' AS days FROM (SELECT user_id, kind, id, name, amount::DOUBLE AS amount, ({_NEXT.format(d='day')})::DATE AS next_date FROM
  (SELECT user_id, 'subscription' AS kind, id, name, amount, billing_day AS day FROM subscriptions WHERE is_active AND billing_day IS NOT NULL UNION ALL SELECT user_id, 'bill', id, name, amount, due_day FROM bills WHERE is_active)) WHERE next_date - DATE '2024-01-20' <= 30)"""


@query("d3_upcoming_charges", f"{named(SUBSCRIPTIONS, BILLS, _CALENDAR)} SELECT user_id, kind, id, name, amount, next_date, days::INTEGER AS days FROM calendar")
def d3_upcoming_charges(spark, sf_dir):
    return calendar.upcoming(domain.subscriptions(spark, sf_dir), domain.bills(spark, sf_dir), TODAY)


@query("p16_due_soon", f"{named(SUBSCRIPTIONS, BILLS, _CALENDAR)} SELECT user_id, kind, id, name, amount, next_date, days::INTEGER AS days, days <= 3 AS urgent FROM calendar WHERE days <= 7 ORDER BY days")
def p16_due_soon(spark, sf_dir):
    return calendar.due_soon(d3_upcoming_charges(spark, sf_dir)).orderBy("days")


@query("d11_due_reminders", f"""{named(BILLS, USERS)}, d AS (SELECT *, (({_NEXT.format(d='due_day')})::DATE - DATE '2024-01-20')::INTEGER AS days FROM bills WHERE is_active)
  SELECT d.user_id, d.id, d.name AS bill, days, push_token, d.user_id // 10000 AS lot, ((row_number() OVER (PARTITION BY d.user_id // 10000 ORDER BY d.user_id, d.id) - 1) // 100)::BIGINT AS batch
  FROM d JOIN users u ON u.user_id = d.user_id WHERE days = reminder_days AND starts_with(push_token, 'ExponentPushToken[')""")
def d11_due_reminders(spark, sf_dir):
    return calendar.reminders(domain.bills(spark, sf_dir), domain.users(spark, sf_dir), TODAY)


@query("p13_subscription_lists", f"{named(SUBSCRIPTIONS)} SELECT 'active' AS list, id, name FROM subscriptions WHERE is_active UNION ALL SELECT 'inactive', id, name FROM subscriptions WHERE NOT is_active")
def p13_subscription_lists(spark, sf_dir):
    active, inactive = recurring.by_flag(domain.subscriptions(spark, sf_dir), "is_active")
    listed = lambda rows, name: rows.select(F.lit(name).alias("list"), "id", "name")
    return listed(active, "active").unionByName(listed(inactive, "inactive"))


@query("o5_goal_deposits", f"{named(GOALS, DEPOSITS)} SELECT id, amount::DOUBLE AS amount, created_at FROM deposits WHERE goal_id = 7 AND EXISTS (SELECT 1 FROM goals WHERE goal_id = 7 AND user_id = 7) ORDER BY created_at DESC, id DESC LIMIT 50")
def o5_goal_deposits(spark, sf_dir):
    """The 50 newest: the limit is the feature."""
    found = goal_op.deposits_of(domain.goals(spark, sf_dir), domain.deposits(spark, sf_dir), 7, 7)
    return found.select("id", F.col("amount").cast("double").alias("amount"), "created_at")


@query("o13_bills_by_day", f"{named(BILLS)} SELECT id, due_day, row_number() OVER (ORDER BY due_day, id)::INTEGER AS place FROM bills")
def o13_bills_by_day(spark, sf_dir):
    return ranks.ranked(domain.bills(spark, sf_dir).select("id", "due_day"), "place", F.col("due_day").asc(), F.col("id").asc())


@query("o13_goals_latest_first", f"{named(GOALS)} SELECT goal_id, target_date, row_number() OVER (ORDER BY target_date DESC NULLS LAST, goal_id)::INTEGER AS place FROM goals")
def o13_goals_latest_first(spark, sf_dir):
    return ranks.ranked(domain.goals(spark, sf_dir).select("goal_id", "target_date"), "place", F.col("target_date").desc_nulls_last(), F.col("goal_id").asc())
