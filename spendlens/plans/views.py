"""The domain relations of `sources.domain` as SQL, for the statements that queries are compared with."""

LEDGER = """ledger AS (SELECT event_id AS id, user_id, ts, ts::DATE AS date, value::DECIMAL(14,2) AS amount, event_type AS category,
  CASE WHEN event_type = 'purchase' THEN 'credit' ELSE 'debit' END AS type FROM events)"""
LONG_LEDGER = """ledger AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS ts, o_orderdate::DATE AS date, o_totalprice::DECIMAL(14,2) AS amount,
  o_orderpriority AS category, CASE WHEN o_orderstatus = 'O' THEN 'credit' ELSE 'debit' END AS type FROM orders)"""
CHARGES = """charges AS (SELECT l_suppkey AS user_id, l_orderkey AS id, l_shipdate AS ts, 'Part ' || l_partkey AS description,
  (floor(l_extendedprice / l_quantity * 100 + 0.5) / 100)::DECIMAL(14,2) AS amount FROM lineitem)"""
SUBSCRIPTIONS = """subscriptions AS (SELECT p_partkey AS id, p_partkey % 150 AS user_id, 'PART-' || p_partkey || '!' AS name,
  CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice::DECIMAL(14,2) END AS amount,
  CASE WHEN p_partkey % 5 = 0 THEN 'yearly' WHEN p_partkey % 5 = 1 THEN 'weekly' ELSE 'monthly' END AS frequency,
  CASE WHEN p_partkey % 7 <> 0 THEN (1 + p_partkey % 31)::INTEGER END AS billing_day, p_partkey % 11 <> 0 AS is_active FROM part)"""
BILLS = """bills AS (SELECT s_suppkey AS id, s_suppkey % 150 AS user_id, s_name AS name, abs(s_acctbal)::DECIMAL(14,2) AS amount,
  (1 + s_suppkey % 31)::INTEGER AS due_day, (1 + s_suppkey % 10)::INTEGER AS reminder_days, s_suppkey % 9 <> 0 AS is_active FROM supplier)"""
USERS = """users AS (SELECT c_custkey AS user_id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'web:' || c_custkey
  ELSE 'ExponentPushToken[' || c_custkey || ']' END AS push_token, CASE WHEN c_custkey % 3 = 0 THEN 'premium' ELSE 'free' END AS plan,
  CASE WHEN c_custkey % 6 = 0 THEN make_timestamp(2024, 1, 1 + c_custkey % 28, 0, 0, 0) END AS plan_expires_at FROM customer)"""
GOALS = """goals AS (SELECT c_custkey AS goal_id, c_custkey AS user_id, (abs(c_acctbal) + 500)::DECIMAL(14,2) AS target_amount,
  CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-15' + (c_custkey % 300)::INTEGER END AS target_date FROM customer)"""
DEPOSITS = "deposits AS (SELECT event_id AS id, user_id AS goal_id, value::DECIMAL(14,2) AS amount, ts AS created_at FROM events WHERE event_type = 'purchase')"
BUDGETS = """budgets AS (SELECT c_custkey AS user_id, category, (1000 + c_custkey % 7 * 500)::DOUBLE AS budget
  FROM customer, (VALUES ('view'), ('signup'), ('error'), ('click')) v(category) WHERE c_custkey % 10 <> 0)"""
OFFERS = """offers AS (SELECT l_suppkey AS store_id, l_partkey AS ordinal, p_name AS name, min((floor(l_extendedprice / l_quantity * 100 + 0.5) / 100)::DECIMAL(14,2))::DOUBLE AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""
PLAN_EVENTS = """plan_events AS (SELECT event_id AS seq, user_id, ts, CASE event_id % 5 WHEN 0 THEN 'INITIAL_PURCHASE' WHEN 1 THEN 'RENEWAL' WHEN 2 THEN 'EXPIRATION'
  WHEN 3 THEN 'CANCELLATION' ELSE 'TEST' END AS type, CASE WHEN event_id % 2 = 0 THEN 1706745600000 + event_id * 1000 END AS expiration_ms FROM events)"""


def named(*views: str) -> str:
    return "WITH " + ",\n".join(views)
