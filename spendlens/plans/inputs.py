"""What a screen sends or shows: queries typed, amounts, descriptions, previews, month steps, flags, dismissed candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.functions import dates, numbers, rules, text
from spendlens.operators import plans_state, recurring
from spendlens.registry import query
from spendlens.sources import domain

from .planning import DESCRIPTIONS, merchant_charges
from .texts import _BASKET_STOP
from .views import LONG_LEDGER, USERS, named

_LISTED = f"""c AS (SELECT *, (['{"','".join(DESCRIPTIONS)}'])[id % {len(DESCRIPTIONS)} + 1] AS description FROM ledger)"""


@query("p12_dismissed", f"""{named(LONG_LEDGER)}, {_LISTED}, k AS (SELECT user_id, description, count(*) AS charges FROM c GROUP BY 1, 2)
  SELECT * FROM k WHERE (user_id, description) NOT IN (SELECT (user_id, description) FROM c WHERE id % 7 = 0)""")
def p12_dismissed(spark, sf_dir):
    charges = merchant_charges(spark, sf_dir)
    return recurring.without_dismissed(charges.groupBy("user_id", "description").agg(F.count("*").alias("charges")), charges.where("id % 7 = 0"))


@query("f39_billing_days", f"""{named(LONG_LEDGER)}, {_LISTED} SELECT user_id, description, day(max(date))::INTEGER AS billing_day FROM c WHERE type = 'debit' GROUP BY 1, 2""")
def f39_billing_days(spark, sf_dir):
    return recurring.billing_days(merchant_charges(spark, sf_dir))


@query("w10_month_steps", f"""{named(LONG_LEDGER)} SELECT date_trunc('month', date)::DATE AS month, (date_trunc('month', date) - INTERVAL 1 MONTH)::DATE AS before,
  (date_trunc('month', date) + INTERVAL 1 MONTH)::DATE AS after, count(*) AS n FROM ledger GROUP BY ALL""")
def w10_month_steps(spark, sf_dir):
    day = F.col("date")
    return domain.long_ledger(spark, sf_dir).groupBy(
        dates.month_step(day, 0).alias("month"), dates.month_step(day, -1).alias("before"), dates.month_step(day, 1).alias("after")
    ).agg(F.count("*").alias("n"))


@query("o14_preview", f"{named(LONG_LEDGER)} SELECT id, user_id, date, amount::DOUBLE AS amount FROM ledger ORDER BY date, id LIMIT 5")
def o14_preview(spark, sf_dir):
    """The first five rows: the limit is the feature."""
    return domain.long_ledger(spark, sf_dir).orderBy("date", "id").limit(5).select("id", "user_id", "date", F.col("amount").cast("double").alias("amount"))


@query("f36_flags", f"{named(USERS)} SELECT user_id, " + ", ".join(f"plan = 'premium' AS {f}" for f in plans_state.FLAGS) + " FROM users")
def f36_flags(spark, sf_dir):
    return domain.users(spark, sf_dir).select("user_id", plans_state.flags(F.col("plan") == "premium").alias("f")).select("user_id", "f.*")


@query("f8_search_queries", f"""WITH t AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g') AS n FROM part)
  SELECT name, coalesce(nullif(array_to_string([x for x in string_split(n, ' ') if length(x) > 1 AND x NOT IN ({_BASKET_STOP})], ' '), ''), trim(regexp_replace(n, ' +', ' ', 'g'))) AS query FROM t""")
def f8_search_queries(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("query", text.search_query(F.col("name")))


_WORDS = list(rules.SYNONYMS)
_HAS = " OR ".join(f"(token = '{k}' AND ({' OR '.join(f"contains(name, '{x}')" for x in [k, *v])}))" for k, v in rules.SYNONYMS.items())


@query("f9_synonyms", f"""WITH n AS (SELECT p_partkey AS id, (['{"','".join(_WORDS)}'])[p_partkey % {len(_WORDS)} + 1] || ' ' || p_name AS name, (['{"','".join(_WORDS)}'])[p_partkey // 3 % {len(_WORDS)} + 1] AS token FROM part)
  SELECT id, name, token, ({_HAS}) AS found FROM n""")
def f9_synonyms(spark, sf_dir):
    word = lambda i: F.get(F.array(*map(F.lit, _WORDS)), (i % len(_WORDS)).cast("int"))
    key = F.col("p_partkey")
    rows = domain.table(spark, sf_dir, "part").select(key.alias("id"), F.concat_ws(" ", word(key), "p_name").alias("name"), word(F.floor(key / 3)).alias("token"))
    return rows.withColumn("found", text.in_product(F.col("token"), F.col("name")))


_STEPS = [(r"TARJ(?:ETA)?[:\s]*[#X]*[0-9]{4}", ""), (r"\b[A-Z0-9:-]{8,}\b", ""), (r"\b[0-9]{3,7}\b", ""), ("[,*:-]", " "), (r"\s{2,}", " "), (r"[|\\/]{2,}", ""), ("^[^A-Za-z0-9_]+", ""), (r"^\s+|\s+$", "")]


def _clean_sql(column: str) -> str:
    for pattern, by in [(p, "") for p in rules.BANK_PHRASES] + _STEPS:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'gi')"
    return f"substr({column}, 1, 255)"


_BANK = ["COMPRA CON TARJETA DEBITO ", "Tarj: XX1234 ", "RETIRO CORRESPONSALES, ", "* Compra con ", ""]


@query("f17_clean_descriptions", f"""WITH d AS (SELECT o_orderkey AS id, (['{"','".join(_BANK)}'])[o_orderkey % {len(_BANK)} + 1] || 'Clerk#' || o_custkey || ' - shop/' || o_orderpriority || ' // ' || o_orderkey AS raw FROM orders)
  SELECT id, raw, {_clean_sql('raw')} AS description FROM d""")
def f17_clean_descriptions(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, _BANK)), (F.col("o_orderkey") % len(_BANK)).cast("int"))
    raw = F.concat(phrase, F.lit("Clerk#"), F.col("o_custkey").cast("string"), F.lit(" - shop/"), "o_orderpriority", F.lit(" // "), F.col("o_orderkey").cast("string"))
    return domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"), text.clean_description(raw).alias("description"))


@query("f32_hues", """WITH n AS (SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus AS category FROM orders)
  SELECT category, (abs(list_reduce(list_prepend(0::BIGINT, [ord(x)::BIGINT for x in string_split(category, '')]),
    lambda h, c: (h * 32 + 2147483648) - 4294967296 * floor((h * 32 + 2147483648) / 4294967296)::BIGINT - 2147483648 - h + c)) % 360)::BIGINT AS hue FROM n""")
def f32_hues(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("category")).distinct().withColumn("hue", text.hue(F.col("category")).cast("long"))


@query("f38_deposits", """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9 + 1) || '.250,' || (o_orderkey % 90 + 10) WHEN 1 THEN (o_orderkey % 1000)::VARCHAR WHEN 2 THEN 'x' ELSE (o_orderkey % 1000) || ',5' END AS typed FROM orders)
  SELECT id, typed, try_cast(replace(replace(typed, '.', ''), ',', '.') AS DOUBLE) AS amount FROM t""")
def f38_deposits(spark, sf_dir):
    key = F.col("o_orderkey")
    as_text = lambda x: x.cast("string")
    typed = (
        F.when(key % 4 == 0, F.concat(as_text(key % 9 + 1), F.lit(".250,"), as_text(key % 90 + 10))).when(key % 4 == 1, as_text(key % 1000))
        .when(key % 4 == 2, F.lit("x")).otherwise(F.concat(as_text(key % 1000), F.lit(",5")))
    )
    return domain.table(spark, sf_dir, "orders").select(key.alias("id"), typed.alias("typed"), numbers.parse_deposit(typed).alias("amount"))


@query("s22_dotted_texts", """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Hola ' || c_name || ', ' || c_name || ': ' || c_mktsegment || ' {{other}}' WHEN 1 THEN 'user.key' WHEN 2 THEN 'user.missing.deep'
  WHEN 3 THEN c_mktsegment WHEN 4 THEN 'user' ELSE 'title.deeper' END AS text FROM customer""")
def s22_dotted_texts(spark, sf_dir):
    """Texts at paths that name a text, a number, nothing, a text at the top, an object, and something below a text."""
    greeting = F.lit("Hola {{name}}, {{name}}: {{segment}} {{other}}")
    rows = domain.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.to_json(F.struct(F.struct(F.struct(greeting.alias("hello")).alias("greet"), F.col("c_custkey").alias("key")).alias("user"), F.col("c_mktsegment").alias("title"))).alias("resources"),
        F.get(F.array(*map(F.lit, ("user.greet.hello", "user.key", "user.missing.deep", "title", "user", "title.deeper"))), (F.col("c_custkey") % 6).cast("int")).alias("path"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("values"),
    )
    return rows.select("id", text.resolve(F.col("resources"), F.col("path"), F.col("values")).alias("text"))
