"""Price search, basket comparison, catalogues and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens import shared, streaming
from spendlens.functions import rules
from spendlens.functions.numbers import rounded
from spendlens.operators import offers as op
from spendlens.registry import query
from spendlens.sources import domain

from .texts import STORE_OFFERS, store_offers
from .views import OFFERS, named

QUERIES = ["red plate", "small widget", "the cold bolt", "gear red", "zzz ring"]
ITEMS = [(1, "Red plate", 2), (2, "small gizmo", 1), (3, "bolt blue", 3)]
_Q = "q(query) AS (VALUES " + ", ".join(f"('{q}')" for q in QUERIES) + ")"
_I = "i(item_id, item, quantity) AS (VALUES " + ", ".join(f"({a}, '{b}', {c})" for a, b, c in ITEMS) + ")"
_STOP = "'de','con','para','el','la','los','las','un','una','en','y','o','al'"
_SEARCH = f"""w AS (SELECT query, [x for x in string_split(lower(query), ' ') if length(x) > 2 AND x NOT IN ({_STOP})] AS words FROM q),
  n AS (SELECT DISTINCT name FROM offers),
  j AS (SELECT query, name, words, len(words) AS n, len([x for x in words if contains(name, x)]) AS matched, [x for x in string_split(name, ' ') if length(x) > 1 AND x NOT IN ({_STOP})][1] AS first FROM n, w),
  k AS (SELECT *, len([x for x in words if contains(first, x)]) > 0 AS noun FROM j),
  s AS (SELECT *, CASE WHEN matched = 0 THEN 0 ELSE 3 * matched + CASE WHEN contains(name, query) THEN 10 ELSE 0 END + CASE WHEN noun THEN 5 ELSE -3 END END AS score FROM k),
  strict AS (SELECT query, name, score FROM s WHERE score > 0 AND matched >= n),
  chosen AS (SELECT * FROM strict UNION ALL SELECT query, name, score FROM s WHERE query NOT IN (SELECT query FROM strict) AND n > 1 AND score > 0 AND contains(name, words[1]) AND noun),
  found AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, price, ordinal, store_id) AS place, store_id, name, price, score FROM offers JOIN chosen USING (name))"""


def all_offers(spark, sf_dir):
    return domain.offers(spark, sf_dir)


def searched_offers(spark, sf_dir):
    """All offers, written: a search reads them for their names and for what it finds."""
    return shared.written(all_offers(spark, sf_dir), "offers")


@query("d7_price_search", f"{named(OFFERS, _Q, _SEARCH)} SELECT query, place, store_id, name, price, score::INTEGER AS score FROM found WHERE place <= 24")
def d7_price_search(spark, sf_dir):
    return op.search(searched_offers(spark, sf_dir), QUERIES, 24)


@query("a7_price_stats", f"""{named(OFFERS, _Q, _SEARCH)} SELECT query, min(price) AS min_price, max(price) AS max_price, floor(avg(price) + 0.5)::BIGINT AS avg_price, count(*) AS n, count(DISTINCT store_id) AS stores FROM found GROUP BY 1""")
def a7_price_stats(spark, sf_dir):
    return op.price_stats(op.matching(searched_offers(spark, sf_dir), QUERIES))


_BEST = """t AS (SELECT item_id, item, quantity, string_split(lower(item), ' ') AS words FROM i), r AS (SELECT DISTINCT name FROM offers),
  v AS (SELECT item_id, item, quantity, name, len([x for x in words if contains(name, x)]) / len(words) AS score, contains(name, words[1]) AS main FROM r, t),
  best AS (SELECT item_id, item, quantity, store_id, name, price, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY score DESC, price, ordinal) AS k
    FROM offers JOIN v USING (name) WHERE main AND score >= 0.5) WHERE k = 1)"""
_TOTALS = """names AS (SELECT list(item) AS items FROM i), rolled AS (SELECT store_id, sum(price * quantity) AS total, count(*) AS found, list(item) AS got FROM best GROUP BY 1),
  totals AS (SELECT store_id, total, found, array_to_string(list_sort([x for x in items if NOT list_contains(got, x)]), ',') AS missing, found = (SELECT count(*) FROM i) AS is_full FROM rolled, names)"""


def best(spark, sf_dir):
    return op.best_offers(searched_offers(spark, sf_dir), ITEMS)


@query("w4_best_offers", f"{named(OFFERS, _I, _BEST)} SELECT * FROM best")
def w4_best_offers(spark, sf_dir):
    return best(spark, sf_dir)


@query("w6_item_options", f"{named(OFFERS, _I, _BEST)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price, store_id) AS place FROM best) WHERE place <= 4")
def w6_item_options(spark, sf_dir):
    return op.options(best(spark, sf_dir))


@query("o7_store_ranking", f"""{named(OFFERS, _I, _BEST, _TOTALS)} SELECT store_id, floor(total * 100 + 0.5) / 100 AS total, found, missing, is_full,
  row_number() OVER (ORDER BY is_full DESC, CASE WHEN is_full THEN floor(total * 100 + 0.5) / 100 END ASC NULLS LAST, CASE WHEN NOT is_full THEN found END DESC NULLS LAST, store_id) AS rank FROM totals""")
def o7_store_ranking(spark, sf_dir):
    return op.store_totals(best(spark, sf_dir), ITEMS).withColumn("total", rounded(F.col("total"), 2))


@query("a18_optimal_basket", f"""{named(OFFERS, _I, _BEST, _TOTALS)}, c AS (SELECT sum(p * quantity) AS optimal_total FROM (SELECT item_id, quantity, min(price) AS p FROM best GROUP BY 1, 2)),
  f AS (SELECT min(total) AS best_store_total FROM totals WHERE is_full) SELECT floor(optimal_total * 100 + 0.5) / 100 AS optimal_total, floor(best_store_total * 100 + 0.5) / 100 AS best_store_total, floor(greatest(0, best_store_total - optimal_total) * 100 + 0.5) / 100 AS savings FROM c, f""")
def a18_optimal_basket(spark, sf_dir):
    rows = best(spark, sf_dir)
    out = op.optimal(rows, op.store_baskets(rows, ITEMS))
    return out.select(*(rounded(F.col(c), 2).alias(c) for c in out.columns))


_LIMITS = ["3", "2.9", "", "abc", "-5", "0", " 7 ", "1e2", ".5", "100000"]


@query("o12_typed_limits", f"""{named(OFFERS, _Q, _SEARCH)}, hit AS (SELECT * FROM found WHERE query = 'red plate'), every AS (SELECT count(*) AS total FROM hit),
  lim(typed, last) AS (VALUES ('3', 3), ('2.9', 2), ('', NULL), ('abc', NULL), ('-5', -5), ('0', 0), (' 7 ', 7), ('1e2', 1), ('.5', 0), ('100000', 100000))
  SELECT typed AS "limit", count(*) AS n, max(place)::INTEGER AS last FROM hit, lim, every WHERE place <= CASE WHEN lim.last IS NULL THEN total WHEN lim.last < 0 THEN total + lim.last ELSE lim.last END GROUP BY 1""")
def o12_typed_limits(spark, sf_dir):
    ranked = op.search(searched_offers(spark, sf_dir), ["red plate"])
    limits = spark.createDataFrame([("red plate", x) for x in _LIMITS], "query string, limit string")
    return op.limited(ranked, limits).groupBy("limit").agg(F.count("*").alias("n"), F.max("place").alias("last"))


@query("w5_first_offers", f"{named(OFFERS)} SELECT store_id, ordinal, name, price FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ordinal) AS k FROM offers) WHERE k <= 12")
def w5_first_offers(spark, sf_dir):
    return op.first_per_store(domain.offers(spark, sf_dir, 12), 12).select("store_id", "ordinal", "name", "price")


@query("p8_category_offers", f"{named(OFFERS)} SELECT store_id, count(*) AS n, min(price) AS least FROM offers WHERE store_id % 12 IN (6, 7, 9) GROUP BY 1")
def p8_category_offers(spark, sf_dir):
    return op.stores_of_category(all_offers(spark, sf_dir), "belleza").groupBy("store_id").agg(F.count("*").alias("n"), F.min("price").alias("least"))


@query("d13_category_catalog", """WITH k(kind, category) AS (VALUES (0,'supermercado'),(1,'supermercado'),(2,'supermercado'),(3,'supermercado'),(4,'supermercado'),(5,'supermercado'),
  (6,'farmacia'),(6,'belleza'),(7,'farmacia'),(7,'belleza'),(8,'farmacia'),(9,'belleza'),(10,'ropa'),(11,'ropa'))
  SELECT category, count(*) AS stores, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS store_ids FROM supplier JOIN k ON kind = s_suppkey % 12 GROUP BY 1""")
def d13_category_catalog(spark, sf_dir):
    return op.category_catalog(domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id")))


@query("d14_typeahead", """WITH t AS (SELECT p_name AS term, min(p_partkey) AS ordinal FROM part GROUP BY 1), own AS (SELECT term FROM t WHERE contains(term, 'r') ORDER BY starts_with(term, 'r') DESC, ordinal LIMIT 6),
  new AS (SELECT p_type AS term, min(p_partkey) AS ordinal FROM part GROUP BY 1), more AS (SELECT lower(term) AS term, ordinal FROM new WHERE lower(term) NOT IN (SELECT term FROM own) ORDER BY ordinal LIMIT 2)
  SELECT term, 0 AS source FROM own UNION ALL SELECT term, 1 FROM more""")
def d14_typeahead(spark, sf_dir):
    parts = domain.table(spark, sf_dir, "part")
    terms = parts.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("ordinal"))
    live = parts.select(F.lower("p_type").alias("term"), F.col("p_partkey").alias("ordinal"))
    return op.typeahead(terms, live, "r")


@query("o10_typeahead_table", """WITH t AS (SELECT p_name AS term, min(p_partkey) AS ordinal FROM part GROUP BY 1), s AS (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM t),
  p AS (SELECT term, i, unnest(range(1, length(term) - i + 2)) AS l FROM s), keys AS (SELECT DISTINCT substr(term, i, l) AS key FROM p UNION SELECT '')
  SELECT key, place::INTEGER AS place, term FROM (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY starts_with(term, key) DESC, ordinal, term) AS place FROM keys JOIN t ON contains(term, key)) WHERE place <= 6""")
def o10_typeahead_table(spark, sf_dir):
    """The six best terms for every part of every product name: the limit is the feature."""
    return op.typeahead_table(domain.table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("ordinal")))


@query("u2_store_offers", f"WITH {STORE_OFFERS} SELECT * FROM offers")
def u2_store_offers(spark, sf_dir):
    return store_offers(spark, sf_dir).select("store_id", "ordinal", "name", "price")


MARKETS = [2, 3, 4, 9, 12, 13, 14, 15, 24]
_PRUNED = f"{STORE_OFFERS.replace('offers AS', 'every_offer AS')}, offers AS (SELECT * FROM every_offer WHERE store_id % 12 <= 5 AND store_id IN ({', '.join(map(str, MARKETS))}))"


def market_offers(spark, sf_dir):
    """What the parsers find in the chosen stores, written: searches read it more than once."""
    return shared.written(store_offers(spark, sf_dir, MARKETS, "supermercado"), "market")


@query("s17_store_search", f"{named(_PRUNED, _Q, _SEARCH)} SELECT query, place, store_id, name, price, score::INTEGER AS score FROM found WHERE place <= 24")
def s17_store_search(spark, sf_dir):
    """The 24 best of each search over what the parsers found in the chosen stores; the limit is the feature."""
    return op.search(market_offers(spark, sf_dir), QUERIES, 24)


@query("a7_listed_stats", f"""{named(_PRUNED, _Q, _SEARCH)} SELECT query, min(price) AS min_price, max(price) AS max_price, floor(avg(price) + 0.5)::BIGINT AS avg_price, count(*) AS n, count(DISTINCT store_id) AS stores
  FROM found WHERE place <= 24 GROUP BY 1""")
def a7_listed_stats(spark, sf_dir):
    return op.price_stats(s17_store_search(spark, sf_dir))


@query("t9_merged_stats", f"""{named(STORE_OFFERS, _Q, _SEARCH)}, per_store AS (SELECT query, store_id, count(*) AS k, min(price) AS low, max(price) AS high, sum(price) AS total FROM found GROUP BY 1, 2)
  SELECT query, store_id, (sum(k) OVER w)::BIGINT AS n, min(low) OVER w AS min_price, max(high) OVER w AS max_price, floor(sum(total) OVER w / sum(k) OVER w + 0.5)::BIGINT AS avg_price
  FROM per_store WINDOW w AS (PARTITION BY query ORDER BY store_id)""")
def t9_merged_stats(spark, sf_dir):
    return op.merged_stats(op.matching(shared.written(store_offers(spark, sf_dir), "market"), QUERIES))


@query("t9_search_stream", f"{named(OFFERS, _Q, _SEARCH)} SELECT query, place, store_id, name, price, score::INTEGER AS score FROM found WHERE place <= 24")
def t9_search_stream(spark, sf_dir):
    """d7's rows, kept up as stores arrive in several batches."""
    return streaming.run_search(streaming.in_batches(all_offers(spark, sf_dir), 4, "store_id", "ordinal"), QUERIES, 24)[0]


@query("t9_search_stats_stream", f"""{named(OFFERS, _Q, _SEARCH)} SELECT query, min(price) AS min_price, max(price) AS max_price, floor(avg(price) + 0.5)::BIGINT AS avg_price, count(*) AS n, count(DISTINCT store_id) AS stores FROM found GROUP BY 1""")
def t9_search_stats_stream(spark, sf_dir):
    return streaming.run_search(streaming.in_batches(all_offers(spark, sf_dir), 4, "store_id", "ordinal"), QUERIES, 24)[1]


# The listed products that hold `pa`, in the list's order, for the SQL.
_PA = """['pasta','pan rallado','pan','pan de molde','papas fritas','palitos','panceta','papa','zapallo','palta','papas congeladas','papel higienico','pasta dental','papel higienico',
  'paracetamol','panales','shampoo para bebe','alimento para perros','alimento para gatos','arena para gatos']"""


@query("s21_product_typeahead", f"""WITH t AS (SELECT term, min(ordinal) AS ordinal FROM (SELECT unnest({_PA}) AS term, unnest(range(20)) AS ordinal) GROUP BY 1),
  own AS (SELECT term FROM t ORDER BY starts_with(term, 'pa') DESC, ordinal LIMIT 6),
  more AS (SELECT p_name AS term, min(p_partkey) AS ordinal FROM part WHERE p_name NOT IN (SELECT term FROM own) GROUP BY 1 ORDER BY 2 LIMIT 2)
  SELECT term, 0 AS source FROM own UNION ALL SELECT term, 1 FROM more""")
def s21_product_typeahead(spark, sf_dir):
    terms = spark.createDataFrame(list(enumerate(rules.PRODUCTS)), "ordinal long, term string")
    live = domain.table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("ordinal"))
    return op.typeahead(terms, live, "pa")
