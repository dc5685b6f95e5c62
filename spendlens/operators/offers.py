"""Product search and basket comparison over the offers of many stores.

Offers: store_id, ordinal, name, price. Distinct product names are indexed by
their grams; searches and items are looked up there, so that only names that can
match are scored, once each however many stores offer them. Ties go to the
offer with the least ordinal, then store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spendlens import shared
from spendlens.functions import rules, text
from spendlens.functions.numbers import half_up, lenient_limit, rounded
from spendlens.sources.domain import store_kind

from . import gram_index, ranks


def first_per_store(offers: DataFrame, n: int = 12) -> DataFrame:
    return offers.withColumn("place", F.row_number().over(W.partitionBy("store_id").orderBy("ordinal"))).where(F.col("place") <= n).drop("place")


def sells(store: Column, category: str | None, store_ids: list[int] | None = None) -> Column:
    """Whether a store sells a category and is one of the given stores, where these are given."""
    kinds = F.array(*(F.array(*map(F.lit, k)) for k in rules.STORE_KINDS))
    out = F.array_contains(F.get(kinds, store_kind(store)), category) if category else F.lit(True)
    return out & store.isin(store_ids) if store_ids else out


def stores_of_category(offers: DataFrame, category: str | None, store_ids: list[int] | None = None) -> DataFrame:
    """The offers of the stores that sell a category, and of the given stores."""
    return offers.where(sells(F.col("store_id"), category, store_ids))


def _asked(offers: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return offers.sparkSession.createDataFrame(rows, schema)


class NameIndex:
    """The distinct names' postings and how many names have each gram, written once; every search reads them there."""

    def __init__(self, names: DataFrame, key: str, least: int = gram_index.SIZE):
        self.key = key
        self.postings = shared.written(gram_index.postings(names, key, least), "names")
        self.counts = shared.written(gram_index.text_counts(self.postings), "grams")

    def containing(self, words: DataFrame) -> DataFrame:
        return gram_index.containing(words, self.postings, self.counts, "word", self.key)


def name_index(offers: DataFrame) -> NameIndex:
    """name, folded: the names as searches see them."""
    return NameIndex(offers.select("name").distinct().withColumn("folded", text.fold(F.col("name"))), "folded")


def judged_strictly(index: NameIndex, queries: DataFrame) -> DataFrame:
    """query, name, score of the names that have all keywords of a query (query, words), found by its rarest keyword; written, as more than one step asks for them."""
    words = queries.select("query", "words", F.explode("words").alias("word"))
    anchor = gram_index.rarest(words, index.counts, "word").groupBy("query", "words").agg(F.min_by(F.struct("word", "gram"), F.struct("texts", "word")).alias("a"), F.count_distinct("word").alias("known"))
    anchor = anchor.where(F.col("known") == F.size(F.array_distinct("words"))).select("query", "words", "a.word", "a.gram")
    found = _scored(anchor.join(index.postings, "gram")).where((F.col("verdict.score") > 0) & (F.col("verdict.matched") >= F.size("words")))
    return shared.written(found.select("query", "name", "verdict.score"), "strict")


def judged_loosely(index: NameIndex, queries: DataFrame) -> DataFrame:
    """query, name, score of the names that have a query's first keyword, and one of its keywords in their first word; queries of one keyword have none."""
    first = queries.where(F.size("words") > 1).withColumn("word", F.get("words", F.lit(0)))
    found = _scored(index.containing(first))
    return found.where((F.col("verdict.score") > 0) & F.col("verdict.main_noun")).select("query", "name", "verdict.score")


def _scored(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("verdict", text.search_score(text.fold(F.col("query")), F.col("words"), F.col("folded")))


def with_keywords(offers: DataFrame, queries: list[str]) -> DataFrame:
    """query, words of the searches of two characters or more."""
    asked = _asked(offers, [(q,) for q in dict.fromkeys(queries) if len(q.strip()) >= 2], "query string")
    return asked.withColumn("words", text.keywords(F.col("query")))


def matching(offers: DataFrame, queries: list[str]) -> DataFrame:
    """The offers that each query finds, with query and score, in no order.

    Strict: all keywords. If nothing at all passes and there are several
    keywords: the first keyword in the name and a keyword in its first word.
    Without keywords every offer counts, by price. Names come from an index of
    grams, so that any number of queries can be asked at once.
    """
    asked, index = with_keywords(offers, queries), name_index(offers)
    strict = judged_strictly(index, asked.where(F.size("words") > 0))
    without = asked.where(F.size("words") > 1).join(strict.select("query").distinct(), "query", "left_anti")
    found = offers.join(strict.unionByName(judged_loosely(index, without)) if without.limit(1).count() else strict, "name")
    every = asked.where(F.size("words") == 0).select("query", F.lit(0).alias("score"))
    return found.unionByName(offers.join(F.broadcast(every))) if every.limit(1).count() else found


def search(offers: DataFrame, queries: list[str], limit: int | None = None) -> DataFrame:
    """query, place, store_id, name, price, score of each query's offers, best first."""
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "price", "ordinal", "store_id")
    ranked = matching(offers, queries).withColumn("place", F.row_number().over(order))
    if limit:
        ranked = ranked.where(F.col("place") <= limit)
    return ranked.select("query", "place", "store_id", "name", "price", "score")


def limited(ranked: DataFrame, limits: DataFrame) -> DataFrame:
    """Ranked rows (query, place, ...) under each limit as typed (query, limit): see `lenient_limit`."""
    asked = limits.select("query", "limit", lenient_limit(F.col("limit")).alias("rows"))
    counts = ranked.groupBy("query").agg(F.max("place").alias("found"))
    cut = asked.join(counts, "query").withColumn("last", F.when(F.col("rows").isNull(), F.col("found")).when(F.col("rows") >= 0, F.col("rows")).otherwise(F.col("found") + F.col("rows")))
    return ranked.join(cut.select("query", "limit", "last"), "query").where(F.col("place") <= F.col("last")).drop("last")


def price_stats(found: DataFrame) -> DataFrame:
    """Least, greatest and mean price and the number of offers and stores of each query."""
    return found.groupBy("query").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), half_up(F.avg("price")).alias("avg_price"), F.count("*").alias("n"), F.count_distinct("store_id").alias("stores")
    )


def merged_stats(found: DataFrame) -> DataFrame:
    """query, store_id, n, min_price, max_price, avg_price: the statistics of a query's offers as its stores' results come in, in order of store.

    Offers are summed by store first, so that a query's window has a row for each store.
    """
    of_store = found.groupBy("query", "store_id").agg(F.count("*").alias("k"), F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("sum"))
    so_far = W.partitionBy("query").orderBy("store_id")
    return of_store.select(
        "query", "store_id", F.sum("k").over(so_far).alias("n"), F.min("low").over(so_far).alias("min_price"), F.max("high").over(so_far).alias("max_price"),
        half_up(F.sum("sum").over(so_far) / F.sum("k").over(so_far)).alias("avg_price"),
    )


def relevant_names(offers: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `items` (item, ...) with name and score for each relevant name: it has the first token of the item, or a synonym of it, and half of all.

    An item without tokens finds every name; its score is 0.
    """
    names = offers.select("name").distinct().withColumn("product", text.product_key(F.col("name")))
    index = NameIndex(names, "product", 2)
    asked = items.withColumn("words", text.tokens(F.col("item")))
    some = asked.where(F.size("words") > 0).withColumn("word", F.explode(text.with_synonyms(F.get("words", F.lit(0)))))
    found = index.containing(some).where(text.is_relevant(F.col("words"), F.col("product")))
    scored = found.withColumn("score", text.relevance(F.col("words"), F.col("product"))).select(*items.columns, "name", "score").distinct()
    every = asked.where(F.size("words") == 0).select(*items.columns)
    return scored.unionByName(every.join(names.select("name", F.lit(0.0).alias("score")))) if every.limit(1).count() else scored


def best_offers(offers: DataFrame, items: list[tuple[int, str, int]]) -> DataFrame:
    """item_id, item, quantity, store_id, name, price, score: each store's best relevant offer for each item."""
    judged = relevant_names(offers, _asked(offers, items, "item_id int, item string, quantity int"))
    order = W.partitionBy("item_id", "store_id").orderBy(F.col("score").desc(), "price", "ordinal")
    return (
        offers.join(judged, "name").withColumn("place", F.row_number().over(order)).where("place = 1")
        .select("item_id", "item", "quantity", "store_id", "name", "price", "score")
    )


def options(best: DataFrame, n: int = 4) -> DataFrame:
    """Each item's n cheapest stores."""
    return best.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("price", "store_id"))).where(F.col("place") <= n)


def store_baskets(best: DataFrame, items: list[tuple[int, str, int]]) -> DataFrame:
    """Each store's basket: total, rows found, names missing, and whether it is full."""
    names = F.array(*map(F.lit, dict.fromkeys(i[1] for i in items)))
    return best.groupBy("store_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("total"), F.count("*").alias("found"), F.array_join(F.array_sort(F.array_except(names, F.collect_set("item"))), ",").alias("missing")
    ).withColumn("is_full", F.col("found") == len(items))


def store_totals(best: DataFrame, items: list[tuple[int, str, int]]) -> DataFrame:
    """`store_baskets` with rank: full stores by total in cents, then others by found; totals that differ by less are equal."""
    cents = rounded(F.col("total"), 2)
    rank_by = [F.col("is_full").desc(), F.when(F.col("is_full"), cents).asc_nulls_last(), F.when(~F.col("is_full"), F.col("found")).desc_nulls_last(), F.col("store_id").asc()]
    return ranks.ranked(store_baskets(best, items), "rank", *rank_by)


def optimal(best: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: the total of each item's cheapest offer, the cheapest full store, and what shopping around saves."""
    cheapest = best.groupBy("item_id", "quantity").agg(F.min("price").alias("price")).agg(F.sum(F.col("price") * F.col("quantity")).alias("optimal_total"))
    full = totals.agg(F.min(F.when(F.col("is_full"), F.col("total"))).alias("best_store_total"))
    return cheapest.join(full).select("optimal_total", "best_store_total", F.greatest(F.lit(0.0), F.col("best_store_total") - F.col("optimal_total")).alias("savings"))


def category_catalog(stores: DataFrame) -> DataFrame:
    """Each category with its stores (store_id), in order."""
    kinds = F.array(*(F.array(*map(F.lit, k)) for k in rules.STORE_KINDS))
    listed = stores.select("store_id", F.explode(F.get(kinds, store_kind(F.col("store_id")))).alias("category"))
    return listed.groupBy("category").agg(F.count("*").alias("stores"), F.array_join(F.transform(F.array_sort(F.collect_list("store_id")), lambda x: x.cast("string")), ",").alias("store_ids"))


def typeahead(terms: DataFrame, live: DataFrame, typed: str, local: int = 6, n: int = 8) -> DataFrame:
    """Suggestions (place, term): up to `local` known terms that contain what is typed, those that start with it first, then live ones not among them; n in all."""
    key = text.fold(F.lit(typed))
    own = terms.groupBy("term").agg(F.min("ordinal").alias("ordinal")).withColumn("key", text.fold(F.col("term"))).where(F.contains("key", key))
    own = own.orderBy(F.col("key").startswith(key).desc(), "ordinal").limit(local)
    own = own.select("term", "key", F.struct(F.lit(0).alias("source"), (~F.col("key").startswith(key)).cast("long").alias("late"), "ordinal").alias("order"))
    new = live.groupBy("term").agg(F.min("ordinal").alias("ordinal")).withColumn("key", text.fold(F.col("term"))).join(own.select("key"), "key", "left_anti")
    both = own.unionByName(new.select("term", "key", F.struct(F.lit(1).alias("source"), F.lit(0).cast("long").alias("late"), "ordinal").alias("order")))
    return both.orderBy("order").limit(n).select("term", F.col("order.source").alias("source"))


#: Characters of the longest key that the table of suggestions holds.
TYPED = 32


def typeahead_table(terms: DataFrame, n: int = 6) -> DataFrame:
    """key, place, term: for whatever may be typed, the n best known terms, those that start with it first, then by ordinal.

    Keys are all parts of folded terms of up to TYPED characters, and the empty
    one, so a lookup is one equality. Tasks keep n rows of a key before they are
    dealt, so that a part that very many terms share costs no more than another.
    """
    own = terms.groupBy("term").agg(F.min("ordinal").alias("ordinal")).withColumn("folded", text.fold(F.col("term"))).where("folded is not null")
    length = F.length("folded")
    parts = lambda i: F.transform(F.sequence(F.lit(1), F.least(length - i + 1, F.lit(TYPED))), lambda k: F.substring(F.col("folded"), i, k))
    keys = F.when(length > 0, F.flatten(F.transform(F.sequence(F.lit(1), length), parts))).otherwise(F.array().cast("array<string>"))
    rows = own.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), keys))))
    order = W.partitionBy("key").orderBy(F.col("folded").startswith(F.col("key")).desc(), "ordinal", "term")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("key", "place", "term")
