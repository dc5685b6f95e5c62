"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Leaves are (domain, language, source). A token budget is divided top down:
among domains, within each among languages, within each among sources, in
proportion to target weights. No node gets more than its capacity, the tokens
of its leaves times `epochs`; what a node can't use goes to its siblings in
proportion to their weights. A parent's capacity is the sum of its children's,
so a shortage passes to siblings first and reaches the parent's siblings only
when all of them are full.

Each leaf then takes a prefix of its seeded epochs: epoch e orders its
documents by md5(seed:e:doc_id), whole epochs come first, and the last one is
read until the leaf's quota of tokens is full; the last document may be cut.
The order is cut into buckets by the digest's first digits, whose sums are
small, and only the bucket that the quota ends in is summed row by row. So a
leaf with a third of all rows is never sorted in one task.

Divisions are of integers, rounded down; what rounding leaves over (less than
a token a node) stays unused. Tokens are words between white space. Null or
empty texts have no tokens and are never taken. A null domain, language or
source is a value of its own, named ''. Repeated rows with one doc_id are told
apart by their text, and equal ones share their fate. Weights that aren't
listed are `other`; weight 0 takes nothing. No rows: no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, written

#: Hex digits that make a bucket of a leaf's order: 4096 buckets.
DIGITS = 3
LEVELS = ("domain", "language", "source")
_WIDE = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def weight_of(name: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, weight in weights.items():
        out = F.when(F.col(name) == value, weight).otherwise(out)
    return out.cast("long")


def _divide(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Column `quota`: `budget` of each parent among its children by weight, none above its capacity.

    Children are full in the order of capacity by weight; the first that isn't
    full settles the level for all that follow.
    """
    order = W.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), "node") if parent else W.orderBy((F.col("capacity") / F.col("weight")), "node")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    wide = lambda c: c.cast(_WIDE)
    left = wide(budget) - wide(F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    share = F.sum("weight").over(after)
    steps = nodes.where("weight > 0 and capacity > 0").withColumn("left", F.greatest(left, wide(F.lit(0)))).withColumn("share", share)
    # Full: capacity / weight <= left / share. Once one isn't full, none after it is, and all divide alike.
    full = wide(F.col("capacity")) * wide(F.col("share")) <= wide(F.col("left")) * wide(F.col("weight"))
    open_ = order.rowsBetween(W.unboundedPreceding, 0)
    at_left = F.first(F.when(~F.col("full"), F.col("left")), ignorenulls=True).over(open_)
    at_share = F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(open_)
    return (
        steps.withColumn("full", full).withColumn("at_left", at_left).withColumn("at_share", at_share)
        .withColumn("quota", F.when(F.col("at_left").isNull(), F.col("capacity")).otherwise(F.expr("cast((at_left * cast(weight as decimal(38,0))) div at_share as long)")))
        .drop("left", "share", "full", "at_left", "at_share")
    )


def quotas(leaves: DataFrame, budget: int, epochs: int, weights: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """domain, language, source, tokens, quota of each leaf with a quota.

    `leaves`: domain, language, source, tokens. `weights`: for each level the
    listed weights and that of other values.
    """
    level = leaves.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    given = None
    for depth, name in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = level.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(name, *weights[name])).withColumn("node", F.col(name))
        if given is None:
            given = _divide(nodes, [], F.lit(budget))
        else:
            above = given.select(*parent, F.col("quota").alias("budget"))
            given = _divide(nodes.join(above, parent), parent, F.col("budget")).drop("budget")
    return given.select(*LEVELS, "tokens", "quota")


def draw(rows: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """The rows (leaf columns, doc_id, tokens, ...) with epochs (whole ones), taken (tokens of the last epoch), drawn (all tokens).

    Only rows from which something is drawn.
    """
    planned = quota.where("quota > 0").select(*LEVELS, F.expr("quota div tokens").alias("epochs"), F.expr("quota % tokens").alias("rest"))
    dealt = rows.where("tokens > 0").join(planned, list(LEVELS)).withColumn(
        "turn", F.md5(F.concat(F.lit(f"{seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ).withColumn("bucket", F.substring("turn", 1, DIGITS))
    sums = dealt.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"))
    upto = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "n")
    placed = dealt.join(before, [*LEVELS, "bucket"])
    whole = placed.where("before + n <= rest").withColumn("taken", F.col("tokens"))
    none = placed.where("before >= rest").withColumn("taken", F.lit(0).cast("long"))
    inside = W.partitionBy(*LEVELS, "bucket").orderBy("turn", "row_hash").rowsBetween(W.unboundedPreceding, -1)
    partly = placed.where("before < rest and before + n > rest").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    partly = partly.withColumn("taken", F.greatest(F.least(F.col("tokens"), F.col("rest") - F.col("at")), F.lit(0))).drop("at")
    out = whole.unionByName(none).unionByName(partly)
    return out.withColumn("drawn", F.col("epochs") * F.col("tokens") + F.col("taken")).where("drawn > 0").drop("turn", "bucket", "before", "n", "rest")


def leaves_of(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, row_hash, domain, language, source, tokens of each row of `docs` (doc_id, text, lang, source)."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), empty(domain).alias("domain"), empty(F.col("lang")).alias("language"), empty(F.col("source")).alias("source"), tokens_of(F.col("text")).alias("tokens"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, tuple[dict[str, int], int]], share: float, epochs: int, seed: int) -> DataFrame:
    """What is drawn of each document for a budget of `share` of all tokens (in thousandths)."""
    rows = written(leaves_of(docs, domain), "op6-leaves")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    return draw(rows, quotas(rows.select(*LEVELS, "tokens"), total * round(1000 * share) // 1000, epochs, weights), seed)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    space = "\\x20\\x09-\\x0D"
    return F.array_join(F.slice(F.split(text, f"(?<=[^{space}])(?=[{space}])"), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, domain: Column, weights: dict[str, tuple[dict[str, int], int]], share: float, epochs: int, seed: int) -> DataFrame:
    """The columns of `docs`, one row for each time a row is drawn: its whole text for each epoch, and the text's prefix where the last epoch ends in it.

    n_chars, if there, is counted anew. Rows of equal doc_id and text share the first one's fate.
    """
    drawn = (
        mix(docs, domain, weights, share, epochs, seed).groupBy("doc_id", "row_hash")
        .agg(F.max("epochs").cast("int").alias("__epochs"), F.max("taken").alias("__taken"), F.max("tokens").alias("__tokens"))
        .withColumnsRenamed({"doc_id": "__id", "row_hash": "__hash"})
    )
    rows = docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")))
    turns = F.sequence(F.lit(1), F.col("__epochs") + F.when(F.col("__taken") > 0, 1).otherwise(0))
    each = rows.withColumn("__turn", F.explode(turns))
    last = (F.col("__turn") > F.col("__epochs")) & (F.col("__taken") < F.col("__tokens"))
    text = F.when(last, first_words(docs["text"], F.col("__taken"))).otherwise(docs["text"])
    new = {"text": text, "n_chars": F.when(last, F.length(text)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return each.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
