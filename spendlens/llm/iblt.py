"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A document is the set of its paragraphs' 64-bit digests (lines with something
in them, trimmed). Its sketch has `CELLS` cells in three rows; a digest goes to
one cell of each row, and a cell holds the number of its digests, their XOR
and the XOR of their check values. Cell by cell, one sketch less another is the
sketch of what differs. `peel` recovers that: a cell of one digest (count 1 or
-1 and a check value that fits) gives it away, it leaves its other cells, and
so on until nothing is left. If peeling gets stuck, the sketch was too small:
`differing` tries sketches of 4 times the cells, then twice as many again and
again, each with other hashes, until one peels; documents of many paragraphs
are split by digest into parts of about `PART`. The likeness is the Jaccard similarity of the two sets,
from their sizes and the number of digests that differ.

`with_next` puts each row beside the next one in descending order of doc_id
(then of a hash of the text; null ids last; the first follows the last). Rows
are dealt by ranges of ids between quantiles, of about max(1024, rows / 4096)
rows each, null ids by ranges of the hash, and the first row of each range is
copied to the range before, so that no window holds more than a range and the
rows of its last id; the heads of at most 8192 ranges are broadcast.

Null texts count as empty, and two empty sets are alike (1). Repeated rows
follow each other. Other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 24
ROWS = 3
RETRY, DOUBLINGS = 4, 12
PART = 256
#: Rows of a range of ids, at least, and ranges, at most.
LEAST_RANGE, RANGES = 1024, 4096
#: Rounds of peeling after which a sketch counts as stuck; each round frees at least one digest.
ROUNDS = 40


def let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cell(key: Column, row: int, cells: Column) -> Column:
    """The cell of a digest in a row: cells of row r are r, r + 3, r + 6, ..."""
    return (F.pmod(F.xxhash64(key, F.lit(row), cells), (cells / ROWS).cast("long")) * ROWS + row).cast("int")


def _placed(key: Column, sign: Column, cells: Column) -> Column:
    return F.struct(sign.cast("int").alias("s"), key.alias("k"), _check(key).alias("h"), *(_cell(key, r, cells).alias(f"c{r}") for r in range(ROWS)))


def _in(p: Column, c: Column) -> Column:
    return (p["c0"] == c) | (p["c1"] == c) | (p["c2"] == c)


def _empty_cell() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def _with(cell: Column, p: Column, times: int) -> Column:
    return F.struct((cell["n"] + p["s"] * times).alias("n"), cell["k"].bitwiseXOR(p["k"]).alias("k"), cell["h"].bitwiseXOR(p["h"]).alias("h"))


def sketch(keys: Column, cells: Column) -> Column:
    """The cells of a set of digests."""
    return let(
        F.transform(keys, lambda k: _placed(k, F.lit(1), cells)),
        lambda placed: F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.aggregate(F.filter(placed, lambda p: _in(p, c)), _empty_cell(), lambda a, p: _with(a, p, 1))),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, cells: Column) -> Column:
    """struct<cells, found, go>: what is left, the digests found (k, s: 1 from the first set, -1 from the second)."""
    start = F.struct(
        difference.alias("cells"), F.array().cast("array<struct<s:int,k:bigint>>").alias("found"), F.lit(True).alias("go")
    )

    def step(a: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(a["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"]))), lambda x: F.struct(x["n"].alias("s"), x["k"].alias("k"))))
        free = lambda new: let(
            F.transform(new, lambda x: _placed(x["k"], x["s"], cells)),
            lambda placed: F.transform(a["cells"], lambda x, c: F.aggregate(F.filter(placed, lambda p: _in(p, c)), x, lambda y, p: _with(y, p, -1))),
        )
        next_ = lambda new: F.when(
            F.size(new) > 0, F.struct(free(new).alias("cells"), F.concat(a["found"], new).alias("found"), F.lit(True).alias("go"))
        ).otherwise(F.struct(a["cells"].alias("cells"), a["found"].alias("found"), F.lit(False).alias("go")))
        return F.when(a["go"], let(pure, next_)).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _count_if_peeled(difference: Column, cells: Column) -> Column:
    """How many digests differ; null if peeling got stuck."""
    return let(peel(difference, cells), lambda p: F.when(~F.exists(p["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0)), F.size(p["found"])))


def differing(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """The number of digests in one of the sets only: from the base sketches, else from larger ones by parts."""
    parts = F.ceil((F.size(a) + F.size(b)) / PART).cast("long")

    def larger(x: Column, y: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("n"), F.lit(CELLS * RETRY).alias("cells"))
        again = lambda a: F.struct(_count_if_peeled(subtract(sketch(x, a["cells"]), sketch(y, a["cells"])), a["cells"]).alias("n"), (a["cells"] * 2).alias("cells"))
        tries = F.aggregate(F.sequence(F.lit(1), F.lit(DOUBLINGS)), start, lambda a, _: F.when(a["n"].isNotNull(), a).otherwise(again(a)), lambda a: a["n"])
        return F.coalesce(tries, F.raise_error(F.lit("a sketch didn't peel")).cast("int"))

    own = lambda keys, s: F.filter(keys, lambda k: F.pmod(k, parts) == s)
    retried = F.aggregate(F.sequence(F.lit(0).cast("long"), parts - 1), F.lit(0), lambda n, s: n + larger(own(a, s), own(b, s)))
    return F.coalesce(_count_if_peeled(subtract(base_a, base_b), F.lit(CELLS)), retried)


def likeness(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(let(differing(a, b, base_a, base_b), lambda d: (total - d) / (total + d)))


def written_out(keys: Column, base: Column) -> Column:
    """A sketch as text: the set's size, then count, digests and check values of each cell in hexadecimal."""
    cell = lambda x: F.concat_ws(".", x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"])))
    return F.concat(F.size(keys).cast("string"), F.lit("/"), F.array_join(F.transform(base, lambda x: F.when((x["n"] == 0) & (x["k"] == 0), F.lit("-")).otherwise(cell(x))), " "))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value (null if it is null), in two steps of about sqrt(cuts) comparisons."""
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return value * 0
    upto = lambda some: F.size(F.filter(some, lambda c: c <= value))
    lists = F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) for g in groups))
    k = upto(F.array(*(F.lit(g[0]).cast("long") for g in groups)))
    found = F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + upto(F.get(lists, k - 1)))
    return F.when(value.isNotNull(), found)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: null texts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = rows.agg(F.count("doc_id").alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    ranges = lambda n: max(1, min(RANGES, -(-n // LEAST_RANGE)))
    many, of_nulls = ranges(stats["n"]), ranges(stats["nulls"])
    cuts = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 4 * RANGES)).first()[0] if many > 1 else None
    keyed = rows.withColumn("row_hash", F.xxhash64("text"))
    # Null ids come last, in the order of their hashes: their ranges count down from -1.
    of_hash = F.least(F.floor((F.col("row_hash") / F.lit(2.0**64) + 0.5) * of_nulls), F.lit(of_nulls - 1))
    keyed = keyed.withColumn("bucket", F.coalesce(_range_of(F.col("doc_id"), sorted(set(cuts or []))), -1 - of_hash).cast("long"))
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("row_hash").alias("low_hash"))).alias("head"))
    every = W.orderBy("bucket")
    around = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    to = heads.select(
        F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(around)).alias("to"),
        F.col("bucket").alias("from"), F.col("head.doc_id").alias("head_id"), F.bitwise_not(F.col("head.low_hash")).alias("head_hash"),
    )
    guests = (
        keyed.join(F.broadcast(to), (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("row_hash") == F.col("head_hash")))
        .select("doc_id", "text", "row_hash", F.col("to").alias("bucket")).dropDuplicates(["bucket"]).withColumn("guest", F.lit(1))
    )
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "row_hash")
    return (
        keyed.withColumn("guest", F.lit(0)).unionByName(guests)
        .withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs` (doc_id, text)."""
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    for name, text in (("own", "text"), ("new", "edited"), ("next", "next_text")):
        rows = rows.withColumn(f"{name}_keys", paragraphs(F.col(text)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "own_keys", "new_keys", "next_keys")
    for name in ("own", "new", "next"):
        rows = rows.withColumn(name, sketch(F.col(f"{name}_keys"), F.lit(CELLS)))
    near = lambda x: likeness(F.col("own_keys"), F.col(f"{x}_keys"), F.col("own"), F.col(x))
    return rows.select(
        "doc_id", "n_chars", "edited", written_out(F.col("own_keys"), F.col("own")).alias("fingerprint"),
        written_out(F.col("new_keys"), F.col("new")).alias("edited_fingerprint"), near("new").alias("near_edited"), near("next").alias("near_next"),
    )
