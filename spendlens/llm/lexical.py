"""Ranked lexical search over document-range blocks, pruned by the blocks' per-term maxima.

1. `index` sorts each window of stored documents (`WINDOW` of them, or about
   `WINDOW_BYTES` of text) by their most frequent term, which tells languages apart,
   and by length, and cuts it into blocks of at most `DOCS` documents and about
   `BYTES` of text: the more alike a block's documents are, the closer its maxima
   are to any of them. A block is one row: its forward index (for each document its terms and their counts, as
   indices into the block's vocabulary) and, for each term of the vocabulary, its
   document count, its largest count and the length of its shortest document.
   Those bound what the term can add to any score in the block, whatever the
   corpus' size and mean length turn out to be, so the index is built in one
   pass, and documents can be added to it without a rewrite.
2. N, L and the asked terms' df are summed over all blocks.
3. `search` takes the items in slices of bounded size. Each task bounds every
   item's score in each of its blocks by lookups of the item's terms among the
   maxima; the `FIRST` best blocks of each item in the whole corpus are scored and
   give its first threshold, the score of its TOP-th document so far.
4. One pass over the index then sorts each item's blocks by bound, scores forward
   blocks until the bound drops below the threshold, which rises with what is
   found, and keeps TOP documents an item and task. Blocks never move: only those
   few rows are shuffled.

Results are exact: a block is left out only if its bound is below a score that
TOP documents have reached, and all documents of a block that isn't are scored.

A null text or one without terms is in no block and isn't counted. Each row of
`docs` is a document; of equal scores the least doc_id is first (null last),
then the least row_hash. Rows of one item_id and text are one item, of one
item_id and several texts several; null ids are ids of their own. Very long
texts, and items, are taken whole (such a document is a block of few others).
Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches, utf8, work_dir, written

#: Documents, and bytes of text after which no more are added, of a block.
DOCS, BYTES = 16, 1 << 18
#: Documents that are sorted together, and the bytes of text after which no more are added.
WINDOW, WINDOW_BYTES = 1000, 1 << 22
#: Row groups of the index: bytes, measured every so many blocks. A reader holds a whole group, decoded to several times its bytes.
GROUP_BYTES, GROUP_BLOCKS = 1 << 22, 16
#: Blocks scored for each item's first threshold, and documents returned.
FIRST, TOP = 8, 10
#: Items, and terms of items, that one slice is expected to hold: what goes to every task.
SLICE_ITEMS, SLICE_TERMS = 2000, 100_000
#: Terms in lower-cased UTF-8: ASCII digits and letters, and whatever isn't ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

BLOCK = (
    "block long, doc_ids array<long>, hashes array<long>, lengths array<long>, vocabulary array<binary>, df array<int>, most_tf array<int>, least_length array<long>,"
    " ends array<int>, terms array<int>, tfs array<int>"
)


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes: A-Z only


class _Block:
    """Documents that are gathered into one row of the index."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.hashes: list[int] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.ends: list[int] = []
        self.terms: list[int] = []
        self.tfs: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, row_hash: int, counts: Counter, length: int, size: int) -> None:
        number = self.vocabulary
        self.ids.append(doc_id)
        self.hashes.append(row_hash)
        self.lengths.append(length)
        self.terms += [number.setdefault(t, len(number)) for t in counts]
        self.tfs += counts.values()
        self.ends.append(len(self.terms))
        self.bytes += size

    def row(self, block: int) -> list:
        terms, tfs = np.array(self.terms, np.int32), np.array(self.tfs, np.int32)
        order = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[order], np.arange(len(self.vocabulary)))
        lengths = np.repeat(np.array(self.lengths, np.int64), np.diff(self.ends, prepend=0))
        df = np.diff(starts, append=len(terms)).astype(np.int32)
        return [
            block, self.ids, self.hashes, self.lengths, list(self.vocabulary), df, np.maximum.reduceat(tfs[order], starts), np.minimum.reduceat(lengths[order], starts),
            np.array(self.ends, np.int32), terms, tfs,
        ]


_KINDS = [pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _windows(stream: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The documents with terms, by windows, like ones together: most frequent term, length, place, doc_id, row_hash, counts, bytes."""
    held: list[tuple] = []
    size = 0
    for batch in stream:
        for doc_id, row_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if found := terms_of(text):
                counts = Counter(found)
                held.append((max(counts, key=counts.get), len(found), len(held), doc_id, row_hash, counts, len(text)))
                size += len(text)
                if len(held) == WINDOW or size >= WINDOW_BYTES:
                    yield sorted(held, key=lambda d: d[:3])
                    held, size = [], 0
    yield sorted(held, key=lambda d: d[:3])


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, task = 0, TaskContext.get().partitionId()
    for window in _windows(stream):
        block = _Block()
        for k, (_, length, _, doc_id, row_hash, counts, size) in enumerate(window):
            block.add(doc_id, row_hash, counts, length, size)
            if len(block.ids) == DOCS or block.bytes >= BYTES or k + 1 == len(window):
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(block.row(task << 32 | done), _KINDS)], _NAMES)
                done, block = done + 1, _Block()


def index(docs: DataFrame) -> DataFrame:
    """The blocks of `docs` (doc_id, text), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text").where("text is not null")
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": GROUP_BLOCKS, "parquet.page.size.row.check.max": GROUP_BLOCKS}
    with batches(docs.sparkSession, rows=500, mb=4):
        return written(rows.mapInArrow(_blocks, BLOCK), "lexical-index", groups)


def _item_terms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        counts = [Counter(terms_of(t)) for t in utf8(batch.column(2))]
        who = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
        terms, times = pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), terms, times], ["item_id", "item_hash", "term", "times"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, item_hash, term, times: the distinct terms of each item (item_id, text), written to the shared folder."""
    rows = items.select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item_hash"), "text").where("text is not null").dropDuplicates(["item_id", "item_hash"])
    with batches(items.sparkSession):
        return written(rows.mapInArrow(_item_terms, "item_id long, item_hash long, term binary, times long"), "lexical-items")


class Slice:
    """Some items, with the terms they ask for and their weights, in arrays that go to every task."""

    def __init__(self, items: list, n: int, length: int):
        self.n, self.length = n, length
        asked = {t: None for i in items for t in i.terms}
        number = {t: k for k, t in enumerate(asked)}
        self.asked = pa.array(list(asked), pa.binary())
        self.sizes = [len(i.terms) for i in items]
        self.starts = np.cumsum([0, *self.sizes[:-1]])
        self.terms = np.array([number[t] for i in items for t in i.terms], np.int64)
        self.weights = np.array([w for i in items for w in i.weights], np.int64)

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to the score of a document."""
        tf, m = tf.astype(np.int64), 100 - 75 + (75 * length * self.n) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def found(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each block's vocabulary: the places of asked terms, and their numbers among the asked."""
        words = rows.column("vocabulary")
        number = pc.fill_null(pc.index_in(words.flatten(), value_set=self.asked), -1).to_numpy()
        for a, b in _parts(words):
            of = number[a:b]
            yield (at := np.flatnonzero(of >= 0)), of[at]

    def bounds(self, rows: pa.RecordBatch) -> np.ndarray:
        """For each block and item, no less than the best score in the block."""
        out = np.empty((rows.num_rows, len(self.sizes)), np.int64)
        tf, length = (rows.column(c).flatten().to_numpy() for c in ("most_tf", "least_length"))
        for k, ((a, _), (at, number)) in enumerate(zip(_parts(rows.column("vocabulary")), self.found(rows))):
            most = np.zeros(len(self.asked), np.int64)
            most[number] = self.impact(tf[a + at], length[a + at])
            out[k] = np.add.reduceat(self.weights * most[self.terms], self.starts)
        return out


def _parts(lists: pa.ListArray) -> list[tuple[int, int]]:
    """Where each list lies in the flattened values."""
    ends = np.asarray(lists.offsets)
    ends = ends - ends[0]
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def _best_blocks(items: Slice):
    """For each item, the FIRST blocks of the task with the largest bounds: item, block, bound."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bounds = np.empty(0, np.int64), np.empty((len(items.sizes), 0), np.int64)
        blocks = np.tile(blocks, (len(items.sizes), 1))
        for rows in stream:
            own = np.tile(rows.column("block").to_numpy(), (len(items.sizes), 1))
            blocks, bounds = np.hstack([blocks, own]), np.hstack([bounds, items.bounds(rows).T])
            best = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
            blocks, bounds = np.take_along_axis(blocks, best, 1), np.take_along_axis(bounds, best, 1)
        item, k = np.nonzero(bounds > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(blocks[item, k]), pa.array(bounds[item, k])], ["item", "block", "bound"])

    return run


_HIT = "item int, doc_id long, row_hash long, score long"


class _Scorer:
    """One block's impacts of asked terms by document, made when the first item asks for them."""

    def __init__(self, items: Slice, rows: pa.RecordBatch, k: int, found: tuple[np.ndarray, np.ndarray]):
        self.items, self.rows, self.k, self.found, self.impacts = items, rows, k, found, None

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name)[self.k].values.to_numpy(zero_copy_only=False)

    def open(self) -> None:
        at, number = self.found
        self.ids, self.hashes = self.rows.column("doc_ids")[self.k].as_py(), self.column("hashes")
        lengths, ends, terms = self.column("lengths"), self.column("ends"), self.column("terms")
        line = np.full(len(self.rows.column("vocabulary")[self.k]), -1)
        line[at] = np.arange(len(at))
        line = line[terms]
        some = np.flatnonzero(line >= 0)
        doc = np.searchsorted(ends, some, side="right")
        self.impacts = np.zeros((len(at) + 1, len(lengths)), np.int64)  # the last line is that of terms the block doesn't have
        self.impacts[line[some], doc] = self.items.impact(self.column("tfs")[some], lengths[doc])
        self.line = np.full(len(self.items.asked), len(at))
        self.line[number] = np.arange(len(at))

    def hits(self, item: int) -> list[tuple]:
        """Sort keys of the block's best documents for an item: -score, no id, id, hash."""
        if self.impacts is None:
            self.open()
        a = self.items.starts[item]
        b = a + self.items.sizes[item]
        scores = self.items.weights[a:b] @ self.impacts[self.line[self.items.terms[a:b]]]
        some = np.flatnonzero(scores > 0)
        if len(some) > TOP:
            some = some[scores[some] >= np.partition(scores[some], -TOP)[-TOP]]  # all of equal score: ids decide
        return [(-int(scores[d]), self.ids[d] is None, self.ids[d] or 0, int(self.hashes[d])) for d in some]


def _scored(items: Slice, thresholds: np.ndarray):
    """For each item, the TOP documents of the task's blocks, but for those below its threshold."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items.sizes]
        least = thresholds.copy()
        for rows in stream:
            bounds, found = items.bounds(rows), list(items.found(rows))
            blocks = [_Scorer(items, rows, k, found[k]) for k in range(rows.num_rows)]
            wanted = [set(w) for w in rows.column("items").to_pylist()] if "items" in rows.schema.names else None
            for i in np.flatnonzero((bounds >= np.maximum(least, 1)).any(axis=0)).tolist():
                for k in np.argsort(-bounds[:, i], kind="stable").tolist():
                    if bounds[k, i] < max(least[i], 1):
                        break
                    if wanted is None or i in wanted[k]:
                        best[i] = sorted(best[i] + blocks[k].hits(i))[:TOP]
                        if len(best[i]) == TOP:
                            least[i] = max(least[i], -best[i][-1][0])
        hits = [(i, None if h[1] else h[2], h[3], -h[0]) for i, found in enumerate(best) for h in found]
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], k) for c, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "doc_id", "row_hash", "score"])

    return run


def _ranked(hits: DataFrame, *item: str) -> DataFrame:
    order = Window.partitionBy(*item).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row_hash")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _search_slice(blocks: DataFrame, items: Slice) -> DataFrame:
    """item, doc_id, row_hash, score: the TOP documents for each item of a slice."""
    maxima = blocks.select("block", "vocabulary", "most_tf", "least_length")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = maxima.mapInArrow(_best_blocks(items), "item int, block long, bound long").withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIRST)
    # At most FIRST blocks for each item of the slice.
    first = written(first.groupBy("block").agg(F.collect_list("item").alias("items")), "lexical-first")
    forward = blocks.drop("df")
    none = np.zeros(len(items.sizes), np.int64)
    tops = _ranked(forward.join(F.broadcast(first), "block").mapInArrow(_scored(items, none), _HIT), "item").where(F.col("rank") == TOP)
    thresholds = none
    for row in tops.select("item", "score").collect():  # at most one for each item of the slice
        thresholds[row.item] = row.score
    return _ranked(forward.mapInArrow(_scored(items, thresholds), _HIT), "item").drop("rank")


def search(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, item_hash, rank, doc_id, row_hash, score: the TOP documents of `index` for each item of `item_terms`, of score above 0."""
    spark = blocks.sparkSession
    path = f"{work_dir(spark)}/lexical-hits-{uuid.uuid4().hex}"
    out = "item_id long, item_hash long, doc_id long, row_hash long, score long"
    spark.createDataFrame([], out).write.parquet(path)
    n, length = blocks.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_items, n_terms = asked.select("item_id", "item_hash").distinct().count(), asked.count()
    if n and n_terms:
        counts = blocks.select(F.inline(F.arrays_zip(F.col("vocabulary").alias("term"), "df"))).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        weighted = written(asked.join(counts, "term").select("item_id", "item_hash", "term", (F.col("times") * weight).alias("weight")), "lexical-asked")
        slices = max(1, -(-n_items // SLICE_ITEMS), -(-n_terms // SLICE_TERMS))
        for k in range(slices):
            of = weighted.where(F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(slices)) == k).groupBy("item_id", "item_hash")
            items = of.agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item_id", "item_hash", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")).collect()
            if items:
                keys = spark.createDataFrame([(i, r.item_id, r.item_hash) for i, r in enumerate(items)], "item int, item_id long, item_hash long")
                with batches(spark, rows=64):
                    hits = _search_slice(blocks, Slice(items, n, length))
                    hits.join(F.broadcast(keys), "item").select("item_id", "item_hash", "doc_id", "row_hash", "score").write.mode("append").parquet(path)
    return _ranked(spark.read.schema(out).parquet(path), "item_id", "item_hash").select("item_id", "item_hash", "rank", "doc_id", "row_hash", "score")


def brute_force(docs: list[tuple], items: list[tuple]) -> dict:
    """item_id -> [(doc_id, score)] by scoring every document of (doc_id, text) for each of (item_id, text)."""
    import math

    counts = [(d, Counter(terms_of((t or "").encode()))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        hits = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of((text or "").encode()) if t in c)
            hits += [(-score, d is None, d or 0, d)] if score > 0 else []
        out[item] = [(h[3], -h[0]) for h in sorted(hits, key=lambda h: h[:3])[:TOP]]
    return out
