"""Substring dedup by column-wise construction over a collection of documents.

A string of `length` bytes (400) that starts at two places of the corpus is
removed at both, or at all but the first. The corpus is first cut at *anchors*:
every window of 400 bytes picks the 100-byte gram in it with the least hash
(the leftmost of equals). Equal windows pick equal grams at equal offsets, so
they meet under one anchor hash, and a run of starts that share an anchor makes
one segment. The segments of an anchor are the collection's strings: a round
of the whole corpus for each column of its longest document is beyond any
cluster, while equal windows lie in the same column counted from their anchor,
so that each anchor is a collection of its own with a few hundred columns.

1. `segments` lists the segments of each text (Arrow, vectorised in numpy).
   Anchors are counted; those that occur once are done with.
2. Copies of a segment, however many, are folded into one row by partial
   aggregation on 128-bit digests; whole copies need no bytes.
3. Anchors that still hold different segments send one of each kind to
   `repeated_starts`. It inserts one symbol per string each round, from right
   to left, and keeps the collection's order, its Burrows-Wheeler symbols and
   the neighbours' common prefixes; a common prefix of 400 marks both starts.
   They go from round to round through sequential files in the shared folder
   (`Rounds`): a round reads the last one's once, in order, and writes the next.
   A round of at most `BUFFER` bytes stays in the task's write buffer.
4. An anchor with more than `TOGETHER` kinds is split (`_halves`): its columns
   into two ranges, and the strings by what all windows of a range share, which
   equal windows do. This is repeated until the parts fit; at a single column
   a part is one kind. No task ever holds an unbounded anchor.

First means the least doc_id (null last), then row_hash (of the text), then
place; if only the first is kept, rows of one id and text count as one and get
equal results. Nulls count as empty texts; texts shorter than 400 bytes have no
window and stay whole; repeated rows are repeats of each other; very long texts
are searched whole, in pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, utf8, work_dir, written
from .hashing import gram_hashes

LENGTH = 400
GRAM = 100
#: Segments that one call of `repeated_starts` sorts together, about, and at most of one anchor.
TOGETHER = 8192
#: Bytes of one round that are held without a file; opening two files a round costs more than sorting so few.
BUFFER = 1 << 16

#: Texts are searched for anchors in pieces of this size; positions must fit 24 bits.
_PIECE = 1 << 22


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run of window starts with one anchor: its hash, first and last start, anchor position."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    parts, at, starts = [], 0, len(data) - length + 1
    while at < starts:
        parts.append((at, _anchors(data[at : at + _PIECE + length - 1], length, gram)))
        at += _PIECE
    key, low, high, pos = (np.concatenate([p[i] + (np.uint64(0) if i == 0 else a) for a, p in parts]) for i in range(4))
    return key, low, high, pos


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    h = gram_hashes(data, gram)
    m, width = len(h), length - gram + 1
    low24 = np.uint64(0xFFFFFF)
    v = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
    v[:m] = (h & ~low24) | np.arange(m, dtype=np.uint64)
    blocks = v.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - width + 1
    pos = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low24).astype(np.int64)
    cut = np.flatnonzero(np.diff(pos)) + 1
    low = np.concatenate([[0], cut])
    high = np.concatenate([cut - 1, [count - 1]])
    return h[pos[low]], low, high, pos[low]


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, out, digests = [], ([], [], [], []), []
            for text in utf8(batch.column(2)):
                found = anchors(np.frombuffer(text, np.uint8), length, gram)
                many.append(len(found[0]))
                for column, v in zip(out, found):
                    column.append(v)
                digests += [xxhash.xxh3_128_digest(text[a : b + length]) for a, b in zip(found[1].tolist(), found[2].tolist())]
            if not digests:
                continue
            key, low, high, pos = (np.concatenate(v) for v in out)
            who = pa.array(np.repeat(np.arange(len(many)), many))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            place = (pos << 24) | ((pos - low) << 12) | (high - low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(key.view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(place)],
                ["doc_id", "row_hash", "anchor", "d1", "d2", "place"],
            )

    return run


def segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, row_hash, anchor, d1, d2 (digest of the segment's bytes), place: one row per segment.

    place holds the anchor's position, the starts before it and the starts after the first, in 39, 12 and 12 bits.
    """
    if not 0 < gram <= length < gram + 4096:
        raise ValueError("an anchor must lie in its window, at fewer than 4096 places")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
        _segments(length, gram), "doc_id long, row_hash long, anchor long, d1 long, d2 long, place long"
    )


class Rounds:
    """The arrays of the last round, in a sequential file of a folder that Spark's tasks share, or in the buffer if they are small."""

    def __init__(self, folder: str | None):
        self.fs, self.filed = None, False
        if folder:
            from pyarrow import fs

            self.fs, path = fs.FileSystem.from_uri(folder)
            self.base = f"{path}/{uuid.uuid4().hex}"
        self.last: list[np.ndarray] = []
        self.turn = 0

    def write(self, *arrays: np.ndarray) -> None:
        if not self.fs or sum(a.nbytes for a in arrays) <= BUFFER:
            self.last = list(arrays)
            return
        if not self.filed:
            self.fs.create_dir(self.base)
            self.filed = True
        self.kinds = [(a.dtype, len(a)) for a in arrays]
        self.turn += 1
        with self.fs.open_output_stream(f"{self.base}/{self.turn % 2}") as out:
            for a in arrays:
                out.write(a.tobytes())

    def read(self) -> list[np.ndarray]:
        if not self.filed:
            return self.last
        with self.fs.open_input_stream(f"{self.base}/{self.turn % 2}") as some:
            return [np.frombuffer(some.read(kind.itemsize * n), kind) for kind, n in self.kinds]

    def close(self) -> None:
        if self.filed:
            self.fs.delete_dir(self.base)


def columns(strings: list[bytes], before: list[int], group: np.ndarray, folder: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Insert one symbol per string each round; yield (column, order, common prefixes, symbols).

    String i has `before[i]` symbols left of column 0; groups (sorted, small
    integers) never mix. In each round `order` sorts the suffixes that start in
    this column, `common[j]` is the prefix that order[j-1] and order[j] share,
    and symbols[j] is the Burrows-Wheeler symbol of order[j]: the one before
    the suffix, which the next round inserts (0 where the string begins).
    With a folder the three go from round to round through files there.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    before_ = np.asarray(before, np.int64)
    left = int(before_.max())
    right = int((sizes - before_).max())
    # One row per column, so that each round reads one row: symbol + 1, and 0 where a string has none.
    grid = np.zeros((left + right + 1, n), np.uint16)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    who = np.repeat(np.arange(n), sizes)
    where = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left - before_, sizes)
    grid[where + 1, who] = flat.astype(np.uint16) + 1
    group = np.asarray(group).astype(np.uint16)
    index = np.arange(n)
    rounds = Rounds(folder)
    try:
        rounds.write(index, np.zeros(n, np.int32), grid[left + right])
        for row in range(left + right, 0, -1):
            order, common, symbols = rounds.read()
            moved = np.argsort(symbols, kind="stable")
            moved = moved[np.argsort(group[order[moved]], kind="stable")]
            new, now = order[moved], symbols[moved]
            same = np.zeros(n, bool)
            same[1:] = (now[1:] == now[:-1]) & (group[new[1:]] == group[new[:-1]]) & (now[1:] > 0)
            # The prefix shared by neighbours is one more than the least between their former places.
            until = index + 1
            until[moved[:-1][same[1:]]] = moved[1:][same[1:]]
            pairs = np.empty(2 * n, np.int64)
            pairs[0::2], pairs[1::2] = index + 1, until + 1
            least = np.minimum.reduceat(np.append(common, [0, 0]), np.minimum(pairs, n + 1))[0::2]
            common_new = np.zeros(n, np.int32)
            common_new[1:][same[1:]] = least[moved[:-1][same[1:]]] + 1
            before_new = grid[row - 1][new]
            rounds.write(new, common_new, before_new)
            yield row - 1 - left, new, common_new, before_new
    finally:
        rounds.close()


def repeated_starts(strings: list[bytes], before: list[int], group: np.ndarray, length: int, rank: list[int] | None = None, folder: str | None = None) -> list[np.ndarray]:
    """For each string the columns at which a string of `length` starts that another of its group has there too; with `rank`, one of less rank."""
    hits: list[tuple[np.ndarray, int]] = []
    ranks = None if rank is None else np.asarray(rank)
    for column, order, common, _ in columns(strings, before, group, folder):
        long = common >= length
        if long.any():
            first = np.flatnonzero(~long)  # where the runs of equal strings begin
            if ranks is None:
                long[:-1] |= long[1:]
            else:
                mine = ranks[order]
                long = mine > np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(order))))
            hits.append((order[long], column))
    out: list[list[int]] = [[] for _ in strings]
    for who, column in hits:
        for i in who.tolist():
            out[i].append(column)
    return [np.array(sorted(x), np.int64) for x in out]


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


#: Of a string of an anchor: its key and digest, its rank among all (least of its places), symbols before the anchor, the columns asked for, bytes.
_STRING = "anchor long, d1 long, d2 long, none boolean, doc_id long, row_hash long, place long, before int, low int, high int, bytes binary"
_NAMES = [f.split()[0] for f in _STRING.split(", ")]
_TYPES = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _contested(length: int, first: bool, folder: str):
    """Strings (_STRING) of whole anchors, sorted by anchor: anchor, d1, d2 and repeated runs of columns."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        group, last = [], None
        for r in rows:
            group.append(0 if last is None else group[-1] + (r[0] != last))
            last = r[0]
        rank = None
        if first:
            by_place = sorted(range(len(rows)), key=lambda i: (rows[i][3], rows[i][4] or 0, rows[i][5], rows[i][6]))
            rank = [0] * len(rows)
            for k, i in enumerate(by_place):
                rank[i] = k
        out: list[tuple] = []
        for r, starts in zip(rows, repeated_starts([r[10] for r in rows], [r[7] for r in rows], np.array(group), length, rank, folder)):
            starts = starts[(starts >= r[8]) & (starts <= r[9])]
            out += [(*r[:3], a, b) for a, b in zip(*_runs(starts))]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.int32()] * 2)], ["anchor", "d1", "d2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= TOGETHER and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    return run


def _cut_out(length: int):
    """The bytes of the wanted segments of each text, as strings (_STRING)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc_id, row_hash, wanted in zip(utf8(batch.column(0)), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                for w in wanted:
                    pos, before, more = w["place"] >> 24, (w["place"] >> 12) & 4095, w["place"] & 4095
                    low = pos - before
                    rows.append((w["anchor"], w["d1"], w["d2"], doc_id is None, doc_id, row_hash, w["place"], before, -before, more - before, text[low : low + more + length]))
            yield _strings(rows)

    return run


def _halves(length: int):
    """Strings cut into two ranges of columns each and dealt by what all windows of a range share; first the parents' anchor, d1, d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, rows = [], []
            for anchor, d1, d2, *rank, before, low, high, data, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                middle = (left + right) // 2
                for a, b in ((left, middle), (middle + 1, right)):
                    x, y = max(a, low), min(b, high)
                    if x > y:
                        continue
                    shared = data[before + b : before + a + length]
                    key = xxhash.xxh3_64_intdigest(shared + anchor.to_bytes(8, "little", signed=True) + a.to_bytes(4, "little", signed=True)) - (1 << 63)
                    part = data[before + x : before + y + length]
                    high_, low_ = divmod(xxhash.xxh3_128_intdigest(part + x.to_bytes(4, "little", signed=True)), 1 << 64)
                    parents.append((anchor, d1, d2, a, b))
                    rows.append((key, low_ - (1 << 63), high_ - (1 << 63), *rank, -x, x, y, part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in parents], t) for i, t in enumerate([pa.int64()] * 3 + [pa.int32()] * 2)] + _strings(rows).columns, ["p_anchor", "p_d1", "p_d2", "left", "right", *_NAMES]
            )

    return run


_KIND = ["anchor", "d1", "d2"]


def _rank():
    return F.struct("none", "doc_id", "row_hash", "place")


def _decided(strings: DataFrame, length: int, first: bool) -> DataFrame:
    """anchor, d1, d2, first, last: runs of repeated columns of `strings` (_STRING, left, right: the anchor's range of columns; one row a kind)."""
    solve = _contested(length, first, work_dir(strings.sparkSession))
    small = lambda df: df.select(*_NAMES).repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(solve, "anchor long, d1 long, d2 long, first int, last int")
    hot = strings.groupBy("anchor").count().where(F.col("count") > TOGETHER).select("anchor")
    if not hot.limit(1).count():
        return small(strings)
    halves = written(
        strings.join(hot, "anchor", "left_semi").select(*_NAMES, "left", "right").mapInArrow(_halves(length), f"p_anchor long, p_d1 long, p_d2 long, left int, right int, {_STRING}"), "op3-halves"
    )
    # Equal parts of several strings become one, which the least of them stands for.
    folded = halves.groupBy(*_KIND).agg(F.count("*").alias("n"), F.min(_rank()).alias("least"))
    one = written(
        halves.join(folded, _KIND).where(_rank() == F.col("least")).dropDuplicates(_KIND).select(*_NAMES, "left", "right"), "op3-parts"
    )
    own = halves.select("p_anchor", "p_d1", "p_d2", *_KIND, "low", "high", _rank().alias("rank")).join(folded, _KIND)
    whole = own.where((F.col("n") > 1) & (F.lit(not first) | (F.col("rank") != F.col("least")))).select("p_anchor", "p_d1", "p_d2", F.col("low").alias("first"), F.col("high").alias("last"))
    part = own.join(_decided(one, length, first), _KIND).select("p_anchor", "p_d1", "p_d2", "first", "last")
    return small(strings.join(hot, "anchor", "left_anti")).unionByName(written(whole.unionByName(part).withColumnsRenamed({"p_anchor": "anchor", "p_d1": "d1", "p_d2": "d2"}), "op3-split"))


def _by_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Join what `rows` holds for (doc_id, row_hash) to the texts, null ids included."""
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return left.join(rows.withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, first: bool = False) -> DataFrame:
    """doc_id, row_hash, spans array<struct<first, last>>: starts, by runs, of strings that start elsewhere too; with `first`, that start earlier too."""
    small_batches(docs.sparkSession)
    every = segments(docs, length, gram)
    # Written, so that the join reads two exchanges and the adaptive plan can split a skewed anchor.
    twice = written(every.groupBy("anchor").count().where("count > 1").select("anchor"), "op3-twice")
    found = written(every.join(twice, "anchor", "left_semi"), "op3-segments")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "place")).alias("one")
    kinds = written(found.groupBy(*_KIND).agg(F.count("*").alias("n"), least), "op3-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    wanted = (
        kinds.join(several, "anchor", "left_semi").select(*_KIND, "one.*")
        .groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct(*_KIND, "place")).alias("wanted"))
    )
    strings = written(
        _by_rows(docs, wanted).where("wanted is not null").dropDuplicates(["doc_id", "row_hash"]).select("text", "doc_id", "row_hash", "wanted").mapInArrow(_cut_out(length), _STRING), "op3-strings"
    )
    # The columns that any window with the anchor can start at.
    partial = _decided(strings.withColumn("left", F.lit(gram - length)).withColumn("right", F.lit(0)), length, first)
    whole = kinds.where("n > 1").select(*_KIND, F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    pos, low = F.shiftright("place", 24), F.shiftright("place", 24) - F.shiftright("place", 12).bitwiseAND(4095)
    high = low + F.col("place").bitwiseAND(4095)
    spans = found.join(whole.unionByName(partial), _KIND)
    if first:  # the first copy of a kind is no repeat as a whole
        of = kinds.where("n > 1").select(*_KIND, F.col("one").alias("least"))
        mine = F.col("least").isNotNull() & F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.row_hash") == F.col("row_hash")) & (F.col("least.place") == F.col("place"))
        spans = spans.join(of, _KIND, "left").where(F.col("first").isNotNull() | ~mine)
    return (
        spans.select("doc_id", "row_hash", F.struct(
            F.coalesce(pos + F.col("first"), low).alias("first"), F.coalesce(pos + F.col("last"), high).alias("last")).alias("span"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("span").alias("spans"))
    )


def remove_spans(text: bytes, spans: list[dict], length: int) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of maximal removed runs."""
    kept, removed, runs, at = [], 0, 0, 0
    for a, b in sorted((s["first"], s["last"] + length) for s in spans):
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            removed += b - a
        elif b > at:
            removed += b - at
        at = max(at, b)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            rows = [remove_spans(t, s or [], length) for t, s in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array(map(len, texts), pa.int64())] + [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans: one row per row of `docs` (doc_id, text)."""
    return _by_rows(docs, repeated_spans(docs, length, gram)).select("doc_id", "text", "spans").mapInArrow(
        _removed(length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, first: bool = False) -> DataFrame:
    """The rows and columns of `docs` (doc_id, text, ...) with what is left of each text, and n_chars, if there, counted anew. With `first` the first copy of a string stays.

    A character whose bytes are cut apart goes as a whole; a null text stays null.
    """
    spans = repeated_spans(docs, length, gram, first).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left").drop("__id", "__hash")
    names = docs.columns
    own, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns_ = list(batch.columns[:-1])
            kept = [
                remove_spans(t, s, length)[0].decode("utf-8", "ignore") if s else t.decode()
                for t, s in zip(utf8(columns_[own]), batch.column(len(names)).to_pylist())
            ]
            valid = columns_[own].is_valid().to_pylist()
            if chars is not None:
                columns_[chars] = pa.array([len(t) if v else n for t, v, n in zip(kept, valid, columns_[chars].to_pylist())], columns_[chars].type)
            columns_[own] = pa.array([t if v else None for t, v in zip(kept, valid)], columns_[own].type)
            yield pa.RecordBatch.from_arrays(columns_, names)

    return joined.mapInArrow(run, docs.schema)


def brute_force(texts: list[bytes], length: int = LENGTH, first: bool = False) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by counting every window; with `first`, texts are in order and differ; for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out, before = [], set()
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in before if first else seen[w] > 1:
                gone[i : i + length] = True
            before.add(w)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
