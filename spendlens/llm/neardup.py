"""MinHash near-dedup with odd sketches.

Documents whose sets of distinct five-word shingles have a Jaccard similarity
of 0.75 or more are linked; the components of the links are the groups.

1. `sketches` computes per text, in numpy: the set's size and digest, 512
   MinHash samples, of which 128 form 32 bands of 4, and the odd sketch: 512
   parity bits, one of which each sample toggles. At similarity 0.75 two
   documents share no band with probability (1 - 0.75**4)**32 = 5e-6.
2. Documents with equal sets become one node by partial aggregation. Nodes
   are named by 64 bits of the set's 128-bit digest; sets whose names collide
   are told apart by the other 64 bits and named anew.
3. Rounds of pivots: in each band the node that shares most with others is
   compared with all that aren't yet in its component; the next round takes a
   new pivot among the nodes outside the band's largest component. The XOR of
   two odd sketches has as many ones as samples differ, twice over, less
   coincidences, which gives the similarity within 0.034 (one deviation);
   pairs estimated under 0.61, four deviations below 0.75, are dropped, the
   others are confirmed on their full sets. A round makes at most a row per
   node and band.
4. What the pivots leave in different components of a band is compared in
   full: the stragglers outside the largest component with every node of the
   band, block against block. A task compares the sketches of two blocks as
   arrays and returns the nodes that are in a likely pair; these meet again
   under the same key with their texts, are confirmed, most alike first, and
   only links that join two components of the block leave the task. A straggler
   is a row for each block of its band's nodes and a node one for each block of
   stragglers, so rows are stragglers times nodes of a band over half of `BLOCK`:
   few where pivots have joined nearly all, but in a band with very many
   stragglers they grow with the square. No group is collected whole: blocks are
   dealt by number and by size of the sets.

Null or empty texts and texts without words have an empty set and link with
nothing. Repeated rows are copies of each other. A null doc_id stays null and
is never a component's id; a component of such rows alone has a null id, and
its rows are all kept. Other columns are ignored. Very long texts are read
whole; they weigh more, so fewer of them meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, utf8, written
from .components import connected
from .hashing import shingle_set

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
SAMPLES = 512
#: Bands of ROWS samples; only the first BANDS * ROWS samples are banded.
BANDS, ROWS = 32, 4
BITS = 512
LEAST_ESTIMATE = 0.61
PIVOTS = 3
#: Nodes, and shingles of their sets, of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Nodes, and shingles of their sets, about, whose texts meet under one key when pairs are confirmed.
TOGETHER, TOGETHER_SHINGLES = 256, 1 << 20
#: Shingles that a task holds unpacked.
_HELD = 1 << 22

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = [f"odd{i}" for i in range(BITS // 64)]
_SKETCH = ["n_shingles", *_ODD]
#: What one XOR count says about the samples that differ.
_DIFFER = np.array([math.log(max(1e-9, 1 - 2 * min(z, BITS // 2 - 1) / BITS)) / (2 * math.log(1 - 2 / BITS)) for z in range(BITS + 1)])


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of the set under as many 32-bit permutations."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        v = (h[None, at : at + 512] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS parity bits, as 64-bit words: each (position, sample) toggles one."""
    h = samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    bit = (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    parity = (np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """The similarity that a count of differing parity bits stands for."""
    return 1 - _DIFFER[differing] / SAMPLES


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest, as two signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        size, sid, other, bands, odd = [], [], [], [], []
        for text in utf8(batch.column(2)):
            s = shingle_set(text, WORDS)
            size.append(len(s))
            if not len(s):
                sid.append(None)
                other.append(None)
                bands.append(None)
                odd.append(np.zeros(len(_ODD), np.int64))
                continue
            m = minhash(s)
            key = salt.copy()
            for i in range(ROWS):
                key = (key ^ m[i : BANDS * ROWS : ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            one, two = digest(s)
            sid.append(one)
            other.append(two)
            bands.append(key.view(np.int64))
            odd.append(odd_sketch(m))
        words = np.stack(odd) if odd else np.zeros((0, len(_ODD)), np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(size, pa.int64()), pa.array(sid, pa.int64()), pa.array(other, pa.int64()), pa.array(bands, pa.list_(pa.int64()))] + [pa.array(words[:, i].copy()) for i in range(len(_ODD))],
            ["doc_id", "row", "row_hash", "n_shingles", "sid", "other", "bands", *_ODD],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key), row_hash (of the text), n_shingles, sid and other (digest of the set, null if empty), bands, odd0..odd7: one row per row of `docs`."""
    return docs.select(F.col("doc_id").cast("long"), _row(), "text", F.xxhash64("text").alias("row_hash")).mapInArrow(
        _sketches, "doc_id long, row long, row_hash long, n_shingles long, sid long, other long, bands array<long>, " + ", ".join(f"{c} long" for c in _ODD)
    )


def _row():
    """What a row's text is fetched again by; rows that share it are told apart by their sets."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("row")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compressed texts whose set is the wanted one: 3 to 4 times smaller than the sets themselves."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        sid, packed = [], []
        for text, want, other in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if digest(shingle_set(text, WORDS))[1] == other:
                sid.append(want)
                packed.append(pack.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(packed, pa.binary())], ["sid", "packed"])


class _Sets:
    """Full sets of the nodes of one key, unpacked when they are asked for."""

    def __init__(self):
        self.unpack = zstandard.ZstdDecompressor()
        self.clear()

    def clear(self) -> None:
        self.texts: dict[int, bytes] = {}
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def of(self, node: int) -> np.ndarray:
        if node not in self.sets:
            if self.held > _HELD:
                self.sets, self.held = {}, 0
            self.sets[node] = shingle_set(self.unpack.decompress(self.texts[node]), WORDS)
            self.held += len(self.sets[node])
        return self.sets[node]

    def linked(self, a: int, b: int) -> bool:
        x, y = self.of(a), self.of(b)
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= PERCENT * (len(both) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: first texts (a: node), then pairs (a, b); the pairs that the full sets link."""
    now, sets = None, _Sets()
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for key, a, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                now = key
                sets.clear()
            if b is None:
                sets.texts[a] = packed
            elif sets.linked(a, b):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _most(least: float) -> int:
    """The most differing bits that stand for a similarity of `least`."""
    return max(i for i in range(BITS + 1) if estimate(np.array([i]))[0] >= least)


def _confirm(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links among `pairs` (a, b), on full sets.

    Nodes are dealt to `parts` parts; pairs of the same two parts meet under
    one key, and each text goes there once, however many pairs it is in.
    """
    many = F.lit(parts)
    key = F.pmod(F.xxhash64("a"), many) * many + F.pmod(F.xxhash64("b"), many)
    keyed = pairs.select(key.alias("key"), "a", "b")
    needed = keyed.select("key", F.explode(F.array("a", "b")).alias("sid")).distinct().join(texts, "sid")
    rows = needed.select("key", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "packed").unionByName(keyed.withColumn("packed", F.lit(None).cast("binary")))
    return rows.repartition(F.col("key")).sortWithinPartitions("key", F.col("b").asc_nulls_first()).mapInArrow(_confirmed, "a long, b long")


def _members(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The nodes of the bands that hold more than one component, with their components and the band's largest."""
    if parts is None:
        return shared.withColumn("component", F.col("sid")).withColumn("main", F.lit(None).cast("long"))
    member = shared.join(parts.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    each = member.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = each.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("most")).where("kinds > 1")
    return member.join(largest.select("band", F.col("most.component").alias("main")), "band")


def _pivot_pairs(member: DataFrame) -> DataFrame:
    """Of each band the best connected node outside the largest component, with each node of another component than its own: the pairs whose sizes allow a link and whose odd sketches suggest one."""
    pivots = member.where("main is null or component <> main").groupBy("band").agg(F.max(F.struct("score", "sid", "component", *_SKETCH)).alias("p"))
    with_pivot = member.join(pivots, "band").where("component <> p.component")
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p.{c}"))) for c in _ODD), F.lit(0))
    size, other = F.col("n_shingles"), F.col("p.n_shingles")
    able = (100 * F.least(size, other) >= PERCENT * F.greatest(size, other)) & (differing <= _most(LEAST_ESTIMATE))
    return with_pivot.where(able).select(F.least("sid", "p.sid").alias("a"), F.greatest("sid", "p.sid").alias("b")).distinct()


_BLOCK_KEY = ["band", "i", "j"]
_ROW = [*_BLOCK_KEY, "straggler", "sid", "component", *_SKETCH]


def _pairs_of(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a block key (columns of _ROW), the likely pairs between components and their differing bits."""
    straggler, sid, component, n = cols[3].astype(bool), cols[4], cols[5], cols[6]
    words = np.stack(cols[7:], axis=1).view(np.uint64)
    left, right = np.flatnonzero(straggler), np.flatnonzero(~straggler)
    most, found = _most_bits(), []
    for at in range(0, len(left), 64):
        x = left[at : at + 64, None]
        y = right[None, :]
        differing = np.bitwise_count(words[x] ^ words[y]).sum(axis=2, dtype=np.int64)
        able = (differing <= most) & (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        i, j = np.nonzero(able)
        found.append((left[at + i], right[j], differing[i, j]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


_MOST: list[int] = []


def _most_bits() -> int:
    if not _MOST:
        _MOST.append(_most(LEAST_ESTIMATE))
    return _MOST[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block key, one record batch for each key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and now != tuple(keys[a]):
                yield pa.concat_batches(held)
                held = []
            now = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _in_likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        a, b, _ = _pairs_of([c.to_numpy(zero_copy_only=False) for c in block.columns])
        yield block.take(pa.array(np.unique(np.concatenate([a, b]))))


def _joining_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join components of a block, on the full sets."""
    for block in _blocks(batches):
        cols = [c.to_numpy(zero_copy_only=False) for c in block.columns[:-1]]
        a, b, differing = _pairs_of(cols)
        sid, component = cols[4].tolist(), cols[5].tolist()
        sets = _Sets()
        sets.texts = dict(zip(sid, block.column(block.num_columns - 1).to_pylist()))
        root = {c: c for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out: tuple[list, list] = ([], [])
        for k in np.argsort(differing, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = find(component[i]), find(component[j])
            if x != y and sets.linked(sid[i], sid[j]):
                root[x] = y
                out[0].append(sid[i])
                out[1].append(sid[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _across(member: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each band, as many as join them: stragglers against all nodes of the band, by blocks."""
    rows = member.select("band", "sid", "component", (~F.col("component").eqNullSafe(F.col("main"))).alias("straggler"), *_SKETCH)
    blocks = lambda some: F.ceil(F.greatest(F.count(F.when(some, 1)) / BLOCK, F.sum(F.when(some, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("long")
    of = rows.groupBy("band").agg(blocks(F.lit(True)).alias("of"), blocks(F.col("straggler")).alias("few"))
    dealt = rows.join(of, "band")
    mine = lambda many: F.pmod(F.xxhash64("sid"), F.col(many))
    # As a straggler a node meets every block of the band, as a node every block of stragglers.
    left = dealt.where("straggler").withColumn("i", mine("few")).withColumn("j", F.explode(F.expr("sequence(0L, `of` - 1)")))
    right = dealt.withColumn("straggler", F.lit(False)).withColumn("j", mine("of")).withColumn("i", F.explode(F.expr("sequence(0L, few - 1)")))
    both = left.select(*_ROW).unionByName(right.select(*_ROW))
    schema = "band long, i long, j long, straggler boolean, sid long, component long, n_shingles long, " + ", ".join(f"{c} long" for c in _ODD)
    sorted_ = lambda df: df.repartition(*(F.col(k) for k in _BLOCK_KEY)).sortWithinPartitions(*_BLOCK_KEY)
    some = written(sorted_(both).mapInArrow(_in_likely_pairs, schema), "op9-likely")
    return sorted_(some.join(texts.select("sid", "packed"), "sid").select(*_ROW, "packed")).mapInArrow(_joining_links, "a long, b long")


def _joined_up(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after `links`: later turns link components, of which there are few."""
    if parts is None:
        return written(connected(links), "op9-parts")
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    named = written(named.distinct(), "op9-named")
    if not named.limit(1).count():
        return parts
    over = written(connected(named).select(F.col("node").alias("component"), F.col("component").alias("over")).distinct(), "op9-over")
    alone = over.join(parts.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("over").alias("component"))
    moved = parts.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return written(moved.unionByName(alone), "op9-parts")


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows of sets that share the first 64 bits of their digests, but not the others, are named by the others."""
    clashing = rows.where("sid is not null").groupBy("sid").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least <> most").select("sid", "least")
    if not clashing.limit(1).count():
        return rows
    anew = F.when(F.col("least").isNotNull() & (F.col("other") != F.col("least")), F.xxhash64("sid", "other")).otherwise(F.col("sid"))
    return written(rows.join(clashing, "sid", "left").withColumn("sid", anew).drop("least"), "op9-told-apart")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, component_id, kept: one row per row of `docs` (doc_id, text)."""
    return near_components(docs).drop("component")


def near_components(docs: DataFrame) -> DataFrame:
    """The columns of `near_groups`, and component (a node of it; null without words), which tells components of one id, or of none, apart."""
    small_batches(docs.sparkSession)
    rows = _told_apart(written(sketches(docs), "op9-sketches"))
    some = rows.where("sid is not null")
    nodes = written(
        some.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.max("other").alias("other"), F.max("n_shingles").alias("n_shingles"), *(F.max(c).alias(c) for c in _ODD)), "op9-nodes"
    )
    bands = some.select("sid", F.explode("bands").alias("band")).distinct()
    in_bands = bands.join(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band")
    # Rows of bands hold the sketches, so that rounds compare them where they meet.
    shared = written(in_bands.join(in_bands.groupBy("sid").agg(F.sum("size").alias("score")), "sid").join(nodes.select("sid", *_SKETCH), "sid"), "op9-bands")
    # The nodes of shared bands, each with the text of one of its rows.
    wanted = shared.select("sid").distinct().join(nodes, "sid").select("sid", "other", "row")
    texts = written(
        docs.select(_row(), "text").join(wanted, "row").select("text", "sid", "other").mapInArrow(_packed, "sid long, packed binary").dropDuplicates(["sid"])
        .join(nodes.select("sid", "n_shingles"), "sid"),
        "op9-texts",
    )
    size = texts.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).first()
    dealt = 1 + max(size["n"] // TOGETHER, (size["shingles"] or 0) // TOGETHER_SHINGLES)
    parts = None
    for turn in range(PIVOTS + 1):
        member = written(_members(shared, parts), "op9-members")
        if not member.limit(1).count():
            break
        new = _confirm(_pivot_pairs(member), texts.select("sid", "packed"), dealt) if turn < PIVOTS else _across(member, texts)
        parts = _joined_up(parts, written(new, "op9-links"))
    if parts is None:
        parts = nodes.select(F.col("sid").alias("node"), F.col("sid").alias("component")).limit(0)
    named = parts.join(nodes.select(F.col("sid").alias("node"), "first_id"), "node")
    label = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select(F.col("node").alias("sid"), "component", "component_id")
    label = nodes.select("sid", "first_id").join(label, "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    return (
        rows.join(label, "sid", "left")
        .withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "row_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component")
    )


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id), by comparing all pairs of plain sets; for tests."""
    import re

    sets = {}
    for i, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w[j : j + WORDS]) for j in range(len(w) - WORDS + 1)} if len(w) >= WORDS else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
