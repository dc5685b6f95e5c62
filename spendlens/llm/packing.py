"""Best-fit packing of token pieces into sequences, improved by swaps.

1. `tokenize` encodes whole texts and cuts those longer than a sequence, so
   that only the first piece may be shorter; its rows are small.
2. Pieces are dealt by hash into groups of about `GROUP` pieces. In each group
   `pack` places them best-fit, longest first, and then searches locally over
   the bins that aren't full: it moves pieces, exchanges one for one and two for
   one, whenever that makes the sum of squared fills larger, which empties bins,
   until nothing changes.
3. If there was more than one group, the pieces of underfull bins (filled less
   than `LOOSE`) are dealt and packed again, so that groups don't each keep their
   own leftovers, until they are one group or a turn saves no bin.

A null text counts as empty and is one piece: the end token. Ties are placed
by doc_id, then piece. Rows with the same doc_id keep apart as pieces of
different rows, told apart by `row_hash`; repeated rows are all packed, told
apart by `copy`. Other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, written

SIZE = 2048
END = 0
GROUP = 60_000
LOOSE = 0.98
VOCABULARY = "byte_bpe_50k.json"


#: The vocabulary's split pattern for texts whose white space is single characters between others: without its
#: look-ahead, which only tells runs of white space apart, and so half as slow again to match.
SINGLE_SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""


class Encoder:
    """Ids of whole texts under a vocabulary file of `tokenizers`, as little-endian unsigned 32-bit bytes.

    Where the same vocabulary lies beside it as ranks, they give the same ids some five times faster; a text with the
    string of a special token in it, which ranks don't know, always goes to `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        try:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.replace(".json", ".tiktoken"), "rb"))}
            self.ranked, self.single = (
                tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                for name, pattern in (("any", public_tokenizers.PATTERN), ("single", SINGLE_SPACED))
            )
        except (ImportError, OSError):
            pass

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif len(" ".join(text.split())) == len(text):
            ids = self.single(text)
        else:
            ids = self.ranked(text)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(text or "") + end
                rows += [(doc_id, row, i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cut(len(ids) // 4, size))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenize(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, row_hash, piece, start, length, ids_crc32: one row per piece of each text with its end token."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
        _pieces(path, size), "doc_id long, row_hash long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into `lengths` (sorted, longest first): each piece goes to the fullest bin that has room."""
    rooms: list[int] = []  # sorted distinct amounts of room
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(bins), size
            bins.append([])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        bins[b].append(i)
        left = room - n
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Held:
    """Pieces that bins may give, by length."""

    def __init__(self, lengths: list[int]):
        self.lengths, self.sizes, self.by = lengths, [], {}

    def add(self, i: int) -> None:
        n = self.lengths[i]
        if n not in self.by:
            self.by[n] = []
            insort(self.sizes, n)
        self.by[n].append(i)

    def remove(self, i: int) -> None:
        n = self.lengths[i]
        self.by[n].remove(i)
        if not self.by[n]:
            del self.by[n]
            self.sizes.pop(bisect_left(self.sizes, n))

    def longest(self, least: int, most: int) -> int | None:
        k = bisect_left(self.sizes, most + 1) - 1
        return self.by[self.sizes[k]][-1] if k >= 0 and self.sizes[k] >= least else None


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Move and swap pieces between underfull bins while the sum of squared fills grows.

    Bins take in turn, fullest first, from those emptier than they are. With
    room r a bin takes a piece of at most r (move), or gives one of its pieces
    x for one of x < y <= x + r, or two of together x. Pieces of one length are
    alike, so all of a bin's pieces and pairs are tried by their lengths. The fuller
    bin grows and the emptier shrinks, so the squared fill increases, the
    emptiest bins run dry, and turns end when none changes anything.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    home = {i: b for b, members in enumerate(bins) for i in members}
    changed = True
    while changed:
        takers = sorted((b for b in range(len(bins)) if 0 < fill[b] < size), key=lambda b: -fill[b])
        held = _Held(lengths)
        for b in takers:
            for i in bins[b]:
                held.add(i)
        changed = False
        for b in takers:
            for i in bins[b]:
                held.remove(i)
            while 0 < fill[b] < size and held.sizes:
                room, least = size - fill[b], held.sizes[0]
                own = {lengths[i]: i for i in bins[b]}
                sums = {0: ()} | {n: (i,) for n, i in own.items()}
                for k, i in enumerate(bins[b]):
                    for j in bins[b][:k]:
                        sums.setdefault(lengths[i] + lengths[j], (i, j))
                best: tuple[int, int, tuple[int, ...]] | None = None
                for x, give in sums.items():
                    if x + room < least or (best is not None and best[0] == room):
                        continue
                    got = held.longest(x + 1, x + room)
                    if got is not None and fill[home[got]] <= fill[b] and (best is None or lengths[got] - x > best[0]):
                        best = (lengths[got] - x, got, give)
                if best is None:
                    break
                gain, got, give = best
                other = home[got]
                held.remove(got)
                bins[other].remove(got)
                bins[b].append(got)
                home[got] = b
                for i in give:
                    bins[b].remove(i)
                    bins[other].append(i)
                    home[i] = other
                    held.add(i)
                fill[b] += gain
                fill[other] -= gain
                changed = True
    return [b for b in bins if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: best fit, longest first, and then the local search."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = local_search(best_fit([lengths[i] for i in order], size), [lengths[i] for i in order], size)
    return [[order[i] for i in b] for b in bins]


_KEYS = ["doc_id", "row_hash", "piece", "copy"]
_PACKED = "doc_id long, row_hash long, piece int, copy int, length long, bin long, offset long, fill long"


def _packer(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", *_KEYS], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = group.length.tolist()
        where, offset, total = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for b, members in enumerate(pack(lengths, size)):
            at = 0
            for i in members:
                where[i], offset[i] = b, at
                at += lengths[i]
            for i in members:
                total[i] = at
        return group[[*_KEYS, "length"]].assign(bin=(int(group.part.iloc[0]) << 32) + np.array(where, np.int64), offset=offset, fill=total)

    return run


def _groups(pieces: DataFrame, n: int, size: int, turn: int) -> DataFrame:
    """The pieces dealt anew in each turn, and packed group by group; bins of different turns have different numbers."""
    parts = max(1, -(-n // GROUP))
    dealt = pieces.withColumn("part", F.lit(turn << 24) + F.pmod(F.xxhash64(F.lit(turn), *_KEYS), F.lit(parts)))
    return written(dealt.groupBy("part").applyInPandas(_packer(size), _PACKED), f"op5-turn{turn}")


def _placed(pieces: DataFrame, n: int, size: int) -> DataFrame:
    """Every piece's bin and offset: pieces of underfull bins are dealt and packed again until they are one group, or a turn saves no bin."""
    turn, out = 0, None
    rows = _groups(pieces, n, size, turn)
    while n > GROUP:
        loose = rows.where(F.col("fill") < LOOSE * size)
        left, bins = loose.agg(F.count("*"), F.count_distinct("bin")).first()
        if not left:
            break
        turn += 1
        again = _groups(loose.select(*_KEYS, "length"), left, size, turn)
        if again.agg(F.count_distinct("bin")).first()[0] >= bins:
            break
        full = rows.where(F.col("fill") >= LOOSE * size)
        out, rows, n = full if out is None else out.unionByName(full), again, left
    return rows if out is None else out.unionByName(rows)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of `docs`."""
    pieces = written(tokenize(docs, path, size), "op5-pieces")
    counted = pieces.groupBy("doc_id", "row_hash", "piece", "start", "length", "ids_crc32").count()
    whole = written(
        counted.select("*", F.explode(F.expr("sequence(1, cast(`count` as int))")).alias("copy")).drop("count"), "op5-rows"
    )
    n = whole.count()
    placed = _placed(whole.select(*_KEYS, "length"), n, size)
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"p.{k}")) for k in _KEYS]
    return whole.alias("w").join(placed.alias("p"), on[0] & on[1] & on[2] & on[3]).select(
        "w.doc_id", "w.piece", "w.start", "w.length", "w.ids_crc32", F.col("p.bin").alias("sequence_id"), "p.offset"
    )


def lower_bound(lengths: list[int], size: int = SIZE) -> int:
    return -(-sum(lengths) // size)


def check_packing(rows: list[tuple[int, int, int]], size: int = SIZE) -> int:
    """Rows (sequence_id, offset, length): assert that sequences are gapless and fit; return their number."""
    by: dict[int, list[tuple[int, int]]] = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for members in by.values():
        at = 0
        for o, n in sorted(members):
            assert o == at and n > 0
            at += n
        assert at <= size
    return len(by)

