"""Compression of vectors to codes, the nearest codebook entries found by VA-file filtering.

Vectors become integers, floor(256 x), and are cut into `PARTS` equal parts. The
codebook of a part position starts as that part of the `ENTRIES` vectors of the
least vec_id and is moved `ROUNDS` times to the means of the parts assigned to it.

`Codebooks.nearest` filters as a VA-file does. Each entry's coordinate is kept in
`BITS` bits, as one of the cells that divide the entries' range in that
coordinate. For a vector, two small lookup tables give the least and the largest
squared distance of its coordinate to each cell; sums over an entry's cells
bound its distance from below and above. Only entries whose lower bound isn't
above the least upper bound are refined with integer distances, of which the
least wins, the lower index of equal ones. Everything is 64-bit integers, so the
result is that of comparing all entries.

Spark reads the vectors once a round; tasks send sums by part, entry and
position, at most ENTRIES x dimensions rows each, and these are all the driver sees.

Dropped are rows whose vector is null or holds null or non-finite components, and
no others. Repeated rows count, and come back, as often as they are there; ties
of vec_id go by the vector; a null vec_id is after all others. With fewer than
ENTRIES vectors there are as many entries. Dimensions are those of the first
vector; one of another length has a null code and error, and isn't learned
from. Where PARTS doesn't divide the length, zeros are added at the end.
Components are held to 2^16 on either side, so that no sum overflows. Null
labels are one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MOST = 256, 1 << 24
#: Bits of a cell's number.
BITS = 3


class Codebooks:
    """The entries of each part position, [part, entry, position], and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n_cells = 1 << BITS
        least, most = entries.min(axis=1, initial=MOST), entries.max(axis=1, initial=-MOST)
        marks = least[..., None] + (most - least + 1)[..., None] * np.arange(n_cells + 1) // n_cells  # [part, position, mark]
        self.first, self.last = marks[..., :-1], np.maximum(marks[..., 1:] - 1, marks[..., :-1])
        inner = marks[:, None, :, 1:-1]
        self.cells = (entries[..., None] >= inner).sum(axis=-1).astype(np.uint8)  # the codes of the VA-file

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and its squared distance, for each row of x."""
        q = x[:, :, None]
        below, above = self.first[part] - q, q - self.last[part]
        lower = np.maximum(np.maximum(below, above), 0) ** 2  # [row, position, cell]
        upper = np.maximum(np.abs(below), np.abs(above)) ** 2
        cells, place = self.cells[part], np.arange(x.shape[1])
        at_least, at_most = lower[:, place, cells].sum(axis=2), upper[:, place, cells].sum(axis=2)  # [row, entry]
        row, entry = np.nonzero(at_least <= at_most.min(axis=1)[:, None])
        distance = ((x[row] - self.entries[part, entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, starts)
        best = np.flatnonzero(distance == least[row])  # by row, then entry
        return entry[best[np.searchsorted(row[best], np.arange(len(x)))]], least

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, part] indices and squared distances of vectors [row, part, position]."""
        found = [self.nearest(p, x[:, p]) for p in range(PARTS)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def width_of(dimensions: int) -> int:
    return -(-dimensions // PARTS)


def _parts(values: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """[row, part, position] of n vectors that follow each other."""
    width = width_of(dimensions)
    out = np.zeros((n, PARTS * width), np.int64)
    out[:, :dimensions] = values.reshape(n, dimensions)
    return out.reshape(n, PARTS, width)


def _like(column: pa.ListArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of so many dimensions, and their vectors."""
    fits = np.flatnonzero(np.diff(np.asarray(column.offsets)) == dimensions)
    some = column.take(pa.array(fits))
    return fits, _parts(some.flatten().to_numpy(zero_copy_only=False), len(fits), dimensions)


def _sums(books: Codebooks, dimensions: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.entries.shape[:2], np.int64), np.zeros(books.entries.shape, np.int64)
        part = np.arange(PARTS)[None, :]
        for batch in stream:
            _, x = _like(batch.column("x"), dimensions)
            if len(x):
                code, _ = books.codes(x)
                np.add.at(counts, (np.broadcast_to(part, code.shape), code), 1)
                np.add.at(sums, (np.broadcast_to(part, code.shape), code), x)
        p, e = np.nonzero(counts)
        width = sums.shape[2]
        rows = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(counts[p, e], width), sums[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], ["part", "entry", "position", "n", "total"])

    return run


def _coded(books: Codebooks, dimensions: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fits, x = _like(batch.column("x"), dimensions)
            codes: list[str | None] = [None] * batch.num_rows
            errors: list[int | None] = [None] * batch.num_rows
            if len(x):
                code, error = books.codes(x)
                for i, c, e in zip(fits.tolist(), code.astype(np.uint8), error.sum(axis=1).tolist()):
                    codes[i], errors[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the vectors of `vectors` (vec_id, embedding, label) that are whole, as integers."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & whole).select("vec_id", "label", held.alias("x"))


def fit(vectors: DataFrame) -> tuple[Codebooks, int]:
    """Codebooks of `integer_vectors`, and their vectors' dimensions."""
    first = [r.x for r in vectors.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()]
    dimensions = len(first[0]) if first else 0
    first = [x for x in first if len(x) == dimensions]
    books = Codebooks(_parts(np.array(first, np.int64), len(first), dimensions).transpose(1, 0, 2).copy())
    for _ in range(ROUNDS if dimensions else 0):
        sums = vectors.select("x").mapInArrow(_sums(books, dimensions), "part long, entry long, position long, n long, total long")
        entries = books.entries.copy()
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # ENTRIES x dimensions at most
            entries[r.part, r.entry, r.position] = r.total // r.n
        books = Codebooks(entries)
    return books, dimensions


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error of each whole vector, written to the shared folder, and the codebooks."""
    with batches(vectors.sparkSession):
        kept = written(integer_vectors(vectors), "va-vectors")
        books, dimensions = fit(kept)
        label = kept.schema["label"].dataType.simpleString()
        vec_id = kept.schema["vec_id"].dataType.simpleString()
        return written(kept.mapInArrow(_coded(books, dimensions), f"vec_id {vec_id}, label {label}, code string, error long"), "va-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error, the error summed over its label: sums are made before the join, which can be split."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def brute_force(rows: list[tuple]) -> tuple[dict, list]:
    """vec_id -> (code, error), and the entries, of (vec_id, integer vector): all distances in plain Python."""
    width = width_of(len(rows[0][1])) if rows else 0
    parts = {v: [x[p * width : (p + 1) * width] for p in range(PARTS)] for v, x in rows}
    books = [[list(parts[v][p]) for v in sorted(parts)[:ENTRIES]] for p in range(PARTS)]

    def near(p: int, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(ROUNDS):
        new = []
        for p in range(PARTS):
            of = {}
            for v in parts:
                of.setdefault(near(p, parts[v][p])[1], []).append(parts[v][p])
            new.append([[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])])
        books = new
    out = {}
    for v in parts:
        found = [near(p, parts[v][p]) for p in range(PARTS)]
        out[v] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books
