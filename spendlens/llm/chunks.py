"""Substring dedup by content-defined chunking with a gear rolling hash.

1. `chunk_ends` cuts a text's UTF-8 bytes after every byte at which the gear
   hash of the last `WINDOW` bytes is below a threshold (one byte in `SPACING`
   is), but no chunk is shorter than `LEAST` or longer than `MOST` bytes. The
   hash, h = 2 h + GEAR[byte], forgets a byte after WINDOW steps, so the sums
   of shifted table values are taken for a whole text at once, by doubling.
   As a cut depends on the bytes just before it only, an insertion changes the
   chunks around it and no others.
2. Chunks are counted by 128-bit digest with partial aggregation: how often it
   occurs and the least (doc_id, row_hash) that holds it. No list of places is
   ever gathered, so a chunk that is in a third of all texts is as cheap as any.
3. The chunks of digests that occur more than once are joined back (a skewed
   digest is split by the adaptive join) and gathered by text. In each text the
   occurrences that aren't first go, together with those that repeat within it,
   in runs of at least `RUN` bytes: a lone small chunk is a common phrase.

The first occurrence is the one in the least doc_id (null last), then row_hash
(a hash of the text), then the first place in it. Rows of one id and text count
as one text and get equal results. Null counts as empty; an empty text has no
chunk; texts shorter than RUN bytes stay whole; very long texts are chunked
whole. Other columns are ignored, or kept by `without_repeated_chunks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, utf8
from .suffix import _runs

WINDOW = 32
SPACING = 32
LEAST, MOST = 16, 1024
RUN = 100
#: Bytes of a very long text that are hashed at once.
_PIECE = 1 << 22
GEAR = np.random.default_rng(20240307).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last WINDOW bytes."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """The places at which chunks end, the text's end included."""
    n = len(data)
    places = []
    for at in range(0, n, _PIECE):
        before = min(at, WINDOW - 1)
        h = gear(data[at - before : at + _PIECE])[before:]
        places.append(np.flatnonzero(h < np.uint32((1 << 32) // SPACING)) + (at + 1))
    ends, last = [], 0
    for p in np.concatenate(places).tolist() if places else ():
        if p - last < LEAST:
            continue
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        many, starts, ends, digests = [], [], [], []
        for text in utf8(batch.column(2)):
            end = chunk_ends(np.frombuffer(text, np.uint8))
            start = [0, *end[:-1]] if end else []
            many.append(len(end))
            starts += start
            ends += end
            digests += [digest(text[a:b]) for a, b in zip(start, end)]
        who = pa.array(np.repeat(np.arange(len(many)), many))
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(who), batch.column(1).take(who), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32))],
            ["doc_id", "row_hash", "d1", "d2", "first", "last"],
        )


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, d1, d2 (the digest), first, last (the bytes [first, last)): one row per chunk of each row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
        _chunks, "doc_id long, row_hash long, d1 long, d2 long, first int, last int"
    )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, found array<struct<first, last, d1, d2, elsewhere>>: the chunks of each text that an earlier text has too, or that it may have twice itself."""
    small_batches(docs.sparkSession)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    every = chunks(docs)
    known = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(key).alias("holder")).where("n > 1").select("d1", "d2", "holder")
    own = F.col("holder.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("holder.row_hash") == F.col("row_hash"))
    return every.join(known, ["d1", "d2"]).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("first", "last", "d1", "d2", (~own).alias("elsewhere"))).alias("found"))


def repeated_runs(found: list[dict]) -> list[tuple[int, int]]:
    """The byte ranges to remove: runs of at least RUN bytes of chunks that aren't their digest's first occurrence."""
    runs: list[list[int]] = []
    seen = set()
    for c in sorted(found, key=lambda c: c["first"]):
        digest = c["d1"], c["d2"]
        if not c["elsewhere"] and digest not in seen:
            seen.add(digest)
        elif runs and runs[-1][1] == c["first"]:
            runs[-1][1] = c["last"]
        else:
            runs.append([c["first"], c["last"]])
    return [(a, b) for a, b in runs if b - a >= RUN]


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text; a character that a run's edge cuts apart goes as a whole."""
    at, kept = 0, []
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode("utf-8", "ignore").encode() if runs else text


def _joined(docs: DataFrame) -> DataFrame:
    """The rows of `docs` and, last, what `repeated_chunks` found in each text."""
    found = repeated_chunks(docs).select(F.col("doc_id").alias("__of"), F.col("row_hash").alias("__hash"), F.col("found").alias("__found"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__of"]) & (F.xxhash64(docs["text"]) == found["__hash"]), "left").drop(found["__of"], found["__hash"])


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_bytes, n_chunks, n_removed (bytes), n_spans: one row per row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                runs = repeated_runs(found or [])
                kept = cut(text, runs)
                rows.append((kept.decode(), len(text), len(chunk_ends(np.frombuffer(text, np.uint8))), len(text) - len(kept), len(runs)))
            types = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "text", "n_bytes", "n_chunks", "n_removed", "n_spans"])

    return _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, text string, n_bytes long, n_chunks long, n_removed long, n_spans long")


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs` (doc_id, text, ...) with what is left of each text; a null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            kept = [cut(t, repeated_runs(f or [])).decode() for t, f in zip(utf8(columns[at]), batch.column(batch.num_columns - 1).to_pylist())]
            columns[at] = pa.array([t if v else None for t, v in zip(kept, columns[at].is_valid().to_pylist())], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _joined(docs).mapInArrow(run, docs.schema)


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """n_bytes, n_chunks, n_removed, n_spans and the text left of each row, byte by byte and with plain sets; for tests.

    Rows must differ in (doc_id, text).
    """
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen: set[bytes] = set()
    out: dict[int, tuple[int, int, int, int, str]] = {}
    for i in order:
        data = (rows[i][1] or "").encode()
        parts, start, h = [], 0, 0
        for k, b in enumerate(data):
            h = (2 * h + int(GEAR[b])) % (1 << 32)
            size = k + 1 - start
            if size == MOST or (size >= LEAST and h < (1 << 32) // SPACING):
                parts.append(data[start : k + 1])
                start = k + 1
        if start < len(data):
            parts.append(data[start:])
        again = []
        for p in parts:
            again.append(p in seen)
            seen.add(p)
        kept, removed, spans, k = b"", 0, 0, 0
        while k < len(parts):
            j = k
            while j < len(parts) and again[j] == again[k]:
                j += 1
            run = b"".join(parts[k:j])
            if again[k] and len(run) >= RUN:
                spans += 1
            else:
                kept += run
            k = j
        kept_text = kept.decode("utf-8", "ignore") if spans else data.decode()
        removed = len(data) - len(kept_text.encode())
        out[i] = (len(data), len(parts), removed, spans, kept_text)
    return [out[i] for i in range(len(rows))]
