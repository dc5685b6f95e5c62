"""Media columns: payload bytes stored as progressive JPEG, read back, and decoded to RGB tensors.

The lossless unit of a JPEG file is the quantised coefficient. `store` writes
each payload byte b as the coefficient 256 + b of a 4:2:0 image, so that every
byte costs its first scan's share and LOW refining bits; `read` accumulates
the scans into coefficient arrays (see `jpeg`) and takes the bytes back out of
them. The same arrays give, inverse-transformed in numpy and with the chroma
upsampled, the full-resolution RGB tensor, of which `feature` is computed.

A null text counts as empty. A payload is the text's UTF-8 bytes and 255s up
to a positive multiple of 576; 255 is no byte of UTF-8, so its length comes
back too. Short payloads of one image size are stored, read and decoded as a
stack, a bounded number of MCUs at once. Equal texts give equal files, tensors and features; repeated rows
give repeated rows; a very long text makes one large file. Other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import jpeg
from .common import small_batches, utf8

UNIT = 576
FILL = 255
_BASE = 256
_MCU = 6 * 64
#: MCUs of the widest image of the format.
_ROW_MCUS = 65535 // 16
_ONES = {0: np.ones(64, np.int32)}
#: MCUs of the images of one stack, about; a larger image is a stack of its own.
TOGETHER = 512
#: Output bytes that one batch gathers before it is sent on.
_SEND = 8 << 20


def payload_of(text: bytes) -> bytes:
    units = max(1, -(-len(text) // UNIT))
    return text + bytes([FILL]) * (units * UNIT - len(text))


def _mcus(size: int) -> int:
    return -(-size // _MCU)


def _frame(wide: int, high: int, many: int) -> jpeg.Image:
    return jpeg.Image(16 * wide, 16 * high, [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)], _ONES, many)


def store(payload: bytes) -> bytes:
    """A progressive JPEG file whose coefficients hold the payload."""
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """The files of payloads of one number of MCUs."""
    mcus = _mcus(len(payloads[0]))
    wide = mcus if mcus <= _ROW_MCUS else math.isqrt(mcus - 1) + 1  # one row has no MCUs of padding
    image = _frame(wide, -(-mcus // wide), len(payloads))
    size = image.mcus_wide * image.mcus_high * _MCU
    values = np.frombuffer(b"".join([p.ljust(size, bytes([FILL])) for p in payloads]), np.uint8).reshape(len(payloads), size).astype(np.int32)
    values += _BASE
    at = 0
    for c in image.components:
        n = 64 * c.cols * c.rows
        c.blocks = values[:, at : at + n].reshape(-1, 64)
        at += n
    return jpeg.encode_all(image)


def read(media: bytes) -> tuple[bytes, int, jpeg.Image]:
    """The payload in a stored file, the length of its text, and the decoded image."""
    image = jpeg.decode(media)
    return *payloads_of(image)[0], image


def payloads_of(image: jpeg.Image) -> list[tuple[bytes, int]]:
    """The payload and the length of its text in each image of a stack."""
    values = np.concatenate([image.stacked(c).reshape(image.many, -1) for c in image.components], axis=1) - _BASE
    found = []
    for row in values.astype(np.uint8):
        data = row.tobytes()
        n = len(data.rstrip(bytes([FILL])))
        found.append((data[: max(1, -(-n // UNIT)) * UNIT], n))
    return found


def feature(tensor: np.ndarray) -> str:
    """Size, and each channel's mean, deviation and mean step from column to column."""
    return features(tensor[None])[0]


def features(tensors: np.ndarray) -> list[str]:
    """`feature` of each tensor of a stack; whole numbers in doubles, so sums are exact."""
    many, high, wide = tensors.shape[:3]
    channels = np.ascontiguousarray(tensors.transpose(0, 3, 1, 2)).reshape(many * 3, high, wide)
    flat = channels.reshape(many * 3, -1).astype(np.float64)
    total, squares = flat.sum(axis=1), np.einsum("ij,ij->i", flat, flat)
    left, right = channels[:, :, :-1], channels[:, :, 1:]
    steps = (np.maximum(left, right) - np.minimum(left, right)).reshape(many * 3, -1).sum(axis=1, dtype=np.int64)
    n = high * wide
    parts = [f"{t / n:.3f}/{math.sqrt(max(0.0, q / n - (t / n) ** 2)):.3f}/{s / n:.3f}" for t, q, s in zip(total.tolist(), squares.tolist(), steps.tolist())]
    return [f"{wide}x{high}:" + ",".join(parts[3 * i : 3 * i + 3]) for i in range(many)]


def _stacks(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of texts whose images have one size, so many together as TOGETHER allows."""
    by: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        by.setdefault(_mcus(max(1, -(-len(text) // UNIT)) * UNIT), []).append(i)
    for mcus, which in by.items():
        many = max(1, TOGETHER // mcus)
        for at in range(0, len(which), many):
            yield which[at : at + many]


def _rows(texts: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """The place of each text and what `media_columns` has of it."""
    for which in _stacks(texts):
        files = store_all([payload_of(texts[i]) for i in which])
        for own, image in jpeg.decode_all(files):
            tensors = jpeg.rgb_all(image)
            for k, (payload, n), tensor, feature_ in zip(own, payloads_of(image), tensors, features(tensors)):
                yield which[k], (n, payload, files[k], image.width, image.height, tensor.tobytes(), feature_)


def media_columns(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and n_bytes, payload, media, width, height, rgb (row-major bytes), feature, of each row's text."""
    small_batches(docs.sparkSession, rows=500, mb=4)
    kept = docs.select(*keep, F.col("text").alias("__text"))
    names = [*keep, "n_bytes", "payload", "media", "width", "height", "rgb", "feature"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which, held = [], [], 0
            texts = utf8(batch.column(batch.num_columns - 1))
            for k, (i, row) in enumerate(_rows(texts)):
                rows.append(row)
                which.append(i)
                held += len(row[1]) + len(row[2]) + len(row[5])
                if held >= _SEND or k + 1 == len(texts):
                    own = pa.array(which)
                    yield pa.RecordBatch.from_arrays([c.take(own) for c in batch.columns[:-1]] + [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)
                    rows, which, held = [], [], 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "n_bytes long, payload binary, media binary, width int, height int, rgb binary, feature string"])
    return kept.mapInArrow(run, schema)
