"""Progressive JPEG: scans accumulated into coefficient arrays, and the way back to pixels.

`decode` reads any Huffman-coded progressive file (SOF2): first and refining
scans of DC and AC, spectral bands, interleaved or not, restart intervals.
A first scan is decoded in arrays: a run of codes of one length is guessed and
checked at once, other codes are looked up at every bit offset and their chain
is followed, and sums give each symbol its block and frequency. A refining
scan goes block by block only where new coefficients appear; blocks under an
end-of-band run take their correction bits together.

Files of one frame, with equal tables and scans, are decoded and encoded as a
stack, so that short files share the steps of numpy (`decode_all`, `encode_all`).
Where all of them have a value for every place of a scan, they are read at once;
other files of the stack are read one by one.

`encode` writes coefficients as such a file: first scans at the precision
`LOW` (DC of all components interleaved; the first component's AC in two
spectral bands), then one refining scan a bit and component.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct

import numpy as np

# Fixed value: the zigzag order, as the row-major place of each coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
LOW = 1
#: Magnitude bits of the coefficients that `encode` writes.
MAGNITUDE = 9
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.wide = self.high = self.cols = self.rows = 0
        self.blocks = np.zeros((0, 64), np.int32)


class Image:
    """Size, components with their zigzag coefficients, and quantisation tables (zigzag); or `many` images of one frame, whose blocks follow each other."""

    def __init__(self, width: int, height: int, components: list[Component], tables: dict[int, np.ndarray], many: int = 1):
        self.width, self.height, self.components, self.tables, self.many = width, height, components, tables, many
        self.h, self.v = max(c.h for c in components), max(c.v for c in components)
        self.mcus_wide, self.mcus_high = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        for c in components:
            c.cols, c.rows = self.mcus_wide * c.h, self.mcus_high * c.v  # with padding up to whole MCUs
            c.wide, c.high = -(-width * c.h // (8 * self.h)), -(-height * c.v // (8 * self.v))
            if len(c.blocks) != many * c.cols * c.rows:
                c.blocks = np.zeros((many * c.cols * c.rows, 64), np.int32)

    def stacked(self, c: Component) -> np.ndarray:
        """image x block x coefficient."""
        return c.blocks.reshape(self.many, -1, 64)

    def order(self, c: Component, interleaved: bool) -> np.ndarray:
        """The blocks of a component in the order of a scan."""
        make = _order if c.cols * c.rows <= 4096 else _order.__wrapped__
        return make(c.cols, c.rows, *((self.mcus_high, c.v, self.mcus_wide, c.h) if interleaved else (c.high, c.wide)))

    def places(self, c: Component, first: int, last: int) -> np.ndarray | slice:
        """The blocks from `first` up to `last` of a scan of one component."""
        return slice(first, last) if (c.cols, c.rows) == (c.wide, c.high) else self.order(c, False)[first:last]


@functools.lru_cache(512)
def _order(cols: int, rows: int, *shape: int) -> np.ndarray:
    grid = np.arange(cols * rows).reshape(rows, cols)
    order = (grid[: shape[0], : shape[1]] if len(shape) == 2 else grid.reshape(shape).transpose(0, 2, 1, 3)).ravel()
    order.flags.writeable = False
    return order


# ---- Huffman tables


class Table:
    """By 16-bit window: the length of the code that it starts with (0: none), its symbol, and what follows from it."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        at = k = 0
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                step = 1 << (16 - n)
                self.length[at : at + step], self.symbol[at : at + step] = n, symbols[k]
                at, k = at + step, k + 1
        known = self.length > 0
        self.run, self.size = self.symbol >> 4, self.symbol & 15
        #: Codes of a value without zeros before it, by length and size; 0 for others.
        self.alone = np.where((self.size > 0) & (self.run == 0), self.length * np.uint16(16) + self.size, 0).astype(np.uint16)
        self.ends = known & (self.size == 0) & (self.run < 15)  # end of band, with `run` more bits of its run
        #: Bits of the code and of what comes with it, in DC scans and in AC scans.
        self.dc = np.where(known, self.length + self.symbol, 0).astype(np.uint8)
        self.ac = np.where(known, self.length + np.where(self.ends, self.run, self.size), 0).astype(np.uint8)


def make_table(symbols: list[int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Codes 0, 10, 110, ... for up to 15 symbols, most frequent first; all ones stays free, as the format asks."""
    counts = bytes(1 if n < len(symbols) else 0 for n in range(16))
    return counts, bytes(symbols), {s: ((1 << (k + 1)) - 2, k + 1) for k, s in enumerate(symbols)}


# ---- Bits


class _Windows:
    """The 32 bits at any bit offsets of segments that follow each other, with ones beyond the end of each: a code and what comes with it."""

    def __init__(self, segments: list[bytes]):
        self.data = b"".join([x + b"\xff" * 8 for x in segments])
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        self.limits = 8 * (np.cumsum(sizes + 8) - 8)
        self.starts = self.limits - 8 * sizes
        self.eight = np.ndarray((len(self.data) - 7,), ">i8", self.data, strides=(1,))  # the 64 bits at any byte

    def wide(self, at: np.ndarray) -> np.ndarray:
        return (self.eight[at >> 3] >> (32 - (at & 7))) & 0xFFFFFFFF

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.wide(at) >> 16

    def one(self, at: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF


def _chain(windows: _Windows, total: np.ndarray, most: int) -> np.ndarray:
    """Bit offsets of up to `most` successive codes of a segment, whose bits `total` has by window.

    Codes of one length often follow each other, so a run of them is guessed
    and checked at once; short runs are followed one by one.
    """
    found: list[np.ndarray] = []
    p, left, limit = 0, most, int(windows.limits[0])
    while left > 0 and p < limit:
        step = int(total[windows.one(p)])
        if not step:
            break
        guess = p + step * np.arange(min(left, -(-(limit - p) // step)))
        got = total[windows[guess]]
        wrong = np.flatnonzero(got != step)
        n = int(wrong[0]) if len(wrong) else len(guess)
        found.append(guess[:n])
        p, left = p + step * n, left - n
        if n < 16 and len(wrong) and left > 0:
            found += map(np.array, _follow(windows, [total], left, p))
            break
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _follow(windows: _Windows, totals: list[np.ndarray], most: int, first: int = 0) -> list[list[int]]:
    """Of each segment the bit offsets of up to `most` successive codes, from `first` on; several tables take turns."""
    every = windows[np.arange(windows.limits[-1])]
    by_table: dict[int, bytes] = {}
    lengths = [by_table.setdefault(id(t), t[every].tobytes()) for t in totals]
    found = []
    for p, limit in zip((windows.starts + first).tolist(), windows.limits.tolist()):
        out: list[int] = []
        add = out.append
        for _, own in zip(range(most), itertools.cycle(lengths)):
            if p >= limit or not own[p]:
                break
            add(p)
            p += own[p]
        found.append(out)
    return found


def _values(wide: np.ndarray, length: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """The signed values of `size` bits (0 to 15) that follow codes of `length` bits in windows of 32."""
    raw = (wide >> (32 - length - size)) & _SPAN[size]
    return raw - _SPAN[size] * (raw < _HALF[size])


#: By size: the values from which on bits stand for themselves, and what the others are less by.
_HALF = np.array([0, *(1 << n for n in range(15))])
_SPAN = np.array([(1 << n) - 1 for n in range(16)])


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def number(self, n: int) -> int:
        v = 0
        for b in self.take(n).tolist():
            v = 2 * v + b
        return v

    def symbol(self, table: Table) -> int:
        w = int.from_bytes(np.packbits(self.bits[self.at : self.at + 16]).tobytes().ljust(2, b"\0"), "big")
        self.at += int(table.length[w]) or 1
        return int(table.symbol[w])



# ---- Scans


def _dc_first(image: Image, scan: list[tuple[Component, int, int]], tables: dict, segments: list[list[bytes]], every: int, low: int) -> None:
    interleaved = len(scan) > 1
    turns = [i for i, (c, _, _) in enumerate(scan) for _ in range(c.h * c.v if interleaved else 1)]
    orders = [image.order(c, interleaved) for c, _, _ in scan]
    blocks = [image.stacked(c) for c, _, _ in scan]
    mcus = image.mcus_wide * image.mcus_high if interleaved else len(orders[0])
    parts = {t: tables[0, t] for _, t, _ in scan}
    totals = [parts[scan[i][1]].dc for i in turns] if len(parts) > 1 else [parts[scan[0][1]].dc]
    done = 0
    for files in segments:
        n = min(every or mcus, mcus - done)
        windows = _Windows(files)
        found = _follow(windows, totals, n * len(turns))
        whole = all(len(at) == n * len(turns) for at in found)
        for k, some in [(slice(None), found)] if whole else [(slice(j, j + 1), [at]) for j, at in enumerate(found)]:
            wide = windows.wide(np.array(some, np.int64))
            turn = 0
            for i, (_, t, _) in enumerate(scan):
                many = turns.count(i)
                if whole:
                    own = wide.reshape(len(some), n, -1)[:, :, turn : turn + many].reshape(len(some), -1)
                else:
                    own = wide[:, np.isin(np.arange(wide.shape[1]) % len(turns), range(turn, turn + many))]
                turn += many
                w = own >> 16
                values = np.cumsum(_values(own, parts[t].length[w].astype(np.int64), parts[t].symbol[w].astype(np.int64)), axis=1)
                each = len(orders[i]) // mcus if mcus else 0
                blocks[i][k, orders[i][done * each : done * each + values.shape[1]], 0] = values << low
        done += n


def _bits_of(files: list[bytes], n: int) -> np.ndarray:
    """The first n bits of each segment."""
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(b"".join([x[:size] for x in files]), np.uint8).reshape(len(files), size), axis=1)[:, :n]


def _dc_refine(image: Image, scan: list[tuple[Component, int, int]], segments: list[list[bytes]], every: int, low: int) -> None:
    interleaved = len(scan) > 1
    orders = [image.order(c, interleaved) for c, _, _ in scan]
    mcus = image.mcus_wide * image.mcus_high if interleaved else len(orders[0])
    each = [len(o) // mcus for o in orders]
    done = 0
    for files in segments:
        n = min(every or mcus, mcus - done)
        bits = _bits_of(files, n * sum(each)).reshape(len(files), n, -1)
        first = 0
        for (c, _, _), o, k in zip(scan, orders, each):
            image.stacked(c)[:, o[done * k : (done + n) * k], 0] |= bits[:, :, first : first + k].reshape(len(files), -1).astype(np.int32) << low
            first += k
        done += n


def _ac_first(image: Image, c: Component, table: Table, segments: list[list[bytes]], every: int, start: int, end: int, low: int) -> None:
    blocks, all_blocks = image.stacked(c), c.wide * c.high
    band = end - start + 1
    done = 0
    for files in segments:
        n = min(every or all_blocks, all_blocks - done)
        windows = _Windows(files)
        kind = int(table.alone[windows.one(0)])
        length, size = kind >> 4, kind & 15
        if kind and (windows.limits - windows.starts >= (length + size) * n * band).all():
            wide = windows.wide(windows.starts[:, None] + (length + size) * np.arange(n * band))
            if (table.alone[wide >> 16] == kind).all():  # one code, and a value for every place
                blocks[:, image.places(c, done, done + n), start : end + 1] = (_values(wide, length, size) << low).reshape(len(files), n, band)
                done += n
                continue
        for data, own in zip(files, blocks):
            _ac_first_of(own, image.order(c, False)[done : done + n], table, data, start, band, low)
        done += n


def _ac_first_of(blocks: np.ndarray, order: np.ndarray, table: Table, data: bytes, start: int, band: int, low: int) -> None:
    n = len(order)
    windows = _Windows([data])
    at = _chain(windows, table.ac, n * (band + 1))
    wide = windows.wide(at)
    w = wide >> 16
    length, s = table.length[w].astype(np.int64), table.size[w].astype(np.int64)
    if len(at) == n * band and table.alone[w].all():  # a symbol for every place
        blocks[order, start : start + band] = _values(wide, length, s).reshape(n, band) << low
        return
    r, stop = table.run[w].astype(np.int64), table.ends[w]
    # Places as if bands followed one another: a symbol advances by its run and itself; an end of band to the end
    # of its block and over the blocks of its run.
    step = np.where(stop, 0, r + 1)
    place = np.cumsum(step) - 1
    if stop.any():
        where = np.flatnonzero(stop)
        raw = (wide[where] >> (32 - length[where] - r[where])) & _SPAN[r[where]]
        over = np.where(r[where] > 0, (1 << r[where]) + np.where(r[where] > 0, raw, 0), 1)
        walked = np.concatenate([[0], np.cumsum(step)])[where]
        since = np.diff(np.concatenate([[0], walked]))
        base = np.cumsum((since // band + over) * band)  # where the part after each end of band begins
        part = np.cumsum(stop) - stop
        place += np.concatenate([[0], base - walked])[part]
    values = _values(wide, length, s) << low
    new = (s > 0) & (place < n * band)
    blocks[order[place[new] // band], start + place[new] % band] = values[new]


def _ac_refine(image: Image, c: Component, table: Table, segments: list[list[bytes]], every: int, start: int, end: int, low: int) -> None:
    blocks, all_blocks = image.stacked(c), c.wide * c.high
    band = end - start + 1
    done = 0
    for files in segments:
        n = min(every or all_blocks, all_blocks - done)
        places = image.places(c, done, done + n)
        # Under a run over all blocks, values everywhere take a bit each.
        bits = _Bits(files[0][:8])
        rs = bits.symbol(table)
        head = bits.at + (rs >> 4)
        if rs & 15 == 0 and rs < 0xF0 and (1 << (rs >> 4)) + bits.number(rs >> 4) == n and all(8 * len(x) >= head + n * band for x in files):
            values = blocks[:, places, start : end + 1]
            found = _bits_of(files, head + n * band)
            if (found[:, :head] == found[:1, :head]).all() and values.all():
                more = found[:, head:].reshape(values.shape).astype(np.int32) << low
                blocks[:, places, start : end + 1] = values + (more if (values > 0).all() else np.sign(values) * more)
                done += n
                continue
        for data, own in zip(files, blocks):
            _ac_refine_of(own, image.order(c, False)[done : done + n], table, data, start, end, low)
        done += n


def _ac_refine_of(blocks: np.ndarray, order: np.ndarray, table: Table, data: bytes, start: int, end: int, low: int) -> None:
    one, n = 1 << low, len(order)
    bits = _Bits(data)
    b = 0
    while b < n:
        row = blocks[order[b], start : end + 1]
        k, run = 0, 0
        while k <= end - start:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s == 0 and r < 15:
                run = (1 << r) + (bits.number(r) if r else 0)
                break
            value = (one if bits.number(1) else -one) if s else 0
            # Pass r zeros; what is not zero on the way takes a correction bit.
            zero = np.flatnonzero(row[k:] == 0)
            to = k + int(zero[r]) if r < len(zero) else end - start + 1
            _correct(row[k:to], bits, one)
            if value and to <= end - start:
                row[to] = value
            k = to + 1
        if run:
            if k:
                _correct(row[k:], bits, one)
                blocks[order[b], start : end + 1] = row
            more = order[b + (k > 0) : min(n, b + run)]
            if len(more):
                many = blocks[more, start : end + 1]
                flat = many.ravel()
                _correct(flat, bits, one)
                blocks[more, start : end + 1] = flat.reshape(many.shape)
            b += run
        else:
            blocks[order[b], start : end + 1] = row
            b += 1


def _correct(values: np.ndarray, bits: _Bits, one: int) -> None:
    if values.all():
        values += np.sign(values) * (bits.take(len(values)) * np.int32(one))
        return
    some = np.flatnonzero(values)
    if len(some):
        more = bits.take(len(some)).astype(np.int32) * one
        values[some] += np.where(values[some] > 0, more, -more)


def decode(data: bytes) -> Image:
    """Accumulate the scans of a progressive file into coefficient arrays."""
    return decode_all([data])[0][1]


def decode_all(files: list[bytes]) -> list[tuple[list[int], Image]]:
    """The files as stacks of those with equal heads: the places of a stack's files, and their images."""
    alike: dict[tuple, tuple[list[int], list[list[list[bytes]]]]] = {}
    for i, data in enumerate(files):
        heads, scans = _parts(data)
        which, coded = alike.setdefault((heads, tuple(map(len, scans))), ([], []))
        which.append(i)
        coded.append(scans)
    return [(which, _decoded(heads, coded)) for (heads, _), (which, coded) in alike.items()]


def _parts(data: bytes) -> tuple[tuple[bytes, ...], list[list[bytes]]]:
    """The marker segments of a file, marker and body, and of each scan its entropy-coded segments."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, heads, scans = 2, [], []
    while data[at + 1] != 0xD9:
        size = data[at + 2] << 8 | data[at + 3]
        heads.append(data[at + 1 : at + 2] + data[at + 4 : at + 2 + size])
        scan = data[at + 1] == 0xDA
        at += 2 + size
        if scan:
            stop = _MARKER.search(data, at)
            to = stop.start() if stop else len(data)
            scans.append([s.replace(b"\xff\x00", b"\xff") for s in _RESTART.split(data[at:to])])
            at = to
    return tuple(heads), scans


def _decoded(heads: tuple[bytes, ...], coded: list[list[list[bytes]]]) -> Image:
    """The images of files with these heads; by file, scan and restart interval, what is coded."""
    every, turn = 0, 0
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Table] = {}
    image: Image | None = None
    for head in heads:
        marker, body = head[0], head[1:]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, ident = body[k] >> 4, body[k] & 15
                quant[ident] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                tables[body[k] >> 4, body[k] & 15] = _table(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xC2:
            height, width, many = struct.unpack_from(">HHB", body, 1)
            image = Image(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)], quant, len(coded))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a Huffman-coded progressive file")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            assert image is not None
            n = body[0]
            by = {c.ident: c for c in image.components}
            scan = [(by[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            high, low = bits >> 4, bits & 15
            segments = [list(files) for files in zip(*(scans[turn] for scans in coded))]
            turn += 1
            if start == 0:
                (_dc_refine(image, scan, segments, every, low) if high else _dc_first(image, scan, tables, segments, every, low))
            else:
                (_ac_refine if high else _ac_first)(image, scan[0][0], tables[1, scan[0][2]], segments, every, start, end, low)
    if image is None:
        raise ValueError("no frame")
    return image


_KNOWN: dict[tuple[bytes, bytes], Table] = {}


def _table(counts: bytes, symbols: bytes) -> Table:
    if (counts, symbols) not in _KNOWN:
        if len(_KNOWN) > 64:
            _KNOWN.clear()
        _KNOWN[counts, symbols] = Table(counts, symbols)
    return _KNOWN[counts, symbols]


# ---- Pixels

_U, _X = np.arange(8)[:, None], np.arange(8)[None, :]
_COS = np.where(_U == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16)
#: zigzag coefficient x pixel: the inverse transform of a block as one product, in units of 2^-28. Whole numbers below 2^53
#: are exact in doubles, so that a block's pixels don't depend on the blocks beside it.
_SCALE = 2.0**-28
_INVERSE = np.rint(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG] / _SCALE)


def plane(image: Image, c: Component) -> np.ndarray:
    """The samples of a component, inverse-transformed, before clamping; those of a stack's images one below the other."""
    quant = image.tables.get(c.table)
    coefficients = c.blocks.astype(np.float64)
    if quant is not None and (quant != 1).any():
        coefficients *= quant
    pixels = coefficients @ _INVERSE
    pixels *= _SCALE
    rows = image.many * c.rows
    return pixels.reshape(rows, c.cols, 8, 8).transpose(0, 2, 1, 3).astype(np.float32, order="C").reshape(8 * rows, 8 * c.cols) + np.float32(128)


def rgb(image: Image) -> np.ndarray:
    """height x width x 3, chroma upsampled to full resolution."""
    return rgb_all(image)[0]


def rgb_all(image: Image) -> np.ndarray:
    """The tensors of a stack: image x height x width x 3."""
    out = np.empty((image.many, image.height, image.width, 3), np.uint8)
    planes = [np.clip(plane(image, c), 0, 255) for c in image.components]
    apart = lambda x: x.reshape(image.many, -1, x.shape[1])[:, : image.height, : image.width]
    if len(planes) < 3:
        out[:] = np.rint(apart(_upsampled(image, image.components[0], planes[0])))[..., None].astype(np.uint8)
        return out
    first, second, third = image.components[:3]
    y = _upsampled(image, first, planes[0])
    cb, cr = planes[1] - np.float32(128), planes[2] - np.float32(128)
    alike = (second.h, second.v) == (third.h, third.v)
    up = lambda c, x: _upsampled(image, c, x)
    # What chroma adds is computed at its own resolution.
    green = up(second, np.float32(0.344136) * cb + np.float32(0.714136) * cr) if alike else up(second, np.float32(0.344136) * cb) + up(third, np.float32(0.714136) * cr)
    for i, x in enumerate((y + up(third, np.float32(1.402) * cr), y - green, y + up(second, np.float32(1.772) * cb))):
        np.rint(x, out=x)
        np.clip(x, 0, 255, out=x)
        out[..., i] = apart(x)
    return out


def _upsampled(image: Image, c: Component, p: np.ndarray) -> np.ndarray:
    """A component's plane at full resolution, each sample repeated."""
    v, h = image.v // c.v, image.h // c.h
    if v == h == 1:
        return p
    return np.broadcast_to(p[:, None, :, None], (p.shape[0], v, p.shape[1], h)).reshape(p.shape[0] * v, p.shape[1] * h)


# ---- Writing


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def _stuffed(bits: np.ndarray, sizes: np.ndarray | None = None) -> list[bytes]:
    """Each row's bits as bytes, filled up with ones; with `sizes` only so many bits of a row, and ones after them."""
    data = np.packbits(bits, axis=1)
    if bits.shape[1] % 8:
        data[:, -1] |= (1 << -bits.shape[1] % 8) - 1
    many, wide = data.shape
    flat = data.tobytes()
    ends = [wide] * many if sizes is None else (-(-sizes // 8)).tolist()
    return [flat[i * wide : i * wide + n].replace(b"\xff", b"\xff\x00") for i, n in enumerate(ends)]


def _joined(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of codes of up to 32 bits, one after another."""
    most = int(size.max()) if len(size) else 0
    shift = np.arange(most - 1, -1, -1)
    wide = (code.astype(np.int32)[:, None] >> shift.astype(np.int32)[None, :]).astype(np.uint8) & 1
    if len(size) and size.min() == most:
        return wide.ravel()
    return wide[shift[None, :] < size[:, None]]


def _tokens(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of DC differences by row, each the symbol of its size and so many bits of its value, and how many they are."""
    code, length = np.zeros(16, np.int64), np.zeros(16, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    sizes = _bit_size(values)
    extra = np.where(values < 0, values + (1 << sizes) - 1, values)
    taken = length[sizes] + sizes
    many = taken.sum(axis=1)
    bits = np.ones((len(values), int(many.max())), np.uint8)
    bits[np.arange(bits.shape[1]) < many[:, None]] = _joined(((code[sizes] << sizes) | extra).ravel(), taken.ravel())
    return bits, many


def _fixed_tokens(values: np.ndarray) -> np.ndarray:
    """Bits by row of AC symbols of positive values of 8 bits each, all with the same code."""
    code, length = _AC_TABLE[2][MAGNITUDE - LOW]
    bits = np.empty((*values.shape, length + 8), np.uint8)
    bits[..., :length] = [code >> i & 1 for i in range(length - 1, -1, -1)]
    bits[..., length:] = np.unpackbits(values.astype(np.uint8)[..., None], axis=-1)
    return bits.reshape(len(values), -1)


_BIT_SIZE = np.array([i.bit_length() for i in range(1 << 12)])


def _bit_size(v: np.ndarray) -> np.ndarray:
    return _BIT_SIZE[np.abs(v)]


@functools.lru_cache(1024)
def _end_of_bands(n: int) -> np.ndarray:
    return _run_bits(n, _RUN_TABLE[2])


def _run_bits(n: int, codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """An end-of-band run of n blocks (1 to 32767)."""
    k = n.bit_length() - 1
    c, length = codes[k << 4]
    return _joined(np.array([(c << k) | (n - (1 << k))]), np.array([length + k]))


# DC differences by size; AC symbols without zeros before them by size, then runs of end of band.
_DC_TABLE = make_table(list(range(12)))
_AC_TABLE = make_table([MAGNITUDE - LOW, *(s for s in range(1, 9) if s != MAGNITUDE - LOW), *(0x10 * i for i in range(7))])
_RUN_TABLE = make_table([0x10 * k for k in range(14, -1, -1)])
_TABLES = b"".join(_segment(0xC4, bytes([kind << 4 | ident]) + counts + symbols) for kind, ident, (counts, symbols, _) in ((0, 0, _DC_TABLE), (1, 0, _AC_TABLE), (1, 1, _RUN_TABLE)))


def encode(image: Image) -> bytes:
    """A progressive file of positive coefficients of exactly MAGNITUDE bits, as `media` makes them."""
    return encode_all(image)[0]


def encode_all(image: Image) -> list[bytes]:
    """The files of a stack's images."""
    head = [b"\xff\xd8"]
    for ident, q in sorted(image.tables.items()):
        head.append(_segment(0xDB, bytes([ident]) + q.astype(np.uint8).tobytes()))
    frame = struct.pack(">BHHB", 8, image.height, image.width, len(image.components))
    head.append(_segment(0xC2, frame + b"".join(bytes([c.ident, c.h << 4 | c.v, c.table]) for c in image.components)))
    head.append(_TABLES)
    parts, many = image.components, image.many
    out = [[b"".join(head)] for _ in range(many)]

    def scan(who: list[Component], table: int, start: int, end: int, high: int, low: int, bits: np.ndarray, sizes: np.ndarray | None = None) -> None:
        own = _segment(0xDA, bytes([len(who)]) + b"".join(bytes([c.ident, table]) for c in who) + bytes([start, end, high << 4 | low]))
        for file, coded in zip(out, _stuffed(bits, sizes)):
            file += (own, coded)

    dc = [image.stacked(c)[:, image.order(c, True), 0].reshape(many, image.mcus_wide * image.mcus_high, -1) for c in parts]
    steps = [d >> LOW for d in dc]
    for step in steps:
        flat = step.reshape(many, -1)  # a view
        flat[:, 1:] -= flat[:, :-1].copy()
    scan(parts, 0, 0, 0, 0, LOW, *_tokens(np.concatenate(steps, axis=2).reshape(many, -1).astype(np.int64), _DC_TABLE[2]))
    inner = {c.ident: image.stacked(c)[:, image.places(c, 0, c.wide * c.high)] for c in parts}
    for c in parts:
        for start, end in [(1, 5), (6, 63)] if c is parts[0] else [(1, 63)]:
            scan([c], 0, start, end, 0, LOW, _fixed_tokens((inner[c.ident][:, :, start : end + 1] >> LOW).reshape(many, -1)))
    for low in range(LOW - 1, -1, -1):
        scan(parts, 0, 0, 0, low + 1, low, ((np.concatenate(dc, axis=2).reshape(many, -1) >> low) & 1).astype(np.uint8))
        for c in parts:
            blocks = inner[c.ident]
            bits = []
            for at in range(0, blocks.shape[1], 32767):
                some = blocks[:, at : at + 32767, 1:]
                run = _end_of_bands(some.shape[1])
                bits += [np.broadcast_to(run, (many, len(run))), ((some >> low) & 1).astype(np.uint8).reshape(many, -1)]
            scan([c], 1, 1, 63, low + 1, low, np.concatenate(bits, axis=1))
    return [b"".join([*file, b"\xff\xd9"]) for file in out]
