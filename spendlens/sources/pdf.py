"""Text of PDF statements: the text items of a page, those of one height as a line.

`lines_of` reads what statements use: objects, object streams, Flate streams and
the text operators of page contents, with one byte a character (Windows-1252).
Fonts with wider codes give what their bytes spell. `made` writes such files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
#: Of a page's contents: strings, hexadecimal strings, names, numbers, brackets and operators.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]*|[-+]?(?:\d+\.?\d*|\.\d+)|\[|\]|[A-Za-z'\"*][A-Za-z0-9*]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """number -> (dictionary, stream contents) of every object; damaged streams are empty."""
    found: dict[int, tuple[bytes, bytes]] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        end = len(data) if end < 0 else end
        stream = _STREAM.search(data, m.end(), end)
        head, body = data[m.end() : stream.start() if stream else end], b""
        if stream:
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = stream.end() + int(length[1]) if length else data.find(b"endstream", stream.end())
            body = data[stream.end() : stop if stop >= 0 else len(data)]
            end = max(end, data.find(b"endobj", stop)) if stop >= 0 else end
            if b"FlateDecode" in head:
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    body = b""
        found[int(m[1])] = (head, body)
        at = end
    for head, body in list(found.values()):
        if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
            numbers = [int(x) for x in body[: int(first[1])].split()]
            places = [p + int(first[1]) for p in numbers[1::2]] + [len(body)]
            for number, a, b in zip(numbers[::2], places, places[1:]):
                found.setdefault(number, (body[a:b], b""))
    return found


def _pages(objects: dict[int, tuple[bytes, bytes]]) -> Iterator[int]:
    """The pages in the order of the page tree; without one, as they are numbered."""
    def walk(number: int, seen: set[int]) -> Iterator[int]:
        head = objects.get(number, (b"", b""))[0]
        if number in seen:
            return
        seen.add(number)
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", head, re.S):
            for kid in _REF.findall(kids[1]):
                yield from walk(int(kid), seen)
        elif re.search(rb"/Type\s*/Page\b", head):
            yield number

    roots = [n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", head) and not re.search(rb"/Parent\b", head)]
    yield from (p for r in sorted(roots) for p in walk(r, set())) if roots else sorted(n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Page\b", head))


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def plain(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def items_of(contents: bytes) -> Iterator[tuple[float, str]]:
    """(height, text) of every text that a page's contents show."""
    y = leading = 0.0
    stack: list = []
    array: list | None = None
    for m in _TOKEN.finditer(contents):
        t = m[0]
        if t == b"[":
            array = []
        elif t == b"]":
            stack, array = [array or []], None
        elif t[:1] in b"(<":
            (stack if array is None else array).append(_string(t))
        elif t[:1] in b"+-.0123456789":
            (stack if array is None else array).append(float(t))
        elif t[:1] == b"/":
            stack.append(t)
        else:
            last = [x for x in stack if isinstance(x, float)]
            if t == b"BT":
                y = 0.0
            elif t == b"Tm" and len(last) == 6:
                y = last[5]
            elif t in (b"Td", b"TD") and len(last) >= 2:
                y += last[-1]
                leading = -last[-1] if t == b"TD" else leading
            elif t == b"TL" and last:
                leading = last[-1]
            elif t in (b"T*", b"'", b'"'):
                y -= leading
            if t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], str):
                yield y, stack[-1]
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                yield y, "".join(x for x in stack[-1] if isinstance(x, str))
            stack = []


def text_of(data: bytes) -> str | None:
    """The pages' text, items of one height in a line, or null if nothing can be read."""
    if not data or b"%PDF" not in data[:1024]:
        return None
    objects, pages = _objects(data), []
    for page in _pages(objects):
        contents = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", objects[page][0], re.S)
        shown = b"\n".join(objects.get(int(n), (b"", b""))[1] for n in _REF.findall(contents[1] or contents[2])) if contents else b""
        out, last = "", None
        for y, string in items_of(shown):
            if string:
                out += ("" if last is None or y == last else "\n") + string + " "
                last = y
        pages.append(out)
    text = "\n".join(p for p in pages if p)
    return text or None


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(v) for v in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


def texts(files: DataFrame) -> DataFrame:
    """doc_id, text of each PDF of `files` (doc_id, body binary); damaged files have a null text."""
    return files.select(F.col("doc_id").cast("long"), F.col("body").cast("binary")).mapInArrow(_texts, "doc_id long, text string")


def made_file(text: str, lines_a_page: int = 40) -> bytes:
    """A PDF that shows the lines of a text, their words as items of their own."""
    show = lambda w: b"(" + re.sub(rb"([\\()])", rb"\\\1", w.encode("cp1252", "replace")) + b") Tj"
    lines = text.split("\n")
    pages = [lines[i : i + lines_a_page] for i in range(0, len(lines), lines_a_page)]
    out, kids = [b"%PDF-1.4\n"], b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(pages)))
    out += [b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", b"2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] /Count %d >>\nendobj\n" % len(pages)]
    for k, page in enumerate(pages):
        drawn = [b"BT /F1 9 Tf"]
        for i, line in enumerate(page):
            drawn += [b"1 0 0 1 %d %d Tm %s" % (40 + 90 * j, 800 - 15 * i, show(word)) for j, word in enumerate(line.split(" "))]
        body = zlib.compress(b"\n".join([*drawn, b"ET"]))
        out += [b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (3 + 2 * k, 4 + 2 * k),
                b"%d 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n" % (4 + 2 * k, len(body)), body, b"\nendstream\nendobj\n"]
    return b"".join([*out, b"trailer << /Root 1 0 R >>\n%%EOF"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made_file(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "body"])


def made(texts: DataFrame) -> DataFrame:
    """doc_id, body: a PDF of each text of `texts` (doc_id, text)."""
    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(_files, "doc_id long, body binary")
