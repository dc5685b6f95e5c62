r"""Chat formatting of messages whose content is a list of typed parts.

A part is text, an image, an audio clip or a document, which may hold parts of
its own. `Visitor` walks them and flattens a turn into one string: texts as they
are but for escapes, each attachment as a placeholder, in order; for each
placeholder it records the attachment's reference, its place and the number of
tokens that will stand there once a model has expanded it.

    <|im_start|>ROLE\n CONTENT <|im_end|>\n          (without the spaces)

A text can't hold a mark: in `<|`, and in `<\|`, `<\\|` and so on, one more `\` is
put before the bar, which `unescape` takes out. Neighbouring texts are joined
before, so that no mark arises between them.

`format_turns` works row by row. `conversations` then sorts turns by
conversation and cuts each into rows of about `SEGMENT` characters, whole turns
in each, as a stream: no conversation is held whole, however many turns it has.
Its rows give the string, its place, the loss mask (spans of the assistant's own
texts) and the attachments, places counted in the conversation's characters.
`read_back` parses those rows again, also as a stream.

A null text, role or list of parts is empty. Turns are ordered by turn (null
first), then role, then content; repeated rows are turns of their own; null
conv_ids are one conversation. A part of unknown type is text if it has one and
a `<|file|>` of one token if not. Sizes that are null or below 1 count as the
least that gives one token; very long texts stay whole. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, written

PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
CONTENT = f"array<struct<{', '.join(c.replace(' ', ': ') for c in PART.split(', '))}, parts: array<struct<{', '.join(c.replace(' ', ': ') for c in PART.split(', '))}>>>>"
#: Characters after which a row of a conversation ends.
SEGMENT = 1 << 16
LEARNED = "assistant"
START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<\|([^|]*)\|>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclasses.dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for."""

    patch: int = 28  # pixels of a square that gives one token
    per_second: float = 25.0
    per_page: int = 256

    def image(self, width: int | None, height: int | None) -> int:
        return max(1, math.ceil((width or 1) / self.patch)) * max(1, math.ceil((height or 1) / self.patch))

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil(seconds * self.per_second)) if seconds and math.isfinite(seconds) else 1

    def document(self, pages: int | None) -> int:
        return max(1, pages or 1) * self.per_page


class Visitor:
    """Flattens the parts of one turn; `string` is what has been written, `spans` where the turn's own texts are."""

    def __init__(self, expansion: Expansion, count):
        self.expansion, self.count = expansion, count
        self.out: list[str] = []
        self.length = self.tokens = 0
        self.waiting: list[str] = []
        self.inside = False
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, string: str) -> None:
        self.out.append(string)
        self.length += len(string)

    def turn(self, role: str, parts: list[dict]) -> str:
        self.write(f"{START}{escape_role(role)}\n")
        self.tokens += 2 + self.count(role)
        for part in parts:
            self.visit(part or {})
        self.flush()
        self.write(f"{END}\n")
        return "".join(self.out)

    def visit(self, part: dict) -> None:
        {"image": self.image, "audio": self.audio, "document": self.document}.get(part.get("type"), self.text)(part)

    def text(self, part: dict) -> None:
        if part.get("text") is not None:
            self.waiting.append(part["text"])
        elif part.get("type") not in ("text", None):
            self.placeholder("file", part, 1)

    def image(self, part: dict) -> None:
        self.placeholder("image", part, self.expansion.image(part.get("width"), part.get("height")))

    def audio(self, part: dict) -> None:
        self.placeholder("audio", part, self.expansion.audio(part.get("seconds")))

    def document(self, part: dict) -> None:
        """A document with parts stands for what they give; one without, for its pages."""
        inner = part.get("parts") or []
        self.placeholder("document", part, 1 if inner else self.expansion.document(part.get("pages")))
        if inner:
            self.inside = True
            for p in inner:
                self.visit((p or {}) | {"parts": None})
            self.flush()
            self.inside = False
            self.write("<|/document|>")

    def placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens, "at": self.length})
        self.tokens += tokens
        self.write(f"<|{kind}|>")

    def flush(self) -> None:
        """Write the texts gathered since the last placeholder."""
        text, self.waiting = "".join(self.waiting), []
        if text:
            start = self.length
            self.write(escape(text))
            self.tokens += self.count(text)
            if not self.inside:
                self.spans.append({"start": start, "end": self.length})


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))
_ROW = "conv_id long, {}, formatted string, n_chars long, loss array<struct<start: long, end: long>>, attachments array<struct<kind: string, ref: string, tokens: long, at: long>>, tokens long"
_KINDS = [pa.string(), pa.int64(), _SPAN, _ATTACHED, pa.int64()]
_OUT = ["formatted", "n_chars", "loss", "attachments", "tokens"]


def _formatted(expansion: Expansion, vocabulary: str | None):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lambda text: 0
        if vocabulary:
            from .packing import encoder

            encode = encoder(vocabulary).encode
            count = lambda text: len(encode(text)) // 4
        for batch in stream:
            rows = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                visitor = Visitor(expansion, count)
                string = visitor.turn(role or "", parts or [])
                rows.append((string, visitor.length, visitor.spans if role == LEARNED else [], visitor.attachments, visitor.tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS))], ["conv_id", "turn", "role", *_OUT])

    return run


def format_turns(messages: DataFrame, expansion: Expansion = Expansion(), vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, n_chars, loss, attachments, tokens of each row of `messages` (conv_id, turn, role, content: CONTENT).

    Places count from the turn's start. With a vocabulary's path, tokens holds the texts' and roles' tokens too, without one only marks and attachments.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("content").cast(CONTENT).alias("content"))
    return rows.mapInArrow(_formatted(expansion, vocabulary), _ROW.format("turn long, role string"))


def _segments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, gathered into rows of SEGMENT characters: neither conversation nor batch is held whole."""
    conv, segment, start, held = None, 0, 0, []
    length = 0
    first = True

    def send() -> pa.RecordBatch:
        spans, attached, at = [], [], start
        for r in held:
            spans += [{"start": s["start"] + at, "end": s["end"] + at} for s in r["loss"]]
            attached += [a | {"at": a["at"] + at} for a in r["attachments"]]
            at += r["n_chars"]
        row = [conv, segment, start, "".join(r["formatted"] for r in held), length, spans, attached, sum(r["tokens"] for r in held)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int64(), pa.int64(), *_KINDS])], ["conv_id", "segment", "start", *_OUT])

    for batch in stream:
        for r in batch.select(["conv_id", *_OUT]).to_pylist():
            if held and (r["conv_id"] != conv or length + r["n_chars"] > SEGMENT):
                yield send()
                segment, start, held, length = segment + 1, start + length, [], 0
            if first or r["conv_id"] != conv:
                conv, segment, start, first = r["conv_id"], 0, 0, False
            held.append(r)
            length += r["n_chars"]
    if held:
        yield send()


def conversations(messages: DataFrame, expansion: Expansion = Expansion(), vocabulary: str | None = None) -> DataFrame:
    """conv_id, segment, start, formatted, n_chars, loss, attachments, tokens: each conversation in rows of bounded size, written to the shared folder."""
    with batches(messages.sparkSession, rows=1000, mb=4):
        turns = format_turns(messages, expansion, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
        return written(turns.mapInArrow(_segments, _ROW.format("segment long, start long")), "chat")


def turns_of(formatted: str) -> Iterator[tuple[str, str, list[str]]]:
    """Role, own text and placeholders of each turn of a formatted string."""
    role, texts, found, last, inside = "", [], [], 0, False
    for mark in _MARK.finditer(formatted):
        between, last = formatted[last : mark.start()], mark.end()
        name = mark[1]
        if name == "im_start":
            head = formatted.index("\n", last)
            role, texts, found, last, inside = unescape_role(formatted[last:head]), [], [], head + 1, False
            continue
        if not inside:
            texts.append(between)
        if name == "im_end":
            yield role, unescape("".join(texts)), found
        elif name == "/document":
            inside = False
        else:
            found.append(name)
            inside = name == "document" and _holds_parts(formatted, last)


def _holds_parts(formatted: str, at: int) -> bool:
    """Whether a document's end comes before the next document or the turn's end."""
    return next((m[1] == "/document" for m in _MARK.finditer(formatted, at) if m[1] in ("/document", "document", "im_end")), False)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long, tokens long"


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list | None = None
    out: list[list] = []

    def closed() -> list:
        conv, turns, whole, learned, loss, chars, *counts = state
        return [conv, turns, whole.hexdigest(), learned, loss.hexdigest(), chars, *counts]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _READ.split(", ")])

    for batch in stream:
        for r in batch.to_pylist():
            if state is None or state[0] != r["conv_id"]:
                out += [closed()] if state else []
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0]
            for role, text, _ in turns_of(r["formatted"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in r["loss"]:
                text = unescape(r["formatted"][span["start"] - r["start"] : span["end"] - r["start"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += r["n_chars"]
            state[6] += len(r["attachments"])
            state[7] += sum(a["tokens"] for a in r["attachments"])
            state[8] += r["tokens"]
        if out:
            yield batch_of(out)
            out = []
    if state:
        yield batch_of([closed()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of `conversations`: its turns, and the text under its loss mask, as digests.

    A digest runs over a conversation from its first character to its last, so one task streams through each; it holds a row at a time.
    """
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digests, _READ)
