"""Language identification of whole texts, with spans of mixed-language text.

Each word (run of letters) is scored under every learned language by its
letter trigrams and four-grams, word ends included, hashed into a table of
`BUCKETS` log-probabilities a language. The script of a word narrows the
candidates first: languages that hardly use that script in the labelled texts
can't have the word; a word in a script of no learned language speaks for
none. Viterbi then labels the words so that the sum of scores less
`PENALTY` for each switch is largest; runs of a label are the spans.

A text's language is the label with the most letters. `score` is that label's
share of the letters times the logistic of its mean lead per word over the
best other language. A text that is null or has no letter is `und`, score 0.

The model is fitted on a sample of labelled rows of about `SAMPLE` rows, dealt
by a hash of doc_id; its size does not grow with the input (BUCKETS x
languages). Rows without doc_id are predicted, not learned from. Ties between
languages go to the first by name. Repeated rows are predicted alike; columns
other than those named are ignored. No labelled row at all: every text is
`und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: Rows that the model is fitted on, about; the bound of the labelled sample.
SAMPLE = 20_000
BUCKETS = 1 << 16
PENALTY = 14.0
#: Of a language's letters, the least share that makes a script one of its own.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"

# Ranges of code points by script.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0x20000, 0x323AF, "Han"),
]
SCRIPT_NAMES = ["Other", *sorted({s for _, _, s in SCRIPTS})]

_PLANE = 0x20000
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    if not _TABLES:
        letter = np.fromiter((chr(i).isalpha() for i in range(_PLANE)), bool, _PLANE)
        lower = np.arange(_PLANE, dtype=np.uint32)
        for i in range(0x1E944):
            c = chr(i).lower()
            if len(c) == 1 and c != chr(i):
                lower[i] = ord(c)
        script = np.zeros(_PLANE, np.int64)
        for a, b, name in SCRIPTS:
            script[a : min(b + 1, _PLANE)] = SCRIPT_NAMES.index(name)
        _TABLES.extend([letter, lower, script])
    return tuple(_TABLES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with 0 for what isn't a letter, and the words' starts and ends."""
    letter, lower, _ = _tables()
    cp = code_points(text)
    low = np.minimum(cp, _PLANE - 1)
    inside = letter[low] | ((cp >= _PLANE) & (cp <= 0x323AF))
    clean = np.where(inside, np.where(cp < _PLANE, lower[low], cp), 0)
    edge = np.zeros(len(cp) + 2, np.int8)
    edge[1:-1] = inside
    step = np.diff(edge)
    return clean, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def gram_buckets(clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigram and of the four-gram that end at each place, and one place beyond the last."""
    c = np.zeros(len(clean) + 4, np.uint64)
    c[3:-1] = clean
    m = np.uint64(0x9E3779B97F4A7C15)
    two = (c[2:-1] * m + c[3:]) * m
    three = c[1:-2][: len(clean) + 1] * np.uint64(0xD6E8FEB86659FD93) + two[: len(clean) + 1]
    four = c[: len(clean) + 1] * np.uint64(0xA0761D6478BD642F) + three * np.uint64(0xE7037ED1A0B428DB)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return ((three ^ (three >> np.uint64(29))) * m >> shift).astype(np.int64), ((four ^ (four >> np.uint64(29))) * m >> shift).astype(np.int64)


def scripts_of(clean: np.ndarray, starts: np.ndarray) -> np.ndarray:
    first = clean[starts]
    return np.where(first < _PLANE, _tables()[2][np.minimum(first, _PLANE - 1)], SCRIPT_NAMES.index("Han"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n: grams of the labelled texts; buckets beyond BUCKETS count words by script."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            clean, starts, ends = words(text or "")
            if not len(starts):
                continue
            t = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            inside = np.zeros(len(clean) + 1, bool)
            inside[:-1] = clean > 0
            inside[ends] = True
            for b in gram_buckets(clean):
                t[:BUCKETS] += np.bincount(b[inside], minlength=BUCKETS)
            t[BUCKETS:] += np.bincount(scripts_of(clean, starts), minlength=len(SCRIPT_NAMES))
    for lang, t in total.items():
        some = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(t[some])], ["lang", "bucket", "n"])


def _two(lead: np.ndarray, penalty: float) -> np.ndarray:
    """Best path between two labels: whether each word has the second, which leads the first by `lead`.

    The second's lead over all words so far, cut to the penalty on either
    side, says where each label is reached from; in between a label stays.
    """
    d, lead_so_far = 0.0, []
    for x in lead.tolist():
        d = (penalty if d > penalty else -penalty if d < -penalty else d) + x
        lead_so_far.append(d)
    sums = np.array(lead_so_far)
    decided = np.where(sums > penalty, 1, np.where(sums < -penalty, 0, -1))
    decided[-1] = sums[-1] > 0
    # Each word takes the label of the next decided one.
    at = np.where(decided >= 0, np.arange(len(sums)), len(sums))
    return decided[np.minimum.accumulate(at[::-1])[::-1]] == 1


def _many(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best path between any number of labels."""
    value, values = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        bar = max(value) - penalty
        value = [(v if v > bar else bar) + r for v, r in zip(value, row)]
        values.append(value)
    sums = np.array(values)
    top = sums.argmax(axis=1).tolist()
    stays = (sums >= sums.max(axis=1, keepdims=True) - penalty).tolist()
    label = top[-1]
    labels = [label]
    for t in range(len(top) - 2, -1, -1):
        if not stays[t][label]:
            label = top[t]
        labels.append(label)
    return np.array(labels[::-1], np.int64)


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray, allowed: np.ndarray):
        """log_p: BUCKETS x languages; allowed: scripts x languages."""
        self.langs, self.log_p, self.allowed = langs, log_p, allowed

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words x languages, and the words' starts and ends in code points."""
        clean, starts, ends = words(text)
        n = len(starts)
        out = np.zeros((n, len(self.langs)), np.float32)
        if not n or not self.langs:
            return out, starts, ends
        # In pieces of whole words, so that a very long text needs no more memory than a piece.
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 18))))
            a, b = int(starts[at]), int(ends[to - 1])
            three, four = gram_buckets(clean[a:b])
            lead = self.log_p[three] + self.log_p[four]
            sums = np.zeros((len(lead) + 1, len(self.langs)), np.float64)
            np.cumsum(lead, axis=0, out=sums[1:])
            out[at:to] = sums[ends[at:to] - a + 1] - sums[starts[at:to] - a]
            at = to
        able = self.allowed[scripts_of(clean, starts)]
        none = ~able.any(axis=1)
        out[none] = 0
        out -= out.max(axis=1, keepdims=True)
        out[~able & ~none[:, None]] -= 100
        return out, starts, ends

    def path(self, scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The labels of the words on the best path.

        Short ways to it, all exact. Let no stretch of words gain more than one
        switch costs by another language than the text's best one. A path of k
        stretches pays for k - 1 switches, so it can only be better if none of
        its stretches has the best language; and such a path gains at most what the
        words' best other languages do. A language that gains on no stretch can be
        replaced by the best one wherever it stands, without another switch.
        """
        n, k = scores.shape
        best = int(np.argmax(scores.sum(axis=0, dtype=np.float64)))
        lead = scores - scores[:, [best]]
        gain = np.cumsum(lead, axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0)
        most = (gain - low).max(axis=0)
        if most.max() <= penalty and (k == 1 or np.delete(lead, best, axis=1).max(axis=1).sum(dtype=np.float64) <= penalty):
            return np.full(n, best)
        able = np.setdiff1d(np.flatnonzero(most > 0), [best])
        if len(able) == 1:
            return np.where(_two(lead[:, able[0]], penalty), able[0], best)
        kept = np.sort(np.append(able, best))
        return kept[_many(scores[:, kept], penalty)]

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language, score and spans (language, start, end in code points)."""
        scores, starts, ends = self.scores(text or "")
        if not len(starts) or not self.langs:
            return UNKNOWN, 0.0, []
        labels = self.path(scores)
        letters = np.bincount(labels, weights=ends - starts, minlength=len(self.langs))
        best = int(np.argmax(letters))
        if len(self.langs) > 1:
            own = scores[labels == best].sum(axis=0, dtype=np.float64)
            lead = (own[best] - np.delete(own, best).max()) / max(1, int((labels == best).sum()))
        else:
            lead = 30.0
        cut = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        spans = [(self.langs[labels[a]], int(starts[a]), int(ends[b - 1])) for a, b in zip(cut[:-1], cut[1:])]
        return self.langs[best], float(letters[best] / letters.sum() / (1 + math.exp(-min(lead, 30.0)))), spans


def held_out():
    """Whether a row is kept from the model, by its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    n = known.select("doc_id").count()
    deal = 1_000_000
    share = deal if n <= sample else max(1, deal * sample // n)
    rows = (
        known.where(F.pmod(F.xxhash64("doc_id"), F.lit(deal)) < share)
        .select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS x languages rows at most
    )
    langs = sorted(rows.lang.unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for i, lang in enumerate(langs):
        own = rows[rows.lang == lang]
        counts[own.bucket.to_numpy(), i] = own.n.to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    log_p = np.log((grams + 0.3) / (grams.sum(axis=0) + 0.3 * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, log_p.reshape(BUCKETS, len(langs)), allowed)


_SPANS = "array<struct<lang string, start long, end long>>"


def label(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep`, and lang_pred, score, spans: one row per row of `docs` (text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = keep.index("text") if "text" in keep else None  # a kept text isn't sent twice
    kept = docs.select(*keep) if own is not None else docs.select(*keep, F.col("text").alias("__text"))
    types = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            found = [predict(t) for t in batch.column(batch.num_columns - 1 if own is None else own).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([[dict(zip(("lang", "start", "end"), s)) for s in f[2]] for f in found], types)],
                [*keep, "lang_pred", "score", "spans"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]), "lang_pred string", "score double", f"spans {_SPANS}"])
    return kept.mapInArrow(run, schema)
