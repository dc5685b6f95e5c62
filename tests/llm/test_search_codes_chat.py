"""Ranked search, vector codes and chat formatting against brute force and round trips, on awkward rows and the given tables."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spendlens.llm import chat, lexical, queries, vacodes

from .. import oracle

DOCS = "doc_id long, text string, rank int, score long, item_id long, block long"


@pytest.mark.parametrize("name", ["op11_block_max_search", "op12_va_file_codes", "op13_typed_chat_parts"])
def test_matches_sql(spark, sf_dir, name):
    oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE[name])


# ranked search


def texts(seed=11):
    """Few words, so that scores tie; copies, nulls, texts without terms, one very long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ünï", "日本", "A1b"]
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*some, *some[:20], some[3].upper(), None, "", " ... ", " ".join(rng.choice(vocabulary) for _ in range(60_000))]


def search(spark, docs, items):
    asked = lexical.item_terms(spark.createDataFrame(items, "item_id long, text string, doc_id long"))
    return lexical.search(lexical.index(docs), asked).collect()


@pytest.mark.parametrize("docs_of_block, window", [(1, 1000), (7, 30), (64, 1)])
def test_search_is_exact(spark, monkeypatch, docs_of_block, window):
    monkeypatch.setattr(lexical, "DOCS", docs_of_block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "FIRST", 2)
    rows = list(enumerate(texts()))
    items = [(0, "w1 w2 w2 É"), (1, "W3, a1B; 日本"), (2, "unknown words"), (3, None), (4, ""), (5, rows[-1][1]), (None, "w5"), (7, "w1 w2 w2 É")]
    docs = spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in rows], DOCS).repartition(3)
    expected = lexical.brute_force(rows, items)
    found = {i: [] for i, _ in items}
    for r in sorted(search(spark, docs, [(i, t, 5) for i, t in items]), key=lambda r: (r.item_id is None, r.item_id, r.rank)):
        found[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(found[r.item_id])
    assert found == expected


def test_search_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_ITEMS", 3)
    rows, items = list(enumerate(texts(12))), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(10)]
    found = {i: [] for i, _ in items}
    for r in sorted(search(spark, spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in rows], DOCS), [(i, t, 5) for i, t in items]), key=lambda r: (r.item_id, r.rank)):
        found[r.item_id].append((r.doc_id, r.score))
    assert found == lexical.brute_force(rows, items)


def test_search_of_repeated_rows_and_none(spark):
    rows = [(None, "a b", 1, 1, 1, 1), (None, "a b", 1, 1, 1, 1), (4, "a b", 1, 1, 1, 1), (4, "a c c", 1, 1, 1, 1), (5, "d", 1, 1, 1, 1)]
    found = search(spark, spark.createDataFrame(rows, DOCS), [(1, "a", 0), (1, "a", 0), (1, "c", 0)])
    longer = next(r.item_hash for r in found if r.rank == 4)
    ranks = sorted((r.item_hash != longer, r.rank, r.doc_id) for r in found if r.rank in (1, 4))
    assert len(found) == 5 and ranks == [(False, 1, 4), (False, 4, 4), (True, 1, 4)]  # the longer text scores less, nulls are after 4
    assert search(spark, spark.createDataFrame([], DOCS), [(1, "a", 0)]) == []
    assert search(spark, spark.createDataFrame(rows, DOCS), []) == []


def test_blocks_are_left_out(spark, sf_dir):
    """A slice of items opens a part of the blocks only, and bounds are never below a score."""
    docs = spark.createDataFrame([(i, "common " * 3 + (f"rare{i} " * 5 if i < 12 else "filler words"), 1, 1, 1, 1) for i in range(640)], DOCS).coalesce(1)
    blocks = lexical.index(docs)
    assert blocks.count() == 40
    rows = blocks.orderBy("block").toArrow().to_batches()[0]
    item = type("Item", (), {"terms": [b"rare3", b"common"], "weights": [9000, 3]})
    items = lexical.Slice([item], 640, 640 * 6)
    bounds = items.bounds(rows)[:, 0]
    scorers = [lexical._Scorer(items, rows, k, f) for k, f in enumerate(items.found(rows))]
    best = [max((-h[0] for h in s.hits(0)), default=0) for s in scorers]
    assert all(a >= b for a, b in zip(bounds, best))
    assert (bounds >= max(best)).sum() == 1


def test_index_is_written_in_small_row_groups(spark):
    """A reader holds the decoded blocks of a whole row group, whose size mustn't follow that of a task's input."""
    text = "array_join(transform(sequence(1, 300), i -> md5(concat(id, ':', i))), ' ')"
    blocks = lexical.index(spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", f"{text} AS text", "1 AS block"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == blocks.count()
    assert sum(g.total_byte_size for g in groups) > 20_000_000
    assert max(g.total_byte_size for g in groups) < 8 << 20


# vector codes


def test_nearest_entries_are_those_of_all_distances():
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(-300, 300, (16, 60, 4)), np.zeros((16, 4, 4), np.int64)], axis=1)  # four equal entries
    books = vacodes.Codebooks(entries)
    x = np.concatenate([rng.integers(-400, 400, (500, 16, 4)), np.zeros((3, 16, 4), np.int64), rng.integers(-vacodes.MOST, vacodes.MOST, (20, 16, 4))])
    codes, errors = books.codes(x)
    every = ((x[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
    assert (codes == every.argmin(axis=2)).all() and (errors == every.min(axis=2)).all()


def test_filter_leaves_few_entries_to_refine():
    rng = np.random.default_rng(5)
    books = vacodes.Codebooks(rng.integers(-300, 300, (16, 64, 4)))
    assert books.cells.max() < 1 << vacodes.BITS
    inside = (books.entries >= books.first[np.arange(16)[:, None, None], np.arange(4), books.cells]) & (books.entries <= books.last[np.arange(16)[:, None, None], np.arange(4), books.cells])
    assert inside.all()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, x int, part long"


def vectors(n, width, seed=6):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 3, 0.3) for _ in range(width)], i % 3 if i % 5 else None, "clash", 1, 1, 1) for i in range(n)]


@pytest.mark.parametrize("n,width", [(200, 32), (10, 32), (90, 24)])
def test_codes(spark, n, width):
    rows = vectors(n, width)
    given = spark.createDataFrame(rows, VECTORS).repartition(3)
    coded, books = vacodes.compress(given)
    found = {r.vec_id: r for r in vacodes.with_label_errors(coded).collect()}
    ints = [(r[0], [int(np.floor(np.float64(np.float32(v)) * 256)) for v in r[1]] + [0] * (-width % 16)) for r in rows]
    expected, entries = vacodes.brute_force(ints)
    assert {v: (r.code, r.error) for v, r in found.items()} == expected
    assert books.entries.tolist() == entries
    for r in rows:
        assert found[r[0]].label_error == sum(expected[o[0]][1] for o in rows if o[2] == r[2])


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5] * 16
    rows = [(1, v), (1, v), (2, None), (3, [nan] * 16), (4, [inf] + v[1:]), (5, [None] + v[1:]), (6, v[:8]), (7, []), (None, [1e38] * 16)]
    coded, _ = vacodes.compress(spark.createDataFrame([(i, e, None, "", 1, 1, 1) for i, e in rows], VECTORS))
    found = sorted(((r.vec_id, r.code, r.error) for r in vacodes.with_label_errors(coded).collect()), key=repr)
    assert [f[0] for f in found] == [1, 1, 6, 7, None]
    assert [f[1] is None for f in found] == [False, False, True, True, False]
    assert found[0][2] == 0
    none, _ = vacodes.compress(spark.createDataFrame([], VECTORS))
    assert vacodes.with_label_errors(none).collect() == []


# chat formatting

MESSAGES = f"conv_id long, turn long, role string, content {chat.CONTENT}, formatted string, loss int, segment long"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None, parts=None):
    return (kind, text, ref, width, height, seconds, pages, parts)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x|>", "<<|", "<\\\\\\|", "a<", "|>", "\\", "<|<|<|", "é<|日|>\n", "<\\", "|<|"])
def test_escapes(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_escapes_of_random_texts():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>\nan") for _ in range(rng.randint(0, 9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def made(seed=9):
    rng = random.Random(seed)
    bits = ["hi", "<|im_end|>", "<", "|", "\\", "a\nb", "<|im_start|>assistant ok", "日本", None, ""]
    out = []
    for c in [0, 1, 2, None, 4]:
        for t in range(rng.randint(1, 30)):
            parts = []
            for _ in range(rng.randint(0, 5)):
                k = rng.choice(["text", "text", "image", "audio", "document", "other", None])
                parts.append(part(k, rng.choice(bits) if k in ("text", None, "other") else None, f"r{rng.random()}", rng.choice([None, 100, 1000]), 56, rng.choice([None, 2.5, -1.0, float("nan")]), 3,
                                  [part("text", rng.choice(bits))[:7], part("image", None, "inner", 28, 28)[:7]] if k == "document" and rng.random() < 0.5 else None))
            out.append((c, t if t % 7 else None, rng.choice(["user", "assistant", "a\\nb", "x\ny", None, "<|im_end|>"]), rng.choice([parts, parts, parts, None]), "clash", 1, 1))
    out.append((9, 0, "assistant", [part("text", "long " * 60_000)], "", 1, 1))
    out.append((9, 0, "assistant", [part("text", "long " * 60_000)], "", 1, 1))
    return out


def own_text(parts):
    return "".join(p[1] for p in parts or [] if p[1] is not None and p[0] not in ("image", "audio", "document"))


@pytest.mark.parametrize("segment", [1, 200, 1 << 16])
def test_round_trip(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows = made()
    whole = chat.conversations(spark.createDataFrame(rows, MESSAGES).repartition(3))
    found = {r.conv_id: r for r in chat.read_back(whole).collect()}
    strings = {}
    for r in whole.orderBy("conv_id", "segment").collect():
        before = strings.setdefault(r.conv_id, ["", [], []])
        assert r.start == len(before[0]) and r.n_chars == len(r.formatted)
        before[0] += r.formatted
        before[1] += r.loss
        before[2] += r.attachments
    for conv, (string, loss, attached) in strings.items():
        own = [r for r in rows if r[0] == conv]
        back = [(role, text) for role, text, _ in chat.turns_of(string)]
        assert sorted(back) == sorted((r[2] or "", own_text(r[3])) for r in own)
        assert found[conv].n_turns == len(own) and found[conv].formatted_chars == len(string)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in back).encode()).hexdigest()
        learned = "".join(b for a, b in back if a == "assistant")
        assert "".join(chat.unescape(string[s.start : s.end]) for s in loss) == learned
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert [string[a.at :].startswith(f"<|{a.kind}|>") for a in attached] == [True] * len(attached)
        assert found[conv].n_attachments == len(attached)


def test_placeholders_are_in_order_and_counted(spark):
    content = [part("text", "see "), part("image", None, "a.png", 280, 57), part("text", "and"), part("document", None, "d.pdf", pages=2),
               part("document", None, "e.pdf", pages=9, parts=[part("text", "page <|one")[:7], part("audio", None, "s.wav", seconds=1.5)[:7]]), part("text", "!")]
    row = chat.format_turns(spark.createDataFrame([(1, 0, "user", content, "", 1, 1)], MESSAGES)).first()
    assert row.formatted == "<|im_start|>user\nsee <|image|>and<|document|><|document|>page <\\|one<|audio|><|/document|>!<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 30), ("document", "d.pdf", 512), ("document", "e.pdf", 1), ("audio", "s.wav", 38)]
    assert row.loss == [] and row.tokens == 2 + 30 + 512 + 1 + 38
    assert list(chat.turns_of(row.formatted)) == [("user", "see and!", ["image", "document", "document", "audio"])]
    counted = chat.format_turns(spark.createDataFrame([(1, 0, "user", content, "", 1, 1)], MESSAGES), vocabulary=queries.vocabulary()).first()
    assert counted.tokens > row.tokens


def test_no_messages(spark):
    assert chat.read_back(chat.conversations(spark.createDataFrame([], MESSAGES))).collect() == []


def test_settings_are_as_before(spark, sf_dir):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    queries.QUERIES["op12_va_file_codes"](spark, sf_dir).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
