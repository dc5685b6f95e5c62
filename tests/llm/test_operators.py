"""The training-data operators against brute force on small tables with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import chunks, html, iblt, jpeg, langid, media, mixing, neardup, packing, queries, suffix, urls
from spendlens.llm.common import written

from .. import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus(seed=3):
    """Texts with copies, near copies, a shared passage, one very long text, and what is missing."""
    rng = random.Random(seed)
    base, passage = [words(rng, rng.randint(30, 200)) for _ in range(20)], words(rng, 120)
    texts = [*base, base[0], base[0], base[1] + " tail word", base[2].upper(), f"{base[3]}\n{passage}", f"{passage}\n{base[4]}", f"á{passage[1:]}", words(rng, 20_000), None, "", "   ", "one two", "one two"]
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", 1.0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, repeated rows, one id with two texts."""
    text = words(random.Random(5), 150)
    return spark.createDataFrame([(None, text, None, None, None, None, None), (7, text, "en", "a", 1, "", None), (7, text, "en", "a", 1, "", None), (7, "other " * 100, "en", "a", 1, "", None), (None, None, None, None, None, None, None)], DOCS)


def vocabulary():
    return queries.vocabulary()


# near duplicates


def test_near_groups(docs):
    expected = neardup.brute_force([(r[0], r[1]) for r in corpus()])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs).collect()}
    assert found == expected


def test_near_groups_of_the_given_documents(spark, sf_dir):
    """Every group of the given documents, as all pairs of plain sets give them."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    expected = neardup.brute_force([(r.doc_id, r.text) for r in given.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(given).collect()} == expected
    assert len({c for _, c in expected.values()}) < len(expected)


def test_near_groups_of_many_kinds(spark):
    rng = random.Random(9)
    base = words(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(60)] = f"new{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    found = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == neardup.brute_force(rows)


def test_near_groups_across_blocks(spark, monkeypatch):
    """No pivots and small blocks: the comparison of blocks alone finds every component."""
    monkeypatch.setattr(neardup, "PIVOTS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(10)
    rows = []
    for k in range(4):
        base = words(rng, 80).split()
        for i in range(30):
            w = list(base)
            for _ in range(i % 4):
                w[rng.randrange(80)] = f"new{rng.randrange(99)}"
            rows.append((100 * k + i, " ".join(w)))
    found = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == neardup.brute_force(rows)


def test_media_steps_of_a_short_text(monkeypatch):
    """A short text's file costs few steps of numpy: a window's code and value are read at once, orders and tables are made once."""
    steps = []
    for name in ("arange", "concatenate", "where", "cumsum"):
        monkeypatch.setattr(np, name, lambda *a, _f=getattr(np, name), **b: steps.append(1) or _f(*a, **b))
    texts = [bytes(random.Random(i).choices(range(32, 127), k=2200)) for i in range(3)]
    for text in texts:
        steps.clear()
        payload, n, _ = media.read(media.store(media.payload_of(text)))
        assert payload[:n] == text
    assert len(steps) <= 40
    for text in (b"", b"\xc3\xbf" * 5, b"a" * 576, bytes(range(32, 127)) * 400):
        media_of = media.store(media.payload_of(text))
        payload, n, image = media.read(media_of)
        assert (payload[:n], payload) == (text, media.payload_of(text)) and jpeg.encode(image) == media_of


def test_media_stacks_share_steps(monkeypatch):
    """Short texts of one image size share numpy's steps, and give what each gives alone."""
    steps = []
    for name in ("arange", "concatenate", "where", "cumsum", "packbits", "unpackbits", "frombuffer"):
        monkeypatch.setattr(np, name, lambda *a, _f=getattr(np, name), **b: steps.append(1) or _f(*a, **b))
    texts = [bytes(random.Random(i).choices(range(32, 127), k=2000 + i)) for i in range(60)] + [b"", b"\xc3\xbf" * 5, b"", b"a" * 60000]
    rows = dict(media._rows(texts))
    assert len(rows) == len(texts) and len(steps) < 4 * len(texts)
    for i, text in enumerate(texts):
        stored = media.store(media.payload_of(text))
        payload, n, image = media.read(stored)
        tensor = jpeg.rgb(image)
        assert rows[i] == (n, payload, stored, image.width, image.height, tensor.tobytes(), media.feature(tensor)) and payload[:n] == text


def test_stack_with_other_codes():
    """A stack's file whose scans leave places out, by codes with zeros before a value and ends of bands, is read by itself."""
    stored = media.store(media.payload_of(bytes(random.Random(1).choices(range(32, 127), k=700))))
    tried = 0
    for scan in range(1, 5):  # the first scans of AC
        at = [i for i in range(len(stored)) if stored[i : i + 2] == b"\xff\xda"][scan] + 12
        for place in range(at, at + 40, 8):
            other = stored[:place] + b"\xf5\xbe" + stored[place + 2 :]
            if stored[place - 1] == 255 or stored[place + 1] == 255:
                continue
            ((which, image),) = jpeg.decode_all([stored, other, stored])
            try:
                blocks, _ = plain_decoder(other)
            except (IndexError, KeyError, StopIteration, ValueError):
                continue
            tried += 1
            for c, good in zip(image.components, jpeg.decode(stored).components):
                assert which == [0, 1, 2] and (image.stacked(c)[::2] == good.blocks).all() and image.stacked(c)[1].tolist() == blocks[c.ident]
    assert tried > 4


def test_components_stop_at_stars(spark, monkeypatch):
    """Rounds end as soon as components are stars around their least nodes, and pairs are compared where bands meet: each further step costs the driver a plan and its tasks."""
    from spendlens.llm import components

    made = []
    monkeypatch.setattr(components, "written", lambda df, name: made.append(name) or written(df, name))
    star = spark.range(1, 50).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert {(r.node, r.component) for r in components.connected(star).collect()} == {(i, 0) for i in range(50)} and len(made) == 1
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 100 == 99, 0).otherwise(1)).alias("b"))
    assert {(r.node, r.component) for r in components.connected(chain).collect()} == {(i, i // 100 * 100) for i in range(200)}
    sketch = ", ".join(f"{i}L AS odd{i}" for i in range(8))
    member = spark.sql(f"SELECT 1L AS band, id AS sid, id AS score, id AS component, CAST(NULL AS long) AS main, IF(id = 2, 100L, 10L) AS n_shingles, {sketch} FROM range(5)")
    pairs = neardup._pivot_pairs(member)
    assert sorted(map(tuple, pairs.collect())) == [(0, 4), (1, 4), (3, 4)]  # node 2 is too large


def test_near_groups_tell_clashing_digests_apart(docs, monkeypatch):
    rows = neardup.sketches(docs).withColumn("sid", F.when(F.col("sid").isNotNull(), F.pmod("sid", F.lit(7))))
    apart = neardup._told_apart(rows).where("sid is not null")
    assert apart.select("sid").distinct().count() == apart.select("sid", "other").distinct().count() >= rows.where("sid is not null").select("sid").distinct().count()


def test_near_groups_awkward(awkward, none):
    found = neardup.near_groups(awkward).collect()
    assert len(found) == 5 and {r.component_id for r in found if r.doc_id == 7 and r.n_shingles > 100} == {7}
    assert neardup.near_groups(none).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    for share in (1.0, 0.9, 0.75):
        b = np.concatenate([a[: int(len(a) * share)], np.unique(rng.integers(0, 1 << 63, len(a) - int(len(a) * share)).astype(np.uint64))])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (neardup.odd_sketch(neardup.minhash(np.unique(v))) for v in (a, b))
        z = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert abs(neardup.estimate(np.array([z]))[0] - true) < 0.12


# substrings


@pytest.mark.parametrize("length", [400, 60])
def test_repeats(docs, length):
    expected = suffix.brute_force([(r[1] or "").encode() for r in corpus()], length)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(docs, length, min(100, length // 3)).collect()}
    assert [found[i] for i in range(len(expected))] == expected


@pytest.mark.parametrize("first", [False, True])
def test_repeats_of_split_anchors(spark, monkeypatch, first):
    """Anchors of many kinds are split by columns until they fit; here none fits before single columns."""
    monkeypatch.setattr(suffix, "TOGETHER", 1)
    rng = random.Random(12)
    middle = words(rng, 8)
    rows = [(i, f"{words(rng, 5)} {middle[i % 4 :]} {words(rng, 5)}") for i in range(12)] + [(20, "x" * 150), (21, f"{'x' * 90} {middle}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = suffix.brute_force([t.encode() for _, t in rows], 30, first)
    found = {r.doc_id: r.text.encode() for r in suffix.without_repeats(docs, 30, 24, first).collect()}
    assert [hashlib.sha256(found[i]).hexdigest() for i, _ in rows] == [e[3] for e in expected]
    assert any(e[1] for e in expected)


@pytest.mark.parametrize("length", [256, 60])
def test_repeats_but_the_first(docs, length):
    rows = [r for r in corpus() if r[1]]
    expected = suffix.brute_force([r[1].encode() for r in rows], length, True)
    found = {r.doc_id: r.text for r in suffix.without_repeats(docs, length, length // 4, True).collect()}
    for r, (n_bytes, removed, _, _) in zip(rows, expected):
        assert n_bytes - removed - len(found[r[0]].encode()) in range(7), r[0]


def test_rounds_go_through_files(tmp_path, monkeypatch):
    rng = random.Random(13)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in range(30)]
    monkeypatch.setattr(suffix, "BUFFER", 0)
    plain, filed = ([tuple(x.tolist() if hasattr(x, "tolist") else x for x in c) for c in suffix.columns(strings, [2] * 30, np.zeros(30, np.int64), f)] for f in (None, f"file://{tmp_path}"))
    assert plain == filed and not list(tmp_path.iterdir())


def test_repeats_awkward(awkward, none):
    found = suffix.remove_repeats(awkward).collect()
    assert sorted(r.n_bytes - r.n_removed for r in found) == [0, 0, 0, 0, 0]
    assert suffix.remove_repeats(none).count() == 0


def test_columns_are_the_collection_transform():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in range(30)]
    strings = [s + b"x" * (12 - len(s)) for s in strings]
    for column, order, common, symbols in suffix.columns(strings, [0] * 30, np.zeros(30, np.int64)):
        rest = [strings[i][column:] for i in order]
        assert rest == sorted(rest)
        assert symbols.tolist() == [strings[i][column - 1] + 1 if column else 0 for i in order]
        for j in range(1, 30):
            a, b = rest[j - 1], rest[j]
            assert common[j] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_without_repeats_keeps_rows_and_columns(docs):
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[28].text is None and all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)


# chunks


def by_chunks(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_chunks, r.n_removed, r.n_spans, r.text) for r in df.collect())


def expected_chunks(rows):
    found = chunks.brute_force([(r[0], r[1]) for r in rows])
    return sorted((r[0] is None, r[0] or 0, *f) for r, f in zip(rows, found))


def test_chunks(docs):
    assert by_chunks(chunks.dedup_chunks(docs)) == expected_chunks(corpus())
    assert any(r[4] for r in by_chunks(chunks.dedup_chunks(docs)))


def test_chunks_of_the_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert by_chunks(queries.QUERIES["op10_gear_chunk_dedup"](spark, sf_dir)) == expected_chunks(rows)


def test_chunks_resist_insertions():
    rng = random.Random(6)
    text = words(rng, 3000).encode()

    def parts(t):
        ends = chunks.chunk_ends(np.frombuffer(t, np.uint8))
        return [t[a:b] for a, b in zip([0, *ends], ends)]

    plain, shifted = parts(text), parts(b"just in" + text)
    assert b"".join(shifted) == b"just in" + text and shifted[-len(plain) + 10 :] == plain[10:]
    assert all(chunks.LEAST <= len(p) <= chunks.MOST for p in plain[:-1])
    assert len(set(map(len, parts(b"a" * 5000)[1:-1]))) == 1


def test_chunks_of_a_long_text_are_hashed_in_pieces(monkeypatch):
    data = np.frombuffer(words(random.Random(7), 2000).encode(), np.uint8)
    whole = chunks.chunk_ends(data)
    monkeypatch.setattr(chunks, "_PIECE", 100)
    assert chunks.chunk_ends(data) == whole and chunks.chunk_ends(data[:0]) == []


def test_chunks_awkward(spark, awkward, none):
    found = by_chunks(chunks.dedup_chunks(awkward))
    assert [r[4] for r in found if r[2] > 600] == [0, 0, found[-1][2]]  # rows of one id and text count as one; the null id comes last
    assert chunks.dedup_chunks(none).count() == 0
    clash = awkward.withColumn("d1", F.lit(1)).withColumn("first", F.lit("x")).withColumn("row_hash", F.lit(0.5)).withColumn("__of", F.lit(3))
    out = chunks.without_repeated_chunks(clash)
    assert out.columns == clash.columns and out.count() == 5 and {r.kept for r in out.collect()} == {r.kept for r in clash.collect()}


# packing


def test_packing(docs):
    rows = packing.pack_documents(docs, vocabulary()).collect()
    n = packing.check_packing([(r.sequence_id, r.offset, r.length) for r in rows])
    assert n <= packing.lower_bound([r.length for r in rows]) + 1
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, p in enumerate(sorted(by[doc_id], key=lambda r: r.piece)):
            assert (p.piece, p.start) == (k, at) and 0 < p.length <= 2048 and (k == 0 or p.length == 2048)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_in_several_groups(docs, awkward, none, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    rows = packing.pack_documents(docs.unionByName(awkward), vocabulary()).collect()
    packing.check_packing([(r.sequence_id, r.offset, r.length) for r in rows])
    assert sum(r.doc_id == 7 and r.piece == 0 for r in rows) == 4
    assert packing.pack_documents(none, vocabulary()).count() == 0


def test_local_search_only_improves():
    rng = random.Random(4)
    lengths = sorted((rng.choice([rng.randint(1, 300), rng.randint(700, 1100)]) for _ in range(400)), reverse=True)
    plain, packed = packing.best_fit(lengths, 2048), packing.pack(lengths, 2048)
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert sorted(i for b in packed for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in packed)
    assert squares(packed) >= squares(plain) and len(packed) <= len(plain)


def test_single_spaced_texts_encode_alike():
    encode = packing.encoder(vocabulary())
    rng = random.Random(8)
    texts = ["a <|endoftext|> b", "<|endoftext", "a b's don't x1 22,3 !?", "a  b\n\nc \t d ", "<|endoftext|> x", "ñandú über 漢字 😀", ""] + ["".join(rng.choice("ab 1.,'\n\té<|>") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert encode.encode(t) == np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# media


@pytest.mark.parametrize("text", [b"", b"x", b"y" * 576, b"z" * 577, "ñ漢字😀".encode() * 900, bytes(range(128)) * 50])
def test_media_round_trip(text):
    payload = media.payload_of(text)
    stored = media.store(payload)
    back, n, image = media.read(stored)
    assert (back, n) == (payload, len(text)) and stored[:2] == b"\xff\xd8" and b"\xff\xc2" in stored[:400]
    assert jpeg.rgb(image).shape == (image.height, image.width, 3)


def plain_decoder(data):
    """Pixels of a progressive file, bit by bit, block by block and sample by sample."""
    import math

    at, tables, comps, size = 2, {}, {}, None
    while data[at + 1] != 0xD9:
        marker, n = data[at + 1], data[at + 2] * 256 + data[at + 3]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC4:
            k = 0
            while k < len(body):
                code, places = 0, {}
                many = list(body[k + 1 : k + 17])
                values = iter(body[k + 17 : k + 17 + sum(many)])
                for bits, m in enumerate(many, 1):
                    for _ in range(m):
                        places[bits, code] = next(values)
                        code += 1
                    code *= 2
                tables[body[k] >> 4, body[k] & 15] = places
                k += 17 + sum(many)
        elif marker == 0xC2:
            size = body[3] * 256 + body[4], body[1] * 256 + body[2]
            for i in range(body[5]):
                comps[body[6 + 3 * i]] = (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, {})
        elif marker == 0xDA:
            end = at
            while data[end] != 0xFF or data[end + 1] == 0:
                end += 1
            stream = "".join(f"{b:08b}" for b in data[at:end].replace(b"\xff\x00", b"\xff"))
            at, p = end, 0
            who = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            start, stop, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            wide, tall = size[0] // 16, size[1] // 16

            def take(m):
                nonlocal p
                p += m
                return int(stream[p - m : p], 2) if m else 0

            def symbol(table):
                code, bits = 0, 0
                while (bits, code) not in table:
                    code, bits = 2 * code + take(1), bits + 1
                return table[bits, code]

            def signed(m):
                v = take(m)
                return v if m == 0 or v >> (m - 1) else v - (1 << m) + 1

            if start == 0:
                before = dict.fromkeys(comps, 0)
                for my in range(tall):
                    for mx in range(wide):
                        for c, t in who:
                            h, v, blocks = comps[c]
                            for y in range(v):
                                for x in range(h):
                                    b = blocks.setdefault((my * v + y, mx * h + x), [0] * 64)
                                    if high:
                                        b[0] |= take(1) << low
                                    else:
                                        before[c] += signed(symbol(tables[0, t >> 4]))
                                        b[0] = before[c] << low
            else:
                c, t = who[0]
                h, v, blocks = comps[c]
                run = 0
                for y in range(tall * v):
                    for x in range(wide * h):
                        b, k = blocks[y, x], start
                        while k <= stop and not run:
                            rs = symbol(tables[1, t & 15])
                            if rs & 15 == 0 and rs >> 4 < 15:
                                run = (1 << (rs >> 4)) + take(rs >> 4)
                                break
                            assert not high
                            k += rs >> 4
                            b[k] = signed(rs & 15) << low
                            k += 1
                        if run:
                            run -= 1
                            for k in range(k, stop + 1):
                                if b[k] and high:
                                    b[k] += take(1) << low if b[k] > 0 else -(take(1) << low)
    cosine = [[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    zigzag = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    planes = {}
    for c, (h, v, blocks) in comps.items():
        planes[c] = {
            (8 * by + y, 8 * bx + x): min(255, max(0, 128 + sum(q * cosine[r][y] * cosine[s][x] for (r, s), q in zip(zigzag, b) if q)))
            for (by, bx), b in blocks.items() for y in range(8) for x in range(8)
        }
    out = np.zeros((size[1], size[0], 3))
    for y in range(size[1]):
        for x in range(size[0]):
            a, cb, cr = planes[1][y, x], planes[2][y // 2, x // 2] - 128, planes[3][y // 2, x // 2] - 128
            out[y, x] = a + 1.402 * cr, a - 0.344136 * cb - 0.714136 * cr, a + 1.772 * cb
    return {c: [blocks[k] for k in sorted(blocks)] for c, (_, _, blocks) in comps.items()}, np.clip(out, 0, 255)


@pytest.mark.parametrize("text", [b"", "plain words, ñandú and 漢字 ".encode() * 25])
def test_media_against_a_plain_decoder(text):
    """Coefficients, payload, tensor and feature from the stored bytes, by a decoder of its own."""
    stored = media.store(media.payload_of(text))
    blocks, pixels = plain_decoder(stored)
    image = jpeg.decode(stored)
    assert [c.blocks.tolist() for c in image.components] == [blocks[c.ident] for c in image.components]
    data = bytes(v - 256 for c in (1, 2, 3) for b in blocks[c] for v in b)
    assert data.rstrip(b"\xff") == text and media.read(stored)[0] == media.payload_of(text)
    tensor = jpeg.rgb(image)
    assert np.abs(tensor.astype(float) - pixels).max() <= 0.51
    parts = media.feature(tensor).partition(":")[2].split(",")
    for i, part in enumerate(parts):
        mean, deviation, step = map(float, part.split("/"))
        channel = tensor[:, :, i].astype(float)
        assert (mean, deviation, step) == pytest.approx((channel.mean(), channel.std(), np.abs(np.diff(channel, axis=1)).sum() / channel.size), abs=0.002)


def test_media_columns(docs, none):
    rows = media.media_columns(docs, "doc_id", "kept").collect()
    by = {r.doc_id: r for r in rows}
    for doc_id, text, *_ in corpus():
        data = (text or "").encode()
        assert (by[doc_id].n_bytes, by[doc_id].payload[: len(data)]) == (len(data), data)
        assert len(by[doc_id].payload) % 576 == 0 and len(by[doc_id].rgb) == 3 * by[doc_id].width * by[doc_id].height
    assert by[0].media == by[20].media and by[0].feature == by[20].feature
    assert media.media_columns(none, "doc_id").count() == 0


# fingerprints


def test_fingerprints(docs):
    rows = sorted(iblt.fingerprints(docs.select("doc_id", "text")).collect(), key=lambda r: -r.doc_id)
    texts = [t or "" for _, t, *_ in sorted(corpus(), key=lambda r: -r[0])]
    keys = lambda t: {x.strip(" ") for x in t.split("\n")} - {""}
    like = lambda a, b: len(keys(a) & keys(b)) / len(keys(a) | keys(b)) if keys(a) | keys(b) else 1.0
    for i, r in enumerate(rows):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r.n_chars, r.edited) == (len(own), edited)
        assert r.near_next == pytest.approx(like(own, after)) and r.near_edited == pytest.approx(like(own, edited))


def test_sketch_peels_and_retries(spark):
    rows = [(0, "\n".join(f"p{i}" for i in range(300))), (1, "\n".join(f"p{i}" for i in range(40, 330)))]
    found = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert found[1].near_next == pytest.approx(260 / 330)


def test_next_rows_with_far_and_missing_ids(spark, monkeypatch):
    """Ranges follow the rows, not the ids: a far id, null ids and repeated ids, over many small ranges."""
    monkeypatch.setattr(iblt, "LEAST_RANGE", 8)
    rows = [(i, f"text {i}") for i in range(300)] + [(10**12, "far"), (-5, "low"), (7, "again"), (7, "again")] + [(None, f"none {i % 40}") for i in range(50)]
    found = iblt.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    hashed = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    expected = sorted((str(a), b[1]) for a, b in zip(order, [*order[1:], order[0]]))
    assert sorted((str((r.doc_id, r.text)), r.next_text) for r in found.collect()) == expected


def test_fingerprints_awkward(awkward, none):
    assert iblt.fingerprints(awkward).count() == 5
    assert iblt.fingerprints(none).count() == 0


# html


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class=cookie-notice>We use cookies on this site and you can accept all of them.</div>
<article><h1>A head&amp;line</h1><p>The first   paragraph of the story, which is long enough to be read &lt;here&gt; and has the words of a text.</p><p>Short.</p><script>var x = "<p>no</p>"</script></article>
<section class="comments"><p>What a story, and I have read it all with my own eyes, said a reader.</p></section><footer>Copyright</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A head&line\n\nThe first paragraph of the story, which is long enough to be read <here> and has the words of a text.\n\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


PROSE = "It was the best of times for all of us, and what he said to me in the end is not what they had in the book about it. "


def test_article_is_evidence_only():
    links = "".join(f"<li><a href=/{i}>Another story about a thing {i}</a> today</li>" for i in range(9))
    page = f"<article><p>Read more here.</p></article><div>{PROSE * 3}</div><article><p>{PROSE}</p><div>{'<a href=/x>More of it here</a> now. ' * 5}</div>{links}</article>"
    assert html.main_text(page) == f"{(PROSE * 3).strip()}\n\n{PROSE.strip()}"
    found = html.blocks(f"<article><p>{PROSE}</p><p>{'Lorem ipsum dolor ' * 9}</p><p>Short.</p></article>")
    assert html.first_pass(found) == [html.GOOD, html.NEAR, html.SHORT_BLOCK]
    for text in ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. " * 3, "Minä olen täällä ja sinä olet siellä " * 9):
        assert html.main_text(f"<nav>x</nav><div>{text}</div>") == text.strip()


@pytest.mark.parametrize("opening, closing", [
    ("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='page no-sidebar'><article>", "</article></div>"), ("<main class='has-sidebar'>", "</main>"),
    ("<article class='post has-comments'>", "</article>"), ("<article><button>Menu", "</article>"), ("<select><option>One<div>", "</div>"),
    ("<button>A<div><button>B</button></div><div>", "</div><div><button>C</button></div>"), ("<article><svg><path/>", "</article>"),
])
def test_wrappers_keep_their_text(opening, closing):
    text = (PROSE * 3).strip()
    comments = f"<section class=comments><article class=comment><p>{PROSE}</p></article></section>"
    assert html.main_text(f"<nav>x</nav>{opening}<p>{text}</p>{closing}<div class='ad'>Buy this and that, it is for you.</div>{comments}") == text
    menu = "<li><a href=/a>A page of this site with a name</a></li>" * 30
    assert html.main_text(f"<div class=sidebar><ul>{menu}</ul></div>{opening}<p>{text}</p>{closing}") == text


def test_rules_find_the_text_without_a_mark(sf_dir):
    """The given pages with <article> and <main> made <div>: at least nine in ten blocks come back, and nothing that was left out before."""
    import re
    from collections import Counter

    import pyarrow.parquet as pq

    wanted, kept = 0, 0
    for page in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist():
        marked = Counter(html.main_text(page).split("\n\n"))
        bare = Counter(html.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)).split("\n\n"))
        assert not bare - marked - Counter([""])
        wanted += marked.total()
        kept += (bare & marked).total()
    assert kept >= 0.9 * wanted


def test_rules_decide_inside_an_article():
    """Notices of no stop words that are partly links, and copyright lines, go from an article too; their short neighbours go with them."""
    notice = "Rights reserved worldwide, <a href=/t>terms and conditions</a> publisher policies strictly applying throughout."
    page = f"<article><p>{PROSE * 2}</p><p>Short one.</p><p>{notice}</p><p>Tags: cats</p><p>\u00a9 2024 Example</p></article>"
    assert html.main_text(page) == (PROSE * 2).strip()
    assert html.main_text(f"<div><h1>Title</h1><p>{PROSE * 2}</p><p>Short end.</p></div><footer>x</footer>") == f"Title\n\n{(PROSE * 2).strip()}\n\nShort end."


def test_ambiguous_blocks_take_the_nearest_label():
    good, bad, near, short = html.GOOD, html.BAD, html.NEAR, html.SHORT_BLOCK
    assert html.second_pass([good, short, short, bad]) == [good, good, bad, bad]
    assert html.second_pass([good, short, bad]) == [good, bad, bad] and html.second_pass([bad, near, good]) == [bad, good, good]
    assert html.second_pass([short, near]) == [bad, good] and html.second_pass([]) == []


def test_main_texts_awkward(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", PAGE * 200)], "page_id long, url string, html string")
    assert html.main_texts(pages, "page_id", "url").count() == 3
    assert html.main_texts(pages.limit(0), "page_id").count() == 0


# packing over several groups


def test_underfull_bins_are_packed_again(spark, monkeypatch):
    """Groups of few pieces: their leftovers meet until one group is left, every piece once, bins of all turns apart."""
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5), 0, 1, rng.randint(20, 900)) for i in range(400)]
    placed = packing._placed(spark.createDataFrame(rows, "doc_id long, row_hash long, piece int, copy int, length long"), len(rows), 1000).collect()
    assert sorted((r.doc_id, r.row_hash, r.length) for r in placed) == sorted((r[0], r[1], r[4]) for r in rows)
    n = packing.check_packing([(r.bin, r.offset, r.length) for r in placed], 1000)
    apart = sum(len(packing.pack([r[4] for r in rows[k::10]], 1000)) for k in range(10))
    assert packing.lower_bound([r[4] for r in rows], 1000) <= n < apart
    halves = spark.createDataFrame([(i, 0, 0, 1, 600) for i in range(100)], "doc_id long, row_hash long, piece int, copy int, length long")
    assert len({r.bin for r in packing._placed(halves, 100, 1000).collect()}) == 100  # a turn that saves nothing is the last


def test_ids_are_those_of_the_tokenizer(sf_dir):
    """The faster ids against `tokenizers` on the given texts and on made ones of odd white space, marks and digits."""
    import pyarrow.parquet as pq

    fast = packing.encoder(vocabulary())
    rng = random.Random(3)
    odd = ["".join(rng.choice([" ", "  ", "\n", "\t", "\u00a0", "\u2003", "a", "B", "é", "e\u0301", "日", "٣", "7", "42", "'s", "'", "!", "...", "\U0001f600", "\x00", "_"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for text in odd + [t for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() if t]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == fast.tokenizer.encode(text, add_special_tokens=False).ids


# languages


def test_path_is_the_best_of_all_paths():
    """Model.path against the best of all paths, for texts of three and four languages with long stretches, noise, ties and hopeless languages."""
    rng = np.random.default_rng(7)
    model, penalty = langid.Model([], np.zeros((0, 0)), np.zeros((0, 0))), 14.0
    for case in range(1000):
        k, n = 3 + case % 2, int(rng.integers(1, 40))
        s = rng.normal(0, 8 if case % 3 else 3, (n, k))
        for a in range(0, n, 10):
            s[a : a + 10, rng.integers(k)] += rng.choice([0, 1, 2, 4])
        if case % 5 == 0:
            s[:, 0] = s.max(axis=1)  # nowhere worse
        if case % 7 == 0:
            s = np.round(s / 7) * 7  # ties
        s = s.astype(np.float32)
        value = s[0].astype(np.float64)
        for row in s[1:]:
            value = np.maximum(value, value.max() - penalty) + row
        labels = model.path(s, penalty)
        found = s[np.arange(n), labels].sum(dtype=np.float64) - penalty * (np.diff(labels) != 0).sum()
        assert found == pytest.approx(value.max(), abs=1e-3), case


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(100):
        n, k = int(rng.integers(1, 7)), int(rng.integers(2, 4))
        s = rng.normal(0, 6, (n, k))
        value = lambda x: s[np.arange(n), x].sum() - 7 * (np.diff(x) != 0).sum()  # noqa: B023, E731
        best = max(value(np.array(x)) for x in product(range(k), repeat=n))
        assert value(langid._many(s, 7.0)) == pytest.approx(best)
        if k == 2:
            assert value(langid._two(s[:, 1] - s[:, 0], 7.0).astype(int)) == pytest.approx(best)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.label(docs, langid.fit(docs), "doc_id", "lang").where(langid.held_out()).where("lang is not null").collect()
    right = [r.lang_pred == r.lang for r in rows if r.lang_pred != langid.UNKNOWN]
    assert len(right) > 20 and np.mean(right) > 0.95


def test_mixed_text_has_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    one = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 800)).first().text[:800] for lang in ("en", "de")}
    found = model.predict(one["en"] + "\n" + one["de"])[2]
    assert [s[0] for s in found][0] == "en" and [s[0] for s in found][-1] == "de"


def test_languages_awkward(awkward, none):
    model = langid.fit(none)
    assert {(r.lang_pred, r.score) for r in langid.label(awkward, model, "doc_id", "kept").collect()} == {("und", 0.0)}
    assert langid.fit(awkward).predict("... 12 !")[:2] == ("und", 0.0)
    assert langid.label(none, model, "doc_id").count() == 0


# mixing and URL lists


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE[name])


WEIGHTS = {"domain": ({"a": 1}, 1), "language": ({"en": 3}, 1), "source": ({}, 1)}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s", 10), ("a", "de", "s", 1000), ("b", "en", "s", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, language string, source string, tokens long")
    got = {(r.domain, r.language): r.quota for r in mixing.quotas(leaves, 800, 1, WEIGHTS).collect()}
    assert got == {("a", "en"): 10, ("a", "de"): 390, ("b", "en"): 400}


def test_mixing_awkward(awkward, none):
    domain = F.lit("a")
    out = mixing.mixed_documents(awkward, domain, WEIGHTS, 1.0, 2, 7)
    assert out.columns == awkward.columns and out.where("text is null").count() == 0
    assert mixing.mix(none, domain, WEIGHTS, 1.0, 2, 7).count() == 0


def test_first_words(spark):
    texts = ["  a b\n\nc  d ", "one", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.first_words(F.col("t"), F.lit(2)))
    assert [r[0] for r in df.collect()] == ["  a b", "one", "a b"]


def test_url_intervals(spark):
    at = lambda d: f"timestamp_ntz'2024-{d}'"
    entries = spark.sql(f"select * from values ('l','x.com','add',{at('01-01')}),('l','x.com','add',{at('01-05')}),('l','x.com','remove',{at('02-01')}),('l','x.com','remove',{at('03-01')}),('l','x.com','add',{at('03-01')}),(null,'x.com','add',{at('01-01')}) as e(list,key,action,at)")
    assert urls.intervals(entries).count() == 1
    captures = spark.sql(f"select * from values (1,'http://a.x.com:80/p',{at('01-31')}),(2,'http://X.com.',{at('02-01')}),(3,null,null),(4,'http://notx.com/',{at('01-10')}),(1,'http://a.x.com:80/p',{at('01-31')}) as c(page_id,url,fetched_at)")
    assert sorted((r.page_id, r.allowed) for r in urls.evaluate(captures, entries).collect()) == [(1, False), (1, False), (2, True), (3, True), (4, True)]
    assert urls.evaluate(captures.limit(0), entries).count() == 0
