"""Each stage of the pipeline against a brute-force version of its decisions."""

import random

import numpy as np

import corpus_pipeline
from spendlens.llm import neardup, packing, suffix


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, sf_dir))
        seen[name][1].write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (seen[name][0].collect(), docs.collect(), docs.columns)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(c == columns for name, (_, _, c) in seen.items() if name != "packing")

    before, after, _ = seen["language_id"]
    kept = {r.doc_id for r in after}
    assert kept == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    known = [(r.lang, next(a.lang for a in after if a.doc_id == r.doc_id)) for r in before if r.doc_id in kept and r.lang]
    assert np.mean([a == b for a, b in known]) > 0.95

    before, after, _ = seen["near_dedup"]
    groups = neardup.brute_force([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)

    before, after, _ = seen["substring_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    expected = {r.doc_id: b for r, b in zip(before, suffix.brute_force([(r.text or "").encode() for r in before], corpus_pipeline.PASSAGE, True))}
    for r in after:
        n_bytes, removed, _, _ = expected[r.doc_id]
        assert n_bytes - removed - len(r.text.encode()) in range(7)  # a cut character goes as a whole

    before, after, _ = seen["mixing"]
    tokens = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 0 < tokens(after) <= tokens(before)
    by = {r.doc_id: r.text for r in before}
    assert all(by[r.doc_id].startswith(r.text) for r in after)

    before, after, _ = seen["packing"]
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in after}) == len(after)
    n = packing.check_packing([(r.sequence_id, r.offset, r.length) for r in after])
    assert n <= 1.02 * packing.lower_bound([r.length for r in after]) + 1


def test_near_dedup_keeps_one_row_of_each_group(spark, sf_dir):
    text = lambda k, n=60: " ".join(f"word{k}x{i}" for i in range(n))
    rows = [
        (1, text("a")), (1, text("a")), (1, text("a", 58)), (7, text("a", 59)),  # repeated rows, near texts of one id, another id
        (5, text("b")), (5, text("c")),  # two groups of one id
        (None, text("d")), (None, text("d")), (None, text("d", 58)), (None, text("e")), (None, text("f")), (9, text("f")),
        (3, ""), (3, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    groups = {}
    for k, (n, component) in neardup.brute_force([(k, t) for k, (_, t) in enumerate(rows)]).items():
        groups.setdefault(component, []).append(rows[k])
    assert len(groups) == 9 and len(after) == 9
    least = lambda x: (x[0] is None, x[0] or 0)
    for group in groups.values():
        of = [x for x in after if x in group]
        assert of and all(least(x) == min(map(least, group)) for x in of)
        assert len(of) == 1 or not group[0][1]


def test_stages_on_awkward_rows(spark, sf_dir, tmp_path):
    """Null ids and texts, repeated rows, a very long text, copies of a passage, and columns named like helper columns."""
    rng = random.Random(4)
    words = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(4).collect()]
    prose = lambda n: " ".join(rng.choice(rng.choice(words)) for _ in range(n))
    passage, twice = prose(60), prose(200)
    rows = [(1, f"{prose(80)} {passage} {prose(80)}"), (2, f"{prose(80)} {passage} {prose(80)}"), (3, f"{passage} {prose(90)}"), (4, prose(20_000)), (5, twice), (5, twice), (None, prose(150)), (None, None), (6, ""), (None, twice), (7, "12 34 !")]
    names = ["__id", "__hash", "__turn", "__spans", "component", "kept", "score", "sid", "row_hash", "anchor", "place", "piece", "epochs", "tokens", "domain"]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "src1", len(t or ""), *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        if name == "language_id":
            assert docs.count() == 8
        elif name == "near_dedup":
            assert docs.count() == 6 and docs.where("doc_id = 5").count() == 1
        elif name == "substring_dedup":
            left = {r.doc_id: r.text for r in docs.collect()}
            assert docs.count() == 6 and passage in left[1] and all(passage not in left[i] for i in (2, 3)) and left[5] == twice
        elif name == "mixing":
            assert 0 < docs.count() <= 4 * before.count()
        else:
            packing.check_packing([(r.sequence_id, r.offset, r.length) for r in docs.collect()])


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
