"""PDF statements, ingest with observed counts, dotted paths and the table of suggestions, on small cases."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from spendlens import shared
from spendlens.functions import text
from spendlens.operators import offers, statements
from spendlens.operators.tables import MonthTable
from spendlens.sources import pdf

AS_OF = dt.date(2024, 4, 1)
LEDGER = "doc_id long, date date, description string, amount double, type string, category string, raw_text string"


# PDF


@pytest.mark.parametrize("given", ["one", "a (b) \\ c\nd é €", "\n".join(f"line {i}" for i in range(130))])
def test_made_files_come_back(given):
    assert [l.rstrip() for l in pdf.text_of(pdf.made_file(given)).split("\n")] == given.split("\n")


def test_damaged_files_have_no_text(spark):
    whole = pdf.made_file("05/03/2024 DISCO -1.234,50 9.000,00")
    cut = whole[: whole.index(b"stream") + 12]
    cases = [b"", None, b"no pdf at all", b"%PDF-1.4", whole.replace(b"stream\n", b"stream\n\x00\x01", 1), cut, b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 9 0 R >>\nendobj"]
    found = pdf.texts(spark.createDataFrame(list(enumerate(cases)), "doc_id long, body binary")).collect()
    assert [r.text for r in sorted(found, key=lambda r: r.doc_id)] == [None] * len(cases)


def test_text_operators():
    shown = b"BT 14 TL 1 0 0 1 10 700 Tm (a\\)\\050) Tj [(b) -250 (c)] TJ T* <64> Tj 0 -20 Td (e) Tj (f) ' ET BT 1 0 0 1 5 700 Tm (g) Tj ET"
    assert list(pdf.items_of(shown)) == [(700, "a)("), (700, "bc"), (686, "d"), (666, "e"), (652, "f"), (700, "g")]


def test_object_streams_and_page_order():
    inner = b"<< /Type /Pages /Kids [6 0 R 5 0 R] >>"
    packed = zlib.compress(b"2 0 " + inner)
    page = lambda n, c: b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (n, c)
    show = lambda n, t: b"%d 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n" % (n, len(t), t)
    data = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length " + b"%d >>\nstream\n" % len(packed) + packed + b"\nendstream endobj\n"
    data += page(5, 7) + page(6, 8) + show(7, b"BT 0 5 Td (last) Tj ET") + show(8, b"BT 0 5 Td (first) Tj ET")
    assert pdf.text_of(data) == "first \nlast "


# ingest


def parsed(spark, *texts):
    return statements.parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), AS_OF)


UPLOAD = "\n".join([
    "05/03/2024 NETFLIX -10,00 90,00", "06/03/2024 DISCO -20,00 70,00", "31/02/2024 SPOTIFY -5,00 65,00", "07/03/2024 SPOTIFY -6,00 59,00", "08/03/2024 NETFLIX -12,00 47,00",
    "08/03/2024 NETFLIX -13,00 34,00", "09/03/2024 NETFLIX 99,00 133,00",
])


def test_ingest_counts_and_appends(spark):
    table, folder = MonthTable.create(spark.createDataFrame([], LEDGER)), shared.new_path(spark, "subscriptions")
    for _ in range(2):  # the batch comes twice
        counts = statements.ingest(parsed(spark, UPLOAD, None, ""), table, folder, 7)
        assert counts == {"total": 7, "inserted": 6, "skipped": 1, "subscriptions": 2}
        assert table.rows().count() == 6
        found = spark.read.parquet(f"{folder}/batch=7").collect()
        # Of two charges on one day the first counts; a first charge on an impossible day stays.
        assert sorted((r.name, r.amount, str(r.last_charged)) for r in found) == [("Netflix", 12.0, "2024-03-08"), ("Spotify", 5.0, "None")]
    assert statements.ingest(parsed(spark, UPLOAD), table, folder, 8)["inserted"] == 6
    assert table.rows().count() == 12
    assert statements.ingest(parsed(spark, None), table, folder, 9) == {"total": 0, "inserted": 0, "skipped": 0, "subscriptions": 0}


def test_parsing_moves_no_rows(spark):
    plan = parsed(spark, UPLOAD)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_blocks_end_at_the_next_date(spark):
    lines = ["no date here", "05/03/2024 123456 COMPRA", "FIRST", "SHOP -", "-450,00 5.833,07", "a note", "06/03/2024 77 PAGO", "no amount", "07/03/2024 88 X", "-", "THIRD", "1.000,00 6.833,07", "08/03/2024 9 Y", "LAST", "-1,00 2,00"]
    found = parsed(spark, "\n".join(lines)).orderBy("line_no").collect()
    assert [(r.parser, r.line_no, r.description, r.amount, r.type) for r in found] == [(2, 1, "FIRST SHOP", 450.0, "debit"), (2, 8, "THIRD", 1000.0, "credit"), (2, 12, "LAST", 1.0, "debit")]
    assert found[0].raw_text == "FIRST SHOP - -450,00 5.833,07 a note"


# dotted paths


def test_resolve(spark):
    resources = '{"a": {"b": "hi {{x}} {{x}} {{y}}", "n": 5, "o": {}, "z": null}, "t": "top", "e": ""}'
    cases = {"a.b": "hi 1 1 {{y}}", "a.n": "a.n", "a.o": "a.o", "a.z": "a.z", "a": "a", "t": "top", "t.u": "t.u", "e": "", "": "", "q.r.s": "q.r.s"}
    rows = spark.createDataFrame([(resources, k, {"x": "1"}) for k in cases], "r string, path string, v map<string,string>")
    assert {r.path: r.t for r in rows.select("path", text.resolve(F.col("r"), F.col("path"), F.col("v")).alias("t")).collect()} == cases
    odd = spark.createDataFrame([(None, "a.b", None), ("not json", "a.b", None), (resources, "a.b", None), (resources, None, None)], "r string, path string, v map<string,string>")
    assert [r.t for r in odd.select(text.resolve(F.col("r"), F.col("path"), F.col("v")).alias("t")).collect()] == ["a.b", "a.b", "hi {{x}} {{x}} {{y}}", None]


# suggestions


def test_table_of_suggestions_equals_the_scan(spark):
    words = ["pan", "Pan rallado", "papá", "zapallo", "papa", "pan", "ñandú", "", "x" * 40]
    terms = spark.createDataFrame(list(enumerate(words)) + [(99, None)], "ordinal long, term string")
    none = spark.createDataFrame([], "term string, ordinal long")
    table = {}
    for r in offers.typeahead_table(terms, 3).collect():
        table.setdefault(r.key, []).append((r.place, r.term))
    for typed in ["p", "pa", "pan", "llo", "Á", "ñ", "zz", "rallado", "x" * 32]:
        key = spark.range(1).select(text.fold(F.lit(typed)).alias("k")).first().k
        scanned = [r.term for r in offers.typeahead(terms, none, typed, 3, 3).collect()]
        assert [t for _, t in sorted(table.get(key, []))] == scanned
    assert max(map(len, table)) == 32 and [t for _, t in sorted(table[""])] == ["pan", "Pan rallado", "papá"]


def test_an_upload_that_comes_twice_is_parsed_once(spark, sf_dir, monkeypatch):
    from spendlens.operators import statements
    from spendlens.plans import texts

    plans, ingest = [], statements.ingest
    monkeypatch.setattr(statements, "ingest", lambda parsed, *a: plans.append(parsed._jdf.queryExecution().optimizedPlan().toString()) or ingest(parsed, *a))
    texts.d9_uploaded_ledger(spark, sf_dir).count()
    assert len(plans) == 2 and all("regexp" not in p for p in plans)


def test_parts_of_a_line_are_cut_out_once(spark):
    import datetime as dt

    from spendlens.operators import statements

    rows = statements.parse(spark.createDataFrame([(1, "01/02/2024 SHOP -1,00")], "doc_id long, text string"), dt.date(2024, 1, 20))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract") < 25
    assert [(r.date_text, r.amount, r.type) for r in rows.collect()] == [("2024-02-01", 1.0, "debit")]
