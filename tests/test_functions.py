"""The column functions on small stated cases."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spendlens.functions import dates, numbers, rules, text

DAY = dt.date(2024, 1, 20)


def values(spark, cases, f):
    schema = "i int, x string"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], schema)
    return [r[1] for r in sorted(df.select("i", f(F.col("x"))).collect())]


@pytest.mark.parametrize(("f", "cases"), [
    (numbers.parse_price, {"$ 1.234,50": 1234.5, "45,2": 45.2, "890": 890.0, "45.2": 452.0, "": 0.0, "abc": 0.0, "1,2,3": 1.2}),
    (numbers.parse_amount, {"1.234,50": 1234.5, "-1.102,21": -1102.21, "1,234.50": 1234.5, "1.234": 1234.0, "1,234": 1234.0, "1234,56": 1234.56, "12.50": 12.5, "12,50": 12.5, "+5": 5.0, "1.2.3": 1.2, "abc": None, "": None, None: None}),
    (text.subscription_key, {"Netflix.com *MX": "netflix com mx", "Música Ñandú": "m sica and"}),
    (text.product_key, {"3 litros": "3l", "3lt": "3l", "2 lts": "2l", "500 mililitros": "500ml", "1 kilo": "1kg", "500 gramos": "500g"}),
    (text.tokens, {"Bidón de agua": ["bidon", "agua"], "": []}),
    (text.clean_description, {"COMPRA CON TARJETA DEBITO DISCO TARJ: ############5025": "DISCO", "SUPERMERCADO DISCO 441": "DISCO", "PAGO: NETFLIX.COM 610020699": "PAGO NETFLIX.COM", "TT55203750 UTE": "UTE", "CRUNCHYROLL": ""}),
    (text.upload_category, {"NETFLIX.COM": "Streaming", "Pizza Rappi": "Restaurantes", "CLÍNICA": "Salud", "Computer shop": "Otros"}),
    (text.manual_category, {"NETFLIX.COM": "Streaming", "Pizza Rappi": "Comida", "CLÍNICA": "Otros", "Computer shop": "Servicios"}),
    (text.merchant, {"PEDIDOS YA 1": "PedidosYa+", "antelope": None, "ANTEL 2": "Antel", "nothing": None}),
    (lambda c: dates.parse_date(c, F.lit(DAY)), {"05/03/2024": "2024-03-05", "5-3-24": "2024-03-05", "2024.03.05": "2024-03-05", "05/03": "2024-01-20", None: "2024-01-20", "31/02/2024": "2024-02-31"}),
])
def test_cases(spark, f, cases):
    assert values(spark, list(cases), f) == list(cases.values())


@pytest.mark.parametrize(("as_of", "day", "due", "days"), [
    ("2024-02-10", 31, "2024-03-02", 21), ("2024-01-31", 31, "2024-03-02", 31), ("2024-01-15", 15, "2024-02-15", 31), ("2024-01-15", 20, "2024-01-20", 5), ("2024-12-20", 5, "2025-01-05", 16),
])
def test_calendar(spark, as_of, day, due, days):
    today = F.lit(dt.date.fromisoformat(as_of))
    row = spark.range(1).select(dates.next_due(F.lit(day), today), dates.days_until(F.lit(day), today)).first()
    assert (str(row[0]), row[1]) == (due, days)


def test_rounding(spark):
    row = spark.range(1).select(*(numbers.half_up(F.lit(x)) for x in (-2.5, 2.5, -0.4))).first()
    assert list(row) == [-2, 3, 0]


def relevant(spark, query, name):
    words, key = text.tokens(F.lit(query)), text.product_key(F.lit(name))
    return tuple(spark.range(1).select(text.is_relevant(words, key), text.relevance(words, key)).first())


def test_relevance(spark):
    assert relevant(spark, "palta", "Aguacate Hass") == (True, 1.0)
    assert relevant(spark, "arroz", "Shampoo")[0] is False
    assert relevant(spark, "arroz integral", "Shampoo de arroz") == (True, 0.5)
    assert relevant(spark, "de la", "anything") == (True, 0.0)


def test_search_score(spark):
    names = ["Suprema de pollo", "Suprema 3 Arroyos", "Pollo spiedo", "Harina Suprema"]
    query = text.fold(F.lit("suprema de pollo"))
    scored = values(spark, names, lambda c: text.search_score(query, text.keywords(query), text.fold(c)))
    assert [s.score for s in scored] == [21, 8, 8, 0]
    assert [s.first_keyword for s in scored] == [True, True, False, True]


def test_hue(spark):
    def plain(s):
        h = 0
        for c in s:
            shifted = (h << 5) & 0xFFFFFFFF
            h = ord(c) + (shifted - (1 << 32) if shifted >= 1 << 31 else shifted) - h
        return abs(h) % 360

    names = ["Streaming", "Salud", "", "Educación y otros gastos"]
    assert values(spark, names, text.hue) == [plain(n) for n in names]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20))
def test_amounts_come_back(spark, cents):
    written = [f"{c // 100:,}".replace(",", ".") + f",{c % 100:02d}" for c in cents]
    assert values(spark, written, numbers.parse_amount) == pytest.approx([c / 100 for c in cents])


def test_rule_tables():
    assert (len(rules.UPLOAD_RULES), len(rules.MANUAL_RULES), len(rules.MERCHANTS)) == (15, 9, 37)


def test_deep_and_open_pages():
    from spendlens.sources import catalogues

    page = catalogues.tree("<div>" * 5000 + "".join(f"<p>x{i}" for i in range(3000)) + "<table><tr><td>a<td>b<tr><td>c</table>")
    assert len(list(page.all("p"))) == 3000 and page.text().endswith("x2999abc")
    assert [len(r.children) for r in page.all("tr")] == [2, 1] and page.first("td").text() == "a"


ODD = [
    None, "", " ", "12 litros y 3lts", "a5 lts", "5 5 litros", "07 mililitros\n2 kilo", "1 kilo2 litros", "3litros_", "9 litro 9 l", "x 5  gramos.", "Ünd 10 KILOS ", "é4 lt", "4 lté", "1 2 kilos 3 gramo",
    "NETFLIX", "ute", "utensilio", "éute", "uteé", "PEAJE acv", "ClÍNICA", "medica", "star+", "h&m", "disney", "disney plus", "luz\n", "un gas.", "çine", "transferencia de sueldo", "kfc Kfc",
]


def test_keys_of_odd_texts_are_those_of_one_unit_after_the_other(spark):
    def key(out):
        for unit, short in (("litros?", "l"), ("lts?", "l"), ("mililitros?", "ml"), ("kilos?", "kg"), ("gramos?", "g")):
            out = F.regexp_replace(out, rf"{text.EDGE}([0-9]+)\s*{unit}{text.EDGE}", f"$1{short}")
        return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))

    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", text.product_key(F.col("t")).alias("a"), key(text.fold(F.col("t"))).alias("b"))
    assert [(r.t, r.a) for r in rows.collect()] == [(r.t, r.b) for r in rows.collect()]


def test_whole_documents_have_the_category_that_descriptions_have(spark):
    c = F.col("t")
    found = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", text.upload_category(c), text.document_category(c), text.manual_category(c), text.manual_document_category(c)).collect()
    assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[2], r[4]) for r in found]


def test_texts_pass_few_patterns(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(text.product_key(F.col("t")).alias("key"), text.document_category(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4 and "RLIKE" not in plan
