"""Dataflows on small stated tables: ties, nulls, empty tables and the odd cases they define."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import dates
from spendlens.operators import calendar, goals, ledger, offers, plans_state, recurring, statements, writes
from spendlens.sources import catalogues, encrypted

LEDGER = "id long, user_id long, ts timestamp_ntz, date date, amount decimal(14,2), category string, type string"


def entry(i, user, day, amount, category="x", kind="debit"):
    from decimal import Decimal

    d = dt.datetime.fromisoformat(day)
    return (i, user, d, d.date(), Decimal(amount), category, kind)


def test_empty_ledger(spark):
    none = spark.createDataFrame([], LEDGER)
    assert ledger.summary(none, "2024-01", "category").count() == 0
    assert ledger.summary(none, "2024-01").first().n == 0
    assert ledger.spending_pace(none, dt.datetime(2024, 1, 1), 2).count() == 0


def test_null_category_adds_to_other(spark):
    rows = spark.createDataFrame([entry(1, 1, "2024-01-02", "5"), entry(2, 1, "2024-01-03", "7", None), entry(3, 1, "2024-01-03", "2", "Otros")], LEDGER)
    spending = ledger.month_maps(ledger.category_months(rows, dt.datetime(2024, 1, 20), 3, "user_id")).first().spending
    assert spending == {"x": 5.0, "Otros": 9.0}


def test_budget_tiers(spark):
    spent = spark.createDataFrame([(1, "a", 80.0), (1, "b", 100.0), (1, "c", 120.0)], "user_id long, category string, spent double")
    wanted = spark.createDataFrame([(1, c, 100) for c in "abcd"], "user_id long, category string, budget int")
    found = {r.category: (r.tier, r.bar, r.over) for r in ledger.budget_status(spent, wanted).collect()}
    assert found == {"a": ("warn", 80.0, None), "b": ("danger", 100.0, None), "c": ("danger", 100.0, 20), "d": ("ok", 0.0, None)}


def charges(spark, rows):
    return spark.createDataFrame([(1, i, dt.datetime.fromisoformat(d), name, a, "debit") for i, (name, d, a) in enumerate(rows)], "user_id long, id long, ts timestamp_ntz, description string, amount double, type string")


REGISTERED = "user_id long, name string"


def test_recurring(spark):
    as_of, none = dt.datetime(2024, 3, 20), spark.createDataFrame([], REGISTERED)
    months = ["2024-01-01", "2024-02-01", "2024-03-01"]
    steady = charges(spark, [("Gym club", d, 10.0) for d in months])
    row = recurring.candidates(steady, none, as_of).first()
    assert (row.amount, row.occurrences, str(row.last_charge)) == (10, 3, "2024-03-01")
    assert recurring.candidates(charges(spark, [("Gym", d, a) for d, a in zip(months, (100.0, 100.0, 140.0))]), none, as_of).count() == 0
    assert recurring.candidates(charges(spark, [("Gym", months[0], 10.0), (None, months[1], 1.0)]), none, as_of).count() == 0
    # A registered name that is empty once normalised contains and is contained in everything.
    assert recurring.candidates(steady, spark.createDataFrame([(1, "***")], REGISTERED), as_of).count() == 0
    assert recurring.candidates(steady, spark.createDataFrame([(2, "gym club")], REGISTERED), as_of).count() == 1


@pytest.mark.parametrize(("last", "alert"), [(102.0, None), (103.0, 3)])
def test_price_alert(spark, last, alert):
    subs = spark.createDataFrame([(5, 1, "Club", 100.0, True)], "id long, user_id long, name string, amount double, is_active boolean")
    found = recurring.price_alerts(recurring.latest_charges(subs, charges(spark, [("CLUB uy", "2024-03-01", last), ("Club", "2024-02-01", 500.0)]), dt.datetime(2024, 3, 20))).collect()
    assert [r.difference for r in found] == ([alert] if alert else [])


def test_latest_merchant_tie_keeps_first(spark):
    rows = spark.createDataFrame([(1, i, dt.date(2024, m, 1), "netflix", a, "debit") for i, m, a in ((1, 1, 10.0), (2, 2, 12.0), (3, 2, 13.0))], "user_id long, id long, date date, description string, amount double, type string")
    assert recurring.known_merchants(rows).first().amount == 12.0


def deposits(spark, rows):
    return spark.createDataFrame([(1, a, dt.datetime.fromisoformat(d)) for d, a in rows], "goal_id long, amount double, created_at timestamp_ntz")


@pytest.mark.parametrize(("days", "streak"), [((20, 19, 18), 3), ((19, 18), 2), ((18,), 0), ((20,), 1), ((20, 18), 1), ((), 0), ((20, 20, 19), 2)])
def test_streak(spark, days, streak):
    found = goals.streaks(deposits(spark, [(f"2024-01-{d}", 1.0) for d in days]), dt.date(2024, 1, 20)).collect()
    assert [r.streak for r in found] == ([streak] if streak else [])


def test_projection(spark):
    goal = spark.createDataFrame([(1, 1, 1000.0, None), (2, 1, 50.0, dt.date(2024, 5, 1))], "goal_id long, user_id long, target_amount double, target_date date")
    found = {r.goal_id: r for r in goals.insights(goal, deposits(spark, [("2024-01-01", 300.0), ("2024-02-01", 300.0)]), dt.datetime(2024, 3, 1)).collect()}
    one = found[1]
    assert (one.status, one.avg_per_month, one.months_left, str(one.projected_date)) == ("ok", 304, 1.3, "2024-04-10")
    assert (one.p25, one.p50, one.p75, one.quota) == (True, True, False, None)
    assert found[2].status == "no_data"


def test_quota(spark):
    as_of = F.lit(dt.date(2024, 1, 1))
    row = spark.range(1).select(*(goals.monthly_quota(F.lit(r), F.lit(d).cast("date"), as_of) for r, d in ((600.0, "2024-03-01"), (0.0, "2024-03-01"), (600.0, "2023-03-01"), (600.0, None)))).first()
    assert list(row) == [305, 0, None, None]


def test_reminders(spark):
    bills = spark.createDataFrame([(i, u, "b", 20 + 1, 1, True) for i, u in enumerate((1, 2, 3))], "id long, user_id long, name string, due_day int, reminder_days int, is_active boolean")
    users = spark.createDataFrame([(1, "ExponentPushToken[a]"), (2, "web"), (3, None)], "user_id long, push_token string")
    assert [r.user_id for r in calendar.reminders(bills, users, dt.date(2024, 1, 20)).collect()] == [1]


OFFERS = "store_id long, ordinal long, name string, price double"


def test_basket(spark):
    rows = spark.createDataFrame([(1, 1, "Arroz", 10.0), (1, 2, "Fideos", 5.0), (2, 1, "Arroz", 8.0)], OFFERS)
    items = [(1, "arroz", 2), (2, "fideos", 1)]
    best = offers.best_offers(rows, items)
    totals = offers.store_totals(best, items)
    assert [(r.store_id, r.total, r.found, r.missing) for r in totals.orderBy("rank").collect()] == [(1, 25.0, 2, ""), (2, 16.0, 1, "fideos")]
    assert tuple(offers.optimal(best, totals).first()) == (21.0, 25.0, 4.0)


def test_search_relaxes_only_when_nothing_passes(spark):
    names = ["Suprema de pollo", "Suprema 3 Arroyos", "Pollo spiedo", "Harina Suprema"]
    rows = spark.createDataFrame([(1, i, n, 1.0) for i, n in enumerate(names)], OFFERS)
    assert [r.name for r in offers.search(rows, ["suprema de pollo"]).collect()] == ["Suprema de pollo"]
    assert [r.name for r in offers.search(rows.where("ordinal > 0"), ["suprema de pollo"]).collect()] == ["Suprema 3 Arroyos"]
    assert offers.search(rows, ["x"]).count() == 0
    assert offers.search(rows, ["de"]).count() == 4


def parsed(spark, text):
    return statements.parse(spark.createDataFrame([(1, text)], "doc_id long, text string"), dt.date(2024, 4, 1)).orderBy("line_no").collect()


def test_statement_single_lines(spark):
    line = "05/03/2024 DISCO -1.234,50 9.000,00"
    found = parsed(spark, "\n".join([line] * 3))
    assert len(found) == 3
    r = found[0]
    assert (str(r.date), r.description, r.amount, r.type, r.category) == ("2024-03-05", "DISCO", 1234.5, "debit", "Supermercado")


def test_statement_blocks(spark):
    block = "05/03/2024 123456 COMPRA\nNETFLIX.COM -\n-450,00 5.833,07"
    found = parsed(spark, "\n".join([block] * 3))
    assert [(str(r.date), r.description, r.amount, r.type) for r in found] == [("2024-03-05", "NETFLIX.COM", 450.0, "debit")] * 3


def test_statement_of_few_rows_goes_to_the_generic_parser(spark):
    assert [r.parser for r in parsed(spark, "05/03/2024 DISCO -1.234,50 9.000,00")] == [3]
    assert parsed(spark, None) == [] and parsed(spark, "") == []


def test_impossible_dates_are_skipped(spark):
    df = statements.parse(spark.createDataFrame([(1, "31/02/2024 DISCO 10,00 20,00\n" * 3)], "doc_id long, text string"), dt.date(2024, 4, 1))
    assert tuple(statements.counters(df).first()) == (1, 3, 0, 3)


def test_patch_lets_a_named_null_win(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, token string")
    patches = spark.createDataFrame([(1, ["token"], "ignored", None)], "id long, fields array<string>, name string, token string")
    assert sorted(map(tuple, writes.patch(table, patches, "id").collect())) == [(1, "a", None), (2, "b", "y")]


def test_append_new_and_upsert(spark):
    table = spark.createDataFrame([(1, None), (2, "b")], "id long, name string")
    assert writes.append_new(table, table.union(spark.createDataFrame([(3, "c"), (3, "c")], table.schema)), "id", "name").count() == 3
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2)], "id long, name string, seq long")
    assert sorted(map(tuple, writes.upsert(table, changes, "id").collect())) == [(1, None), (2, "new")]


EVENTS = "seq long, type string, user_id long, ts timestamp_ntz, expiration_ms long"


@pytest.mark.parametrize(("types", "plan"), [(("INITIAL_PURCHASE", "EXPIRATION"), "free"), (("EXPIRATION", "RENEWAL"), "premium"), (("RENEWAL", "UNKNOWN"), "premium")])
def test_plan_events(spark, types, plan):
    events = spark.createDataFrame([(i, t, 1, None, None) for i, t in enumerate(types)], EVENTS)
    row = plans_state.plan_state(events).first()
    assert (row.plan, row.expires_at) == (plan, None)


def test_bracketed_json():
    assert catalogues.bracketed('x "Product":[{"a":"]\\""},[1]] y', '"Product":[') == '[{"a":"]\\""},[1]]'
    assert catalogues.bracketed("nothing", '"Product":[') is None


def test_bad_payloads_give_nothing(spark):
    pages = spark.createDataFrame([(1, "", None), (2, "", "not json"), (3, "", "<div class=product-item>")], "store_id long, base_url string, payload string")
    assert catalogues.product_json(pages).count() == catalogues.graph_json(pages).count() == catalogues.embedded_json(pages).count() == 0
    assert all(catalogues.html_pages(pages, layout).count() == 0 for layout in catalogues.LAYOUTS)


def test_wrong_key_gives_null(spark):
    row = spark.range(1).select(encrypted.decrypt(F.lit("00" * 32), F.lit("00" * 16), F.lit("AAAA"))).first()
    assert row[0] is None


def test_month_range_is_half_open(spark):
    rows = spark.sql("select cast(x as timestamp_ntz) t from values ('2024-01-31 23:59:59'), ('2024-02-01 00:00:00'), ('2024-01-01') as v(x)")
    assert rows.where(dates.month_range(F.col("t"), "2024-01")).count() == 2


def test_catalogue_pages_and_union(spark):
    item = '<div class="product-item"><div class="prod-desc"><h3><a href="/{0}">n{0}</a></h3></div><b class="desc-prices"><b class="val">$ {1}</b></b></div>'
    first = "".join(item.format(i, i) for i in range(20))  # a price of 0 is no offer
    pages = spark.createDataFrame([(1, 0, "u", first), (1, 1, "u", item.format("x", "1.250")), (2, 0, "u", None)], "store_id long, page long, base_url string, payload string")
    found = catalogues.html_pages(pages, "keyword")
    both = catalogues.union([found, catalogues.product_json(pages.withColumn("payload", F.lit("not json")))])
    rows = sorted((r.store_id, r.ordinal, r.name, r.price) for r in both.collect())
    assert rows == [(1, i, f"n{i + 1}", float(i + 1)) for i in range(12)] + [(1, 12, "nx", 1250.0)]

    insight = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "goal_id long, user_id long")
    spent = spark.createDataFrame([(7, 40)], "user_id long, surplus long")
    assert sorted(map(tuple, goals.with_surplus(insight, spent).select("goal_id", "surplus").collect())) == [(1, 40), (2, 40), (3, 0)]


def test_listed_products(spark):
    from spendlens.functions import rules

    assert len(rules.PRODUCTS) == 162 and all(p == " ".join(p.split()) and p for p in rules.PRODUCTS)
    terms = spark.createDataFrame(list(enumerate(rules.PRODUCTS)), "ordinal long, term string")
    none = spark.createDataFrame([], "term string, ordinal long")
    assert [r.term for r in offers.typeahead(terms, none, "Crema de l").collect()] == ["crema de leche"]


def test_alerts_only_above_the_budget(spark):
    spent = spark.createDataFrame([(1, "a", 80.0), (1, "b", 100.0), (1, "c", 120.0), (1, "z", 5.0)], "user_id long, category string, spent double")
    wanted = spark.createDataFrame([(1, "a", 100), (1, "b", 100), (1, "c", 100), (1, "z", 0), (1, "n", None)], "user_id long, category string, budget int")
    assert [(r.month, r.category, r.over) for r in ledger.new_alerts(ledger.budget_status(spent, wanted), "2024-01").collect()] == [("2024-01", "c", 20)]


def test_income_list(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, 0.0), (1, "b", 1.0, 9.0), (1, "c", 0.0, 2.0)], "user_id long, category string, spent double, income double")
    assert [r.category for r in ledger.top_categories(rows, 8, "income").orderBy("place").collect()] == ["b", "c"]
    assert [r.category for r in ledger.top_categories(rows, 8).orderBy("place").collect()] == ["b", "a"]


def test_page_and_total(spark):
    rows = spark.createDataFrame([entry(i, 1, f"2024-01-{1 + i % 3:02}", "5") for i in range(7)], LEDGER)
    found = ledger.page_with_total(rows, 1, 3, 2).first()
    assert (found.total, [t.id for t in found.transactions]) == (7, [4, 1, 6])
    beyond = ledger.page_with_total(rows, 1, 3, 20).first()
    assert (beyond.total, beyond.transactions) == (7, [])
    assert ledger.page_with_total(rows, 9).first().total == 0


def test_ranks_over_ranges(spark):
    from spendlens.operators import ranks

    rows = spark.createDataFrame([(i, (i * 7919) % 50) for i in range(500)], "id long, v long")
    found = ranks.ranked(rows, "place", F.col("v").desc(), F.col("id").asc())
    expected = sorted(((-((i * 7919) % 50), i) for i in range(500)))
    assert [(-r.v, r.id) for r in found.orderBy("place").collect()] == expected
    assert [r.place for r in found.orderBy("place").collect()] == list(range(1, 501))
    assert ranks.ranked(rows.where("id < 0"), "place", F.col("id").asc()).collect() == []


def test_ranks_have_no_single_task(spark):
    from spendlens.operators import ranks

    rows = spark.createDataFrame([(i,) for i in range(50)], "id long")
    assert "SinglePartition" not in ranks.ranked(rows, "place", F.col("id").asc())._jdf.queryExecution().executedPlan().toString()


def contained(a, b):
    return sorted((u, x, y) for u, x in set(a) for v, y in set(b) if u == v and (x in y or y in x))


def test_names_that_contain_one_another(spark):
    import random

    from spendlens.operators import gram_index

    rng = random.Random(2)
    name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6)))
    a = {(rng.randint(1, 3), name()) for _ in range(80)} | {(1, ""), (2, "é"), (2, "\U0001f600ab")}
    b = {(rng.randint(1, 3), name()) for _ in range(80)} | {(3, ""), (2, "xé\U0001f600ab")}
    found = gram_index.either_containing(spark.createDataFrame(sorted(a), "user_id long, one string"), spark.createDataFrame(sorted(b), "user_id long, other string"), "one", "other", "user_id")
    assert sorted((r.user_id, r.one, r.other) for r in found.collect()) == contained(a, b)


def test_search_of_very_many_queries_joins_only_what_can_match(spark):
    from spendlens.operators import gram_index

    names = [f"product{i:04} kind{i % 7}" for i in range(1000)]
    words = spark.createDataFrame([(f"product{i:04}",) for i in range(1000)], "word string")
    posted = gram_index.postings(spark.createDataFrame([(n,) for n in names], "text string"), "text")
    counts = gram_index.text_counts(posted)
    rare = gram_index.rarest(words, counts, "word")
    assert rare.count() == 1000 and rare.agg(F.sum("texts")).first()[0] < 20_000  # of 1,000,000 pairs
    assert gram_index.containing(words, posted, counts, "word", "text").count() == 1000


def test_typed_limits(spark):
    from spendlens.functions import numbers

    cases = {"3": 3, "2.9": 2, "": None, "abc": None, "-5": -5, "0": 0, " 7 ": 7, "1e2": 1, ".5": 0, None: None, "5 rows": None}
    found = spark.createDataFrame([(k,) for k in cases], "t string").select("t", numbers.lenient_limit(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in found} == cases


def test_texts_in_texts_are_not_broadcast(spark):
    from spendlens.operators import gram_index

    a, b = (spark.createDataFrame([(1, "part 12")], f"user_id long, {c} string") for c in ("one", "other"))
    plan = gram_index.either_containing(a, b, "one", "other", "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_store_totals_that_differ_by_less_than_a_cent_are_equal(spark):
    best = spark.createDataFrame([(1, "a", 1, 1, 0.1), (2, "b", 1, 1, 0.2), (1, "a", 1, 2, 0.15), (2, "b", 1, 2, 0.15)], "item_id int, item string, quantity int, store_id long, price double")
    totals = offers.store_totals(best, [(1, "a", 1), (2, "b", 1)])
    assert [r.store_id for r in totals.orderBy("rank").collect()] == [1, 2]
