"""Written ledgers: only touched months are rewritten, and a repeated batch changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.operators.tables import MonthTable

ROWS = "id long, date date, amount double, note string"


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def table(spark):
    rows = [(1, day("2024-01-05"), 1.0, "a"), (2, day("2024-01-06"), 2.0, "b"), (3, day("2024-02-01"), 3.0, "c"), (4, None, 4.0, None), (5, day("2024-03-01"), 5.0, "e")]
    return MonthTable.create(spark.createDataFrame(rows, ROWS))


def content(table):
    return sorted(((r.id, str(r.date), r.amount, r.note) for r in table.rows().collect()), key=repr)


def files(table):
    return {r.month: r.files for r in table.files().collect()}


def changed(table, act):
    before = files(table)
    act()
    after = files(table)
    return {m for m in before.keys() | after.keys() if before.get(m) != after.get(m)}


def test_months_are_partitions(table):
    assert set(files(table)) == {"2024-01", "2024-02", "2024-03", "none"}
    assert [r[0] for r in content(table)] == [1, 2, 3, 4, 5]


def test_append_twice(spark, table):
    new = spark.createDataFrame([(6, day("2024-02-02"), 6.0, "f"), (6, day("2024-02-02"), 6.0, "f"), (7, day("2024-04-02"), 7.0, "g")], ROWS)
    assert changed(table, lambda: table.append(new, 1)) == {"2024-02", "2024-04"}
    once = content(table)
    assert [r[0] for r in once] == [1, 2, 3, 4, 5, 6, 6, 7]
    table.append(new, 1)
    assert content(table) == once
    table.append(new, 2)
    assert len(content(table)) == len(once) + 3


def test_append_new(spark, table):
    new = spark.createDataFrame([(1, day("2024-01-05"), 1.0, "again"), (8, day("2024-01-07"), 8.0, "h"), (8, day("2024-01-07"), 8.0, "h")], ROWS)
    for _ in range(2):
        table.append_new(new, 3, "id", "date", "amount")
        assert [(r[0], r[3]) for r in content(table)] == [(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e"), (8, "h")]
    with pytest.raises(ValueError):
        table.append_new(new, 3, "id")


def test_upsert_moves_a_row(spark, table):
    changes = spark.createDataFrame([(3, day("2024-02-01"), 30.0, "old", 1), (3, day("2024-05-01"), 31.0, "new", 2), (9, day("2024-01-09"), 9.0, "i", 1)], ROWS + ", seq long")
    assert changed(table, lambda: table.upsert(changes, 4, "id")) == {"2024-01", "2024-02", "2024-05"}
    once = content(table)
    assert (3, "2024-05-01", 31.0, "new") in once and len(once) == 6 and "2024-02" not in files(table)
    table.upsert(changes, 4, "id")
    assert content(table) == once


def test_patch_names_fields(spark, table):
    patches = spark.createDataFrame([(2, ["note"], None, 99.0), (5, ["amount"], "x", 50.0)], "id long, fields array<string>, note string, amount double")
    assert changed(table, lambda: table.patch(patches, 5, "id")) == {"2024-01", "2024-03"}
    assert [r for r in content(table) if r[0] in (2, 5)] == [(2, "2024-01-06", 2.0, None), (5, "2024-03-01", 50.0, "e")]


def test_delete(spark, table):
    gone = spark.createDataFrame([(3,), (4,), (77,)], "id long")
    assert changed(table, lambda: table.delete(gone, "id")) == {"2024-02", "none"}
    assert [r[0] for r in content(table)] == [1, 2, 5]
    assert changed(table, lambda: table.delete(gone, "id")) == set()


def test_reads_only_the_months_asked_for(spark, table):
    plan = table.read().where(F.col("month") == "2024-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
