"""Every registered finance query against its SQL, and what holds of those without one."""

import pytest

from spendlens import plans

from . import oracle


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    oracle.compare(plans.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), plans.ORACLE[name])


def test_queries_without_sql(spark, sf_dir):
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"s6_page_outline"}
    found = plans.QUERIES["s6_page_outline"](spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.title for r in found)


def test_statements_of_all_parsers(spark, sf_dir):
    rows = plans.QUERIES["d9_statement_ingest_all"](spark, sf_dir).collect()
    orders = {}
    for o in spark.read.parquet(f"{sf_dir}/orders.parquet").collect():
        orders.setdefault(o.o_custkey, []).append(("SHOP" + o.o_orderpriority[0], round(float(o.o_totalprice), 2), "credit" if o.o_orderstatus == "O" else "debit"))
    expected = {c: sorted(x) for c, x in orders.items() if c % 3 != 1 or len(x) > 2}
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.description, r.amount, r.type))
    assert {c: sorted(x) for c, x in found.items()} == expected
    assert any(c % 3 == 2 for c in found)
    counted = plans.QUERIES["d9_statement_counters_all"](spark, sf_dir).collect()
    assert {r.doc_id: (r.total, r.inserted, r.skipped) for r in counted} == {c: (len(x), len(x), 0) for c, x in expected.items()}


def test_month_filter_reaches_the_scan(spark, sf_dir):
    plan = plans.QUERIES["a2_summary_by_category"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["category", "spent", "income", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_embedded_codes_of_seven_digits(spark, tmp_path):
    import duckdb

    from spendlens.sources import catalogues

    duckdb.sql("SELECT k::BIGINT AS p_partkey, 'n' || k AS p_name, 'Brand#7' AS p_brand, 'T' AS p_type, 20 AS p_size, 900.5::DOUBLE AS p_retailprice FROM (VALUES (5), (1234567), (1234568), (999999)) v(k)").write_parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    oracle.compare(plans.QUERIES["s8_embedded_json"](spark, str(tmp_path)), con, plans.ORACLE["s8_embedded_json"])
    page = spark.createDataFrame([(1, "u", '{"Product":[{"Name":"n","Code":"1234567","Price":"$ 9"}]}')], "store_id long, base_url string, payload string")
    assert catalogues.embedded_json(page).first().url == "u/p/1234567"
