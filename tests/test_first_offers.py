"""The first offers of each store are picked before rows are dealt."""

import pytest

from spendlens.operators import offers as op
from spendlens.sources import domain


def test_least_keys_are_kept_by_the_scans(spark, sf_dir):
    rows = lambda df: sorted(map(tuple, df.collect()))
    every = op.first_per_store(domain.offers(spark, sf_dir), 3)
    few = domain.offers(spark, sf_dir, 3)
    assert rows(few) == rows(every) and len(rows(few)) > 10
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Aggregate") < plan.index("WindowGroupLimit")


@pytest.mark.parametrize("n", [1, 50])
def test_parts_that_are_not_listed_take_no_place(spark, tmp_path, n):
    path = str(tmp_path)
    sold = [(1, k, 10.0 * k, 2.0) for k in (1, 2, 3, 3, 4)] + [(2, 2, 5.0, 1.0)]
    spark.createDataFrame(sold, "l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    want = [(1, 2, "b", 10.0), (1, 3, "c", 15.0), (1, 4, "d", 20.0)][:n] + [(2, 2, "b", 5.0)]
    assert sorted(map(tuple, domain.offers(spark, path, n).collect())) == want
