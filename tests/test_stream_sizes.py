"""Streams at size: no call of Python for each key, batches dealt to more tasks than there are batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens import shared, streaming


@pytest.fixture
def no_python_state(monkeypatch):
    from pyspark.sql.group import GroupedData

    def refuse(*_, **__):
        raise AssertionError("Python is called for each key and batch")

    monkeypatch.setattr(GroupedData, "transformWithState", refuse)


def test_batches_are_dealt_to_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        stream = streaming.in_batches(spark.range(6000), 3, "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = []
    query = stream.writeStream.foreachBatch(lambda batch, n: sizes.append(batch.withColumn("file", F.input_file_name()).agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("file")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 3 and sum(s[0] for s in sizes) == 6000
    assert all(a[2] < b[1] for a, b in zip(sizes, sizes[1:])) and max(s[3] for s in sizes) == 4


def test_batches_are_dealt_by_size(spark, monkeypatch):
    """More than `spark.sql.shuffle.partitions` tasks deal what is too large for them; the session's settings stay."""
    from spendlens.streaming import files

    monkeypatch.setattr(files, "DEALT", 2048)
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    rows = shared.written(spark.range(6000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")), "rows")
    spark.conf.set(names[0], "4")
    try:
        stream = streaming.in_batches(rows.groupBy("id").agg(F.max("text").alias("text")), 3, "id")
        assert spark.conf.get(names[1], None) == before[1]
    finally:
        spark.conf.set(names[0], before[0])
    sizes = []
    query = stream.writeStream.foreachBatch(lambda batch, n: sizes.append(batch.withColumn("file", F.input_file_name()).agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("file")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 3 and sum(s[0] for s in sizes) == 6000 and sum(s[3] for s in sizes) > 100
    assert all(a[2] < b[1] for a, b in zip(sizes, sizes[1:]))


def test_jobs_without_python(spark, no_python_state):
    started = spark.range(2000).select(F.col("id").alias("job_id"), F.lit("start").alias("kind"), F.lit(2).cast("long").alias("total"), F.lit(0).alias("at"))
    items = lambda at: started.select("job_id", F.lit("item").alias("kind"), F.lit(None).cast("long").alias("total"), F.lit(at).alias("at"))
    base = shared.new_path(spark, "stream")
    found = streaming.run_jobs(streaming.in_batches(started.unionByName(items(1)).unionByName(items(2)), 3, "at"), base)
    assert [tuple(r) for r in found.groupBy("total", "completed", "status").count().collect()] == [(2, 2, "done", 2000)]


def test_alerts_without_python(spark, no_python_state):
    days = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).cast("timestamp_ntz")
    entries = spark.range(500).select(F.col("id").alias("user_id"), F.explode(F.array(*map(F.lit, range(30)))).alias("day"))
    ledger = entries.select("user_id", days.alias("ts"), F.lit(4).cast("decimal(14,2)").alias("amount"), F.lit("food").alias("category"), F.lit("debit").alias("type"))
    budgets = spark.range(500).select(F.col("id").alias("user_id"), F.lit("food").alias("category"), F.when(F.col("id") % 2 == 0, 50.0).otherwise(120.0).alias("budget"))
    found, late = streaming.run_budget_alerts(streaming.in_batches(ledger, 3, "ts"), budgets)
    assert late == 0 and found.groupBy(F.col("user_id") % 2).count().collect() == [(0, 250)]
    assert found.agg(F.min("spent") > 50).first()[0] and found.distinct().count() == 250


def test_plans_without_python(spark, no_python_state):
    ids = spark.range(9000)
    kind = F.when(F.col("id") % 3 == 0, "RENEWAL").otherwise("EXPIRATION")
    events = ids.select(F.col("id").alias("seq"), kind.alias("type"), (F.col("id") % 1000).alias("user_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("expiration_ms"))
    base = shared.new_path(spark, "stream")
    found = streaming.run_plan_state(streaming.in_batches(events, 3, "seq"), base)
    # The last event of user u has seq 8000 + u.
    assert sorted(map(tuple, found.groupBy("plan", "active", "changes").count().collect())) == [("free", False, 9, 667), ("premium", True, 9, 333)]


def test_search_reads_a_batch_once(spark):
    """Searches without keywords meet the offers without a Cartesian product, which reads the offers once for each partition of the searches."""
    from spendlens.streaming import search

    offers = shared.written(spark.createDataFrame([(1, 1, "Queso", 2.0), (1, 2, "Pan", 1.0)], "store_id long, ordinal long, name string, price double"), "offers")
    found = search._found(offers, ["queso", "de la"])
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query, r.name) for r in found.collect()) == [("de la", "Pan"), ("de la", "Queso"), ("queso", "Queso")]


def test_found_names_are_few(spark):
    """Offers aren't dealt by name, of which many share one, where few names are found."""
    from spendlens.streaming import search

    name = F.concat(F.lit("Queso extra"), (F.col("id") % 7).cast("string"))
    offers = shared.written(spark.range(100000).select(F.col("id").alias("store_id"), F.col("id").alias("ordinal"), name.alias("name"), F.lit(2.0).alias("price")), "offers")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = search._found(offers, ["queso extra3", "queso duro"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(name" not in plan and "SortMergeJoin" not in plan
        assert [tuple(r) for r in found.groupBy("query", "level", "name").count().where("level = 'strict'").collect()] == [("queso extra3", "strict", "Queso extra3", 14286)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
