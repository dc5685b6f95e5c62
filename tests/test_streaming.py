"""Streams of several batches: out-of-order, repeated and late rows, timers, state that is forgotten, and no rows at all."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from spendlens import shared, streaming
from spendlens.operators import offers as op, plans_state
from spendlens.streaming import search

EVENTS = "seq long, type string, user_id long, ts timestamp_ntz, expiration_ms long"


class Folder:
    """A folder that files arrive in, and a stream of it, a file a batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path, self.n = spark, schema, shared.new_path(spark, "arriving"), 0
        self.base = shared.new_path(spark, "stream")
        spark.createDataFrame([], schema).coalesce(1).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self):
        return streaming.read_files(self.spark, self.path, 1)


def event(seq, kind, user, expires=None):
    return (seq, kind, user, dt.datetime(2024, 1, 1), expires)


def test_plan_state_over_batches(spark):
    folder = Folder(spark, EVENTS)
    first = [event(1, "INITIAL_PURCHASE", 1, 1_706_745_600_000), event(2, "EXPIRATION", 2), event(3, "TEST", 3)]
    second = [event(9, "RENEWAL", 1), event(5, "CANCELLATION", 1), event(2, "EXPIRATION", 2)]  # 2 comes again
    third = [event(4, "EXPIRATION", 1), event(9, "RENEWAL", 1), event(7, "RENEWAL", 2, 1_706_745_600_000)]  # 4 is late, 9 comes again
    for rows in (first, second, third):
        folder.add(rows)
        found = streaming.run_plan_state(folder.stream(), folder.base)
    every = spark.createDataFrame(first + second + third, EVENTS).dropDuplicates(["user_id", "seq"])
    key = lambda r: (r.user_id, r.plan, r.expires_at, r.changes)
    assert sorted(map(key, found.collect()), key=repr) == sorted(map(key, plans_state.plan_state(every).collect()), key=repr)
    assert {r.user_id: r.active for r in found.collect()} == {1: True, 2: False}
    # A batch writes only the users that it changes.
    sizes = [spark.read.parquet(f"{folder.base}/out/batch={k}").count() for k in range(-1, 4) if k != 0]
    assert sum(sizes) == 2 + 1 + 2


def test_plan_ends_by_the_clock(spark):
    folder = Folder(spark, EVENTS)
    soon = int((time.time() + 25) * 1000)
    folder.add([event(1, "INITIAL_PURCHASE", 1, soon), event(2, "INITIAL_PURCHASE", 2, soon), event(3, "INITIAL_PURCHASE", 3)])
    found = {r.user_id: (r.plan, r.active) for r in streaming.run_plan_state(folder.stream(), folder.base).collect()}
    assert found == {1: ("premium", True), 2: ("premium", True), 3: ("premium", True)}
    folder.add([event(4, "RENEWAL", 2, soon + 3_600_000)])  # the timer of the old end must not fire
    streaming.run_plan_state(folder.stream(), folder.base)
    time.sleep(max(0.0, soon / 1000 - time.time()) + 0.5)
    folder.add([event(5, "RENEWAL", 9)])
    found = {r.user_id: (r.plan, r.active) for r in streaming.run_plan_state(folder.stream(), folder.base).collect()}
    assert found == {1: ("premium", False), 2: ("premium", True), 3: ("premium", True), 9: ("premium", True)}


def test_jobs_are_forgotten(spark):
    folder = Folder(spark, "job_id long, kind string, total long")
    folder.add([(1, "start", 3), (1, "item", None), (2, "start", 1), (2, "item", None), (3, "item", None)])
    found = {r.job_id: (r.total, r.completed, r.status) for r in streaming.run_jobs(folder.stream(), folder.base).collect()}
    assert found == {1: (3, 1, "running"), 2: (1, 1, "done"), 3: (None, None, "unknown")}
    folder.add([(1, "item", None), (1, "item", None)])
    assert {r.job_id: r.status for r in streaming.run_jobs(folder.stream(), folder.base).collect()}[1] == "done"
    brief = Folder(spark, "job_id long, kind string, total long")
    brief.add([(1, "start", 3), (1, "item", None)])
    streaming.run_jobs(brief.stream(), brief.base, ttl_ms=1000)
    time.sleep(1.5)
    brief.add([(1, "item", None)])
    assert streaming.run_jobs(brief.stream(), brief.base, ttl_ms=1000).first().status == "unknown"


LEDGER = "user_id long, ts timestamp_ntz, amount decimal(14,2), category string, type string"


def spent(user, day, amount, category="food", kind="debit"):
    from decimal import Decimal

    return (user, dt.datetime.fromisoformat(day), Decimal(amount), category, kind)


def test_budget_alerts_once_a_month(spark):
    budgets = spark.createDataFrame([(1, "food", 100.0), (2, "food", 100.0)], "user_id long, category string, budget double")
    folder = Folder(spark, LEDGER)
    batches = [
        [spent(1, "2024-01-03", "100"), spent(2, "2024-01-03", "90"), spent(1, "2024-01-04", "500", "fun"), spent(2, "2024-01-04", "500", kind="credit")],
        [spent(1, "2024-01-05", "0.01"), spent(2, "2024-01-08", "9")],
        [spent(1, "2024-01-20", "70"), spent(1, "2024-02-01", "101")],
        [spent(1, "2024-04-28", "1")],
        [spent(2, "2024-01-09", "900"), spent(1, "2024-04-29", "100")],  # the first comes after the watermark
        [spent(1, "2024-04-30", "5")],
    ]
    late = 0
    for rows in batches:
        folder.add(rows)
        found, n = streaming.run_budget_alerts(folder.stream(), budgets, base=folder.base)
        late += n
    assert sorted((r.user_id, r.month, r.category, r.spent) for r in found.collect()) == [(1, "2024-01", "food", 100.01), (1, "2024-02", "food", 101.0), (1, "2024-04", "food", 101.0)]
    assert late == 1


OFFERS = "store_id long, ordinal long, name string, price double"


def test_search_after_every_batch(spark):
    folder = Folder(spark, OFFERS)
    batches = [
        [(1, 1, "Suprema 3 Arroyos", 10.0), (1, 2, "Pollo spiedo", 5.0), (1, 3, None, 1.0)],
        [(2, 1, "Harina Suprema", 4.0), (2, 2, "Queso", 3.0), (2, 3, "Queso magro", 3.0)],
        [(3, 1, "Suprema de pollo", 8.0), (1, 4, "Queso", 2.0)],
    ]
    queries = ["suprema de pollo", "queso", "de la", "zzz", "x"]
    so_far = []
    for k, rows in enumerate(batches):
        so_far += rows
        folder.add(rows)
        top, stats = streaming.run_search(folder.stream(), queries, 2, folder.base)
        offers = spark.createDataFrame(so_far, OFFERS)
        plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert plain(top) == plain(op.search(offers, queries, 2))
        assert plain(stats) == plain(op.price_stats(op.matching(offers, queries)))
    assert search.after(spark, folder.base, -1)[0].count() == 0
    before, _ = search.after(spark, folder.base, spark.read.parquet(f"{folder.base}/out").agg(F.max("n")).first()[0] - 1)
    assert {r.name for r in before.where("query = 'suprema de pollo'").collect()} == {"Suprema 3 Arroyos"}


def test_streams_without_rows(spark):
    budgets = spark.createDataFrame([], "user_id long, category string, budget double")
    assert streaming.run_plan_state(Folder(spark, EVENTS).stream()).collect() == []
    assert streaming.run_jobs(Folder(spark, "job_id long, kind string, total long").stream()).collect() == []
    assert streaming.run_budget_alerts(Folder(spark, LEDGER).stream(), budgets)[0].collect() == []
    assert [d.collect() for d in streaming.run_search(Folder(spark, OFFERS).stream(), ["queso"])] == [[], []]
    assert streaming.run_progress(Folder(spark, "k string, value double").stream(), "k").collect() == []
    assert streaming.run_rate_windows(Folder(spark, "user_id long, ts timestamp_ntz").stream()).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.folder(Session())
