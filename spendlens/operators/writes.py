"""The write path as functions from tables to new tables: append, upsert, patch, delete, deposits and links.

Rewrites keep every row they don't touch and need one join by key. Of several
changes to one key the last (greatest seq) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_per_key(changes: DataFrame, *keys: str) -> DataFrame:
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("seq").desc()))
    return changes.withColumn("__n", newest).where("__n = 1").drop("__n", "seq")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def append_new(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Appends the rows whose natural key is new; of equal new rows one."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    fresh = rows.dropDuplicates(list(keys)).alias("r").join(table.select(*keys).alias("t"), condition, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Inserts or replaces by key: aggregation and union instead of a merge; `changes` have a seq."""
    both = table.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes, allowMissingColumns=True)
    return last_per_key(both, *keys).select(*table.columns)


def patch(table: DataFrame, patches: DataFrame, key: str, touched: Column | None = None) -> DataFrame:
    """Sets only the fields a patch names: patches have key, fields array<string> and the values; a named null overwrites."""
    own = patches.select(F.col(key).alias("__key"), F.col("fields").alias("__fields"), *(F.col(c).alias(f"__{c}") for c in patches.columns if c not in (key, "fields")))
    joined = table.join(own, F.col(key) == F.col("__key"), "left")
    new = lambda c: F.when(F.array_contains("__fields", c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    out = [new(c) if f"__{c}" in own.columns and c != key else F.col(c) for c in table.columns]
    if touched is not None and "updated_at" in table.columns:
        out = [F.when(F.col("__key").isNotNull(), touched).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at" else o for c, o in zip(table.columns, out)]
    return joined.select(*out)


def delete(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_owned(items: DataFrame, lists: DataFrame, user_id: int, item_ids: list[int]) -> DataFrame:
    """Deletes items by id, but only from the user's own lists."""
    own = lists.where(F.col("user_id") == user_id).select("list_id")
    gone = items.where(F.col("item_id").isin(item_ids)).join(own, "list_id", "left_semi")
    return delete(items, gone, "item_id")


def with_default_list(users: DataFrame, lists: DataFrame, name: str = "Mi lista") -> DataFrame:
    """Each user's first list, or a default one (list_id null) for those without."""
    first = lists.groupBy("user_id").agg(F.min_by("name", "list_id").alias("name"), F.min("list_id").alias("list_id"))
    return users.select("user_id").join(first, "user_id", "left").select("user_id", "list_id", F.coalesce("name", F.lit(name)).alias("name"))


def post_deposits(goals: DataFrame, ledger: DataFrame, deposits: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """New goals and ledger after deposits (goal_id, amount, date): each is a debit of the goal's owner and raises the goal's sum."""
    sums = deposits.groupBy("goal_id").agg(F.sum("amount").alias("__more"))
    raised = goals.join(sums, "goal_id", "left").withColumn("current_amount", (F.col("current_amount") + F.coalesce("__more", F.lit(0))).cast("decimal(14,2)")).drop("__more")
    debits = deposits.join(goals.select("goal_id", "user_id"), "goal_id").select("user_id", "date", F.col("amount").cast("decimal(14,2)").alias("amount"), F.lit("debit").alias("type"), F.lit(category).alias("category"), "goal_id")
    return raised, append(ledger, debits)


def link_transactions(ledger: DataFrame, goals: DataFrame, links: DataFrame) -> DataFrame:
    """Ledger rows with goal_id set where a link (id, goal_id) joins an entry and a goal of one user."""
    owned = links.join(goals.select("goal_id", F.col("user_id").alias("__owner")), "goal_id")
    joined = ledger.join(owned.select(F.col("id").alias("__id"), F.col("goal_id").alias("__goal"), "__owner"), (F.col("id") == F.col("__id")) & (F.col("user_id") == F.col("__owner")), "left")
    return joined.withColumn("goal_id", F.coalesce(F.col("__goal"), F.col("goal_id")) if "goal_id" in ledger.columns else F.col("__goal")).drop("__id", "__goal", "__owner")


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with `errors`: the names of the checks that fail or can't be decided."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return rows.withColumn("errors", failed)
