"""URL filters by a temporal list join, with DataFrame functions only.

List entries are dated: (list, key, action, at) adds a host, domain or URL
prefix to a list or removes it. `intervals` turns each key's history into
validity intervals [from, to); `evaluate` joins every capture, as of its fetch
time, with the entries that were active then. A capture matches by its host,
any parent domain of two labels or more, or any prefix of its path that ends
at a slash.

The join is on (key, month) with the interval as the rest of the condition:
intervals are listed under each month they touch, so neither a much captured
host nor a key with a long history is one group of the whole join, and Spark's
skew handling can split the captures of a hot key. Captures are counted first
(url, time), so repeated ones are looked up once; the html is never read.

Cases: a null or hostless url matches nothing and is allowed; a null time is
before everything and matches nothing. Entries with a null key, list, action or
time are ignored. Of entries of one key at one time, `remove` wins. Adding what
is active, or removing what isn't, changes nothing. Intervals that never end
reach to the last capture's month. Hosts compare in lower case, without a
trailing dot, user or port; a leading `www.` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The keys under which a URL may be listed: its host, parent domains, and host with path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(path_of(url), "/")
    depth = F.size(parts)
    paths = F.when(depth >= 2, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, active_from, active_to of every stretch in which a key is on a list."""
    known = entries.where("list is not null and key is not null and at is not null and action in ('add', 'remove')")
    # One state per key and time, then only where it changes.
    states = known.groupBy("list", "key", "at").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    order = W.partitionBy("list", "key").orderBy("at")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("`on` <> was")
    return (
        changes.withColumn("active_to", F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast("timestamp_ntz")))
        .where("`on` = 1").select("list", "key", F.col("at").alias("active_from"), "active_to")
    )


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (page_id, url, fetched_at) with lists (sorted names active at fetch time), n_entries and allowed."""
    counted = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    span = captures.agg(F.min(_month(F.col("fetched_at"))).alias("low"), F.max(_month(F.col("fetched_at"))).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    months = F.sequence(F.greatest(_month(F.col("active_from")), F.lit(low)), F.least(_month(F.col("active_to")), F.lit(high)))
    listed = (
        intervals(entries).where((_month(F.col("active_from")) <= high) & (_month(F.col("active_to")) >= low))
        .withColumn("month", F.explode(months))
    )
    asked = counted.withColumn("key", F.explode_outer(keys_of(F.col("url")))).withColumn("month", _month(F.col("fetched_at")))
    found = asked.alias("c").join(
        listed.alias("l"),
        (F.col("c.key") == F.col("l.key")) & (F.col("c.month") == F.col("l.month"))
        & (F.col("c.fetched_at") >= F.col("l.active_from")) & (F.col("c.fetched_at") < F.col("l.active_to")),
        "left",
    )
    verdict = found.groupBy("c.page_id", "c.url", "c.fetched_at", "c.copies").agg(
        F.array_join(F.sort_array(F.collect_set("l.list")), ",").alias("lists"), F.count("l.list").alias("n_entries")
    )
    return (
        verdict.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select("page_id", "url", "fetched_at", "lists", "n_entries", (F.col("n_entries") == 0).alias("allowed"))
    )
