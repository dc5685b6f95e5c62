"""Bank statements: texts to transactions by three parsers, the first that finds more than two rows (else the last).

A statement's lines are an array, and each parser is an expression over it, so
that parsing moves no row to another task; the block parser cuts the array at its
date lines. A null text has no lines. Dates that don't exist stay as text with a
null `date` and count as skipped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, functions as F

from spendlens import shared
from spendlens.functions import dates, numbers, text

from .tables import MonthTable

SINGLE, BLOCK, GENERIC = 1, 2, 3
ENOUGH = 2
# How banks write a line, the first line of a block, its amounts, and a line of any layout.
_SINGLE = r"^([0-9]{2}/[0-9]{2}/[0-9]{4})\s+(.+?)\s+([-+]?[0-9][0-9.,]+)\s+([-+]?[0-9][0-9.,]+)?$"
_OPENS = r"^([0-9]{2}/[0-9]{2}/[0-9]{4})\s+[0-9]+\s+"
_AMOUNTS = r"^(-?[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})\s+([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})\s*$"
_GENERIC = r"([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})\s+(.{3,60}?)\s+([-+]?[0-9.]+[,0-9]*|[0-9]+,[0-9]{2})"
_TRIM = r"^[\s ]+|[\s ]+$"


def lines_of(text: Column) -> Column:
    """array<struct<line_no, line>>: the trimmed lines with something in them."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line_no"), F.regexp_replace(line, _TRIM, "").alias("line")))
    return F.filter(numbered, lambda l: l["line"] != "")


def _found(r: Column, parser: int, debit: Column) -> Column:
    return F.struct(
        r["line_no"].alias("line_no"), F.lit(parser).alias("parser"), r["day"].alias("day"), r["description"].alias("description"),
        F.abs(r["signed"]).alias("amount"), F.when(debit, "debit").otherwise("credit").alias("type"), r["raw_text"].alias("raw_text"),
    )


def _read_all(lines: Column, pattern: str) -> Column:
    """The lines' parts. They are cut out first: what is made of a part within a lambda is made again wherever it is named."""
    part = lambda l, i: F.regexp_extract(l["line"], pattern, i)
    cut = F.transform(lines, lambda l: F.struct(l.alias("l"), part(l, 1).alias("day"), part(l, 2).alias("named"), part(l, 3).alias("number")))
    return F.transform(cut, lambda c: F.struct(
        c["l"]["line_no"].alias("line_no"), c["day"].alias("day"), text.clean_description(c["named"]).alias("description"), numbers.parse_amount(c["number"]).alias("signed"),
        c["number"].startswith("-").alias("minus"), c["l"]["line"].alias("raw_text"),
    ))


def single_line(lines: Column) -> Column:
    rows = _read_all(F.filter(lines, lambda l: l["line"].rlike(_SINGLE)), _SINGLE)
    return F.transform(F.filter(rows, lambda r: r["signed"] != 0), lambda r: _found(r, SINGLE, r["signed"] < 0))


def opening_lines(lines: Column) -> Column:
    """Where blocks begin: places in the array, from 0."""
    return F.filter(F.transform(lines, lambda l, i: F.when(l["line"].rlike(_OPENS), i)), lambda i: i.isNotNull())


def block(lines: Column, opens: Column) -> Column:
    ends = lambda k: F.coalesce(F.get(opens, k + 1), F.size(lines))
    cut = F.transform(opens, lambda i, k: F.struct(F.get(lines, i).alias("head"), F.slice(lines, i + 2, ends(k) - i - 1).alias("rest")))
    placed = F.transform(cut, lambda b: F.struct(b["head"].alias("head"), b["rest"].alias("rest"), F.array_max(F.transform(b["rest"], lambda l, j: F.when(l["line"].rlike(_AMOUNTS), j))).alias("last")))
    bare = lambda l: F.regexp_replace(l["line"], r"\s+-\s*$", "")

    def read(b: Column) -> Column:
        named = F.filter(F.transform(F.slice(b["rest"], 1, b["last"]), bare), lambda n: (n != "") & (n != "-"))
        return F.struct(
            b["head"]["line_no"].alias("line_no"), F.regexp_extract(b["head"]["line"], _OPENS, 1).alias("day"), text.clean_description(F.array_join(named, " ")).alias("description"),
            numbers.parse_amount(F.regexp_extract(F.get(b["rest"], b["last"])["line"], _AMOUNTS, 1)).alias("signed"), F.array_join(F.transform(b["rest"], lambda l: l["line"]), " ").alias("raw_text"),
        )

    rows = F.transform(F.filter(placed, lambda b: b["last"].isNotNull()), read)
    return F.transform(F.filter(rows, lambda r: (r["signed"] != 0) & (F.length(r["description"]) >= 3)), lambda r: _found(r, BLOCK, r["signed"] < 0))


def generic(lines: Column) -> Column:
    rows = _read_all(F.filter(lines, lambda l: F.length(l["line"]).between(15, 200) & l["line"].rlike(_GENERIC)), _GENERIC)
    return F.transform(F.filter(rows, lambda r: (r["signed"] != 0) & (F.length(r["description"]) >= 3)), lambda r: _found(r, GENERIC, (r["signed"] < 0) | r["minus"]))


def parse(statements: DataFrame, as_of: dt.date) -> DataFrame:
    """Transactions of each statement (doc_id, text): the rows of one parser, with date (null if impossible) and category."""
    enough = lambda c: F.size(c) > ENOUGH
    lines = statements.select("doc_id", lines_of(F.col("text")).alias("lines"))
    lines = lines.select("doc_id", "lines", opening_lines(F.col("lines")).alias("opens"))
    banks = lines.select("doc_id", "lines", single_line(F.col("lines")).alias("single"), block(F.col("lines"), F.col("opens")).alias("block"))
    chosen = F.when(enough("single"), F.col("single")).when(enough("block"), F.col("block")).otherwise(generic(F.col("lines")))
    found = banks.select("doc_id", F.explode(chosen).alias("r"))
    rows = found.select("doc_id", "r.line_no", "r.parser", dates.parse_date(F.col("r.day"), F.lit(as_of)).alias("date_text"), "r.description", "r.amount", "r.type", "r.raw_text")
    return rows.withColumn("date", F.try_to_date("date_text", "yyyy-MM-dd")).withColumn("category", text.upload_category(F.col("description")))


def counters(parsed: DataFrame) -> DataFrame:
    """Per statement: rows in all, inserted (with a possible date) and skipped."""
    return parsed.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("date").alias("inserted"), F.count_if(F.col("date").isNull()).alias("skipped"))


def found_subscriptions(parsed: DataFrame) -> DataFrame:
    """doc_id, name, amount, last_charged: the known merchants among a statement's debits, each with its latest charge.

    Of charges on one day the first line counts. A charge without a possible date
    is later than none: if it is a merchant's first, it stays.
    """
    debits = parsed.where("type = 'debit'").withColumn("name", text.merchant(F.col("description"))).where("name is not null")
    grouped = debits.groupBy("doc_id", "name").agg(
        F.min_by(F.struct("amount", "date"), "line_no").alias("first"), F.max_by(F.struct("amount", "date"), F.when(F.col("date").isNotNull(), F.struct("date", -F.col("line_no")))).alias("latest")
    )
    of = F.when(F.col("first.date").isNull(), F.col("first")).otherwise(F.col("latest"))
    return grouped.select("doc_id", "name", of.alias("c")).select("doc_id", "name", "c.amount", F.col("c.date").alias("last_charged"))


def ingest(parsed: DataFrame, ledger: MonthTable, subscriptions: str, batch: int) -> dict[str, int]:
    """Appends a batch of parsed statements to a written ledger and what subscriptions they show to a folder of batches.

    The counts (total, inserted, skipped, subscriptions) are observed in the passes
    that write the rows, so nothing is read again for them. A repeated batch
    replaces what it wrote.
    """
    rows, found = Observation(f"rows-{batch}"), Observation(f"subscriptions-{batch}")
    read = parsed.observe(rows, F.count(F.lit(1)).alias("total"), F.count("date").alias("inserted"), F.count_if(F.col("date").isNull()).alias("skipped"))
    staged = shared.written(read, "parsed")
    ledger.append(staged.where("date is not null").select(*ledger.rows().columns), batch)
    found_subscriptions(staged).observe(found, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{subscriptions}/batch={batch}")
    return {**rows.get, "subscriptions": found.get["n"]}
