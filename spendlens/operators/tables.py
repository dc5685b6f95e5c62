"""Ledgers as written tables, partitioned by month: a change rewrites the months it touches and no others.

A table is a folder of Parquet under the shared one, with the column `month`
(`yyyy-MM`, `none` for a null date) as its partitions and `batch`, the id of the
batch that wrote a row last. Applying a batch again gives the same table: `append`
replaces the rows that the batch had written, the others set rows by key. What
a change makes of the touched months is staged before it replaces them, so a
failure while staging leaves the table as it was, and one while replacing is
mended by applying the batch again. Batches are applied one after the other.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spendlens import shared

from . import writes

NONE = "none"


def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NONE))


class MonthTable:
    """A written ledger of rows of a schema; `date` names the column that months come from."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, date: str = "date"):
        self.spark, self.path, self.date = spark, path, date
        self.schema = StructType([*schema, StructField("batch", LongType()), StructField("month", StringType())])

    @classmethod
    def create(cls, rows: DataFrame, path: str | None = None, date: str = "date", batch: int = 0) -> MonthTable:
        table = cls(rows.sparkSession, path or shared.new_path(rows.sparkSession, "ledger"), rows.schema, date)
        table._write(table._keyed(rows, batch), "errorifexists")
        return table

    def _keyed(self, rows: DataFrame, batch: int) -> DataFrame:
        return rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("month", month_of(F.col(self.date)))

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Rows meet by month, so that a month is few files; a month of very many rows is split over tasks.
        rows.hint("rebalance", "month").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().drop("batch", "month")

    def files(self) -> DataFrame:
        """month, files: the names of each month's files, as text; a month that wasn't rewritten has the same."""
        files = self.read().select("month", F.regexp_extract(F.col("_metadata.file_name"), "[^/]+$", 0).alias("file")).distinct()
        return files.groupBy("month").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))

    def _replace(self, months: set[str], content: DataFrame) -> None:
        """The given months' rows become `content`."""
        if not months:
            return
        staged = shared.written(content, "staged")
        self._write(staged, "overwrite")
        left = {r.month for r in staged.select("month").distinct().collect()}
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for month in months - left:  # of these every row has gone
            gone = fs_path(f"{self.path}/month={month}")
            gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def _months(self, *sources: DataFrame) -> set[str]:
        """The months of some rows: as many as the calendar has, not as rows."""
        return {r.month for r in functools.reduce(DataFrame.unionByName, [s.select("month") for s in sources]).distinct().collect()}

    def _of(self, months: set[str]) -> DataFrame:
        return self.read().where(F.col("month").isin(sorted(months)))

    def _holding(self, keys: DataFrame, *names: str) -> DataFrame:
        return self.read().join(keys.select(*names).distinct(), list(names), "left_semi")

    def append(self, rows: DataFrame, batch: int) -> None:
        new = self._keyed(rows, batch)
        months = self._months(new)
        self._replace(months, self._of(months).where(F.col("batch") != batch).unionByName(new, allowMissingColumns=True))

    def append_new(self, rows: DataFrame, batch: int, *keys: str) -> None:
        """Appends rows whose natural key no other batch's row has; the keys must hold the date."""
        if self.date not in keys:
            raise ValueError(f"a natural key without {self.date} may lie in any month")
        new = self._keyed(rows, batch)
        months = self._months(new)
        self._replace(months, writes.append_new(self._of(months).where(F.col("batch") != batch), new, *keys))

    def upsert(self, changes: DataFrame, batch: int, *keys: str) -> None:
        """Inserts or replaces by key; `changes` have a seq, and the last of a key counts. A changed date moves the row."""
        new = self._keyed(writes.last_per_key(changes, *keys), batch)
        months = self._months(new, self._holding(new, *keys))
        kept = self._of(months).join(new.select(*keys), list(keys), "left_anti")
        self._replace(months, kept.unionByName(new, allowMissingColumns=True))

    def patch(self, patches: DataFrame, batch: int, key: str, touched: Column | None = None) -> None:
        """Sets only the fields that a patch names (see `writes.patch`)."""
        columns = self.read().columns
        old = self._holding(patches, key)
        rows = writes.patch(old.drop("batch", "month"), patches, key, touched)
        new = self._keyed(rows, batch).select(*columns)
        months = self._months(old, new)
        kept = self._of(months).join(patches.select(key).distinct(), key, "left_anti")
        self._replace(months, kept.unionByName(new))

    def delete(self, gone: DataFrame, *keys: str) -> None:
        months = self._months(self._holding(gone, *keys))
        self._replace(months, writes.delete(self._of(months), gone, *keys))
