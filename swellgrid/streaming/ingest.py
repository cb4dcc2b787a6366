"""Restartable ingest of observation files into a table of months: every row once, whatever the order of arrival."""

from __future__ import annotations

import math
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CELL, KEYS
from ..sources.observations import in_box, nan_to_null

#: Directories of the target, by the time of the row.
MONTHS = ("year", "month")
#: Rows of a month that one task sorts and writes.
ROWS_PER_PIECE = 1_000_000


def clean_rows(rows: DataFrame, box: dict[str, float] | None = None) -> DataFrame:
    """Box filter and NaN to NULL; a row without a time or a cell is no observation and goes."""
    out = nan_to_null(rows).dropna(subset=list(KEYS))
    return out.where(in_box(**box)) if box else out


def merge_rows(held: DataFrame, new: DataFrame, order: Sequence[str] = (), pieces: int = 1) -> DataFrame:
    """One row for each time and cell of two tables of the same columns: the least by ``order``, and without one the held row.

    All rows are shuffled once, by month and by ``pieces`` groups of cells in each, and come out that way with the columns of
    ``MONTHS``, sorted as the table is written.  ``held`` has each key once.
    """
    place = ["arrived_", *order] if not order else [*order, "arrived_"]
    both = held.withColumn("arrived_", F.lit(0)).unionByName(new.withColumn("arrived_", F.lit(1)))
    both = both.withColumns({"year": F.year("time"), "month": F.month("time"), "piece_": F.pmod(F.xxhash64(*CELL), F.lit(pieces))}).repartition(*MONTHS, "piece_")
    first = F.row_number().over(Window.partitionBy(*MONTHS, "piece_", *KEYS).orderBy(*place))
    return both.withColumn("place_", first).where("place_ = 1").select(*new.columns, *MONTHS)


class MonthTable:
    """A Parquet table partitioned by year and month, of which whole months are replaced.

    A replacement is written beside the table first.  Once it is complete, its months are moved over those of the table
    one by one, which can be done again from where it stopped; so an ingest that dies at any point loses no row
    and leaves none twice when its batch is run again.  A reader in between can miss a month that is being moved.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop_path(self, path: str) -> JavaObject:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._hadoop_path(path))

    def _folders(self, path: str) -> list[str]:
        found = self._fs.listStatus(self._hadoop_path(path)) if self._exists(path) else []
        return sorted(s.getPath().getName() for s in found if s.isDirectory() and "=" in s.getPath().getName())

    def months(self, path: str | None = None) -> list[tuple[int, int]]:
        """(year, month) of the directories of the table, or of another path."""
        path = path or self.path
        return [(int(y.split("=")[1]), int(m.split("=")[1])) for y in self._folders(path) for m in self._folders(f"{path}/{y}")]

    def read(self, schema: StructType, months: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """Rows of the table, or of some of its months: only their directories are listed and read."""
        wanted = self.months() if months is None else sorted(set(months) & set(self.months()))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/year={y}/month={m}" for y, m in wanted]) if months is not None else reader.parquet(self.path).select(schema.names)

    def staged(self, batch: int) -> str:
        return f"{self.path}/_staged/{batch}"

    def stage(self, rows: DataFrame, batch: int) -> None:
        """Write the months of ``rows`` (see ``merge_rows``), whole, beside the table: a file for each piece of a month at most, small pieces share one."""
        rows.write.mode("overwrite").partitionBy(*MONTHS).parquet(self.staged(batch))

    def is_staged(self, batch: int) -> bool:
        return self._exists(f"{self.staged(batch)}/_SUCCESS")

    def replace(self, batch: int) -> None:
        """Move the staged months of a batch over those of the table."""
        staged = self.staged(batch)
        for y, m in self.months(staged):
            new, old = self._hadoop_path(f"{staged}/year={y}/month={m}"), self._hadoop_path(f"{self.path}/year={y}/month={m}")
            self._fs.mkdirs(old.getParent())
            self._fs.delete(old, True)
            if not self._fs.rename(new, old):
                raise OSError(f"cannot move {new} to {old}")
        self._fs.delete(self._hadoop_path(staged), True)


def upsert(rows: DataFrame, batch: int, table: MonthTable, order: Sequence[str] = (), box: dict[str, float] | None = None) -> None:
    """Merge a batch of raw rows into the months that it touches.  A second call for the same batch changes nothing.

    Which months these are comes to the driver, at most one row for each month of the calendar that the batch has.  The month
    with most rows, held and new, says in how many pieces months are written.
    """
    if not table.is_staged(batch):
        new = clean_rows(rows, box)
        at = {(r["y"], r["m"]): r["count"] for r in new.groupBy(F.year("time").alias("y"), F.month("time").alias("m")).count().collect()}
        if not at:
            return
        held = table.read(new.schema, list(at))
        for r in held.groupBy(F.year("time").alias("y"), F.month("time").alias("m")).count().collect():
            at[r["y"], r["m"]] += r["count"]
        table.stage(merge_rows(held, new, order, math.ceil(max(at.values()) / ROWS_PER_PIECE)), batch)
    table.replace(batch)


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, box: dict[str, float] | None = None, order: Sequence[str] = (), files_per_batch: int = 1000
) -> None:
    """Merge what is new under ``source`` into ``target``, and return when done.

    Files may come late, in any order, and again under another name: of the rows of one time and cell the
    least by ``order`` stays, over all files ever taken.  A second call takes only new files; the checkpoint is the ledger.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, batch: upsert(rows, batch, MonthTable(rows.sparkSession, target), order, box)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
