"""What has landed, read from the files themselves: no ledger is kept beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Name of a work unit wherever it stands in a path: first and last day.
UNIT = r"([0-9]{8}_[0-9]{8})"


def unit_name(path: Column) -> Column:
    """The work unit that a path names, in a folder or the file's own name; null without one."""
    found = F.regexp_extract(path, UNIT + r"[^0-9][^_]*", 1)
    return F.when(found != "", found)


def landed_files(spark: SparkSession, path: str, suffix: str = "*.parquet", schema: StructType | str | None = None) -> DataFrame:
    """(file_path, n_bytes, n_rows, first_time, last_time) of the files under ``path`` that hold rows.

    Only the time column is read.  Files with another suffix are not looked at; a file that cannot be read, or has no rows, has not landed.
    """
    reader = spark.read.option("pathGlobFilter", suffix).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = (reader.schema(schema) if schema else reader).parquet(path)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file_path"))
    return files.agg(F.first("_metadata.file_size").alias("n_bytes"), F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def landed_units(files: DataFrame) -> DataFrame:
    """(chunk_name, n_files, n_rows, first_time, last_time) of the work units that files belong to."""
    named = files.withColumn("chunk_name", unit_name(F.col("file_path"))).where("chunk_name IS NOT NULL")
    return named.groupBy("chunk_name").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
