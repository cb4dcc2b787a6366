"""Shared helpers: scratch tables, bounded filters, exact order statistics."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter for each key, and at most (16 MB): beyond, rows are joined without one.
FILTER_BITS_PER_KEY, MAX_FILTER_BITS = 10, 1 << 27


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; where that is unset, a temp folder on a local master and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
        shared = spark.sparkContext.getCheckpointDir()
    return shared.rstrip("/")


#: Rows of an Arrow batch while texts are handled: batches count rows, and texts are long.
ARROW_ROWS = 1000
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Within it, jobs exchange at most ``rows`` rows at a time with Python; the setting is put back after."""
    before = spark.conf.get(_ARROW_ROWS_KEY)
    given = int(before)
    spark.conf.set(_ARROW_ROWS_KEY, str(min(given, rows) if given > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS_KEY, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors cost nothing afterwards, since readers only need the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _SCRATCH.add(path)
    table.scratch_path = path
    return table


#: Scratch tables of this process that are still there.
_SCRATCH: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("scratch_path", None)
        if path:
            _delete(table.sparkSession, path)
            _SCRATCH.discard(path)


def scratch_tables() -> frozenset[str]:
    """Paths of the scratch tables of this process that are still there."""
    return frozenset(_SCRATCH)


def release_scratch(spark: SparkSession, keep: Iterable[DataFrame] = (), since: frozenset[str] = frozenset()) -> int:
    """Delete the scratch tables of this process, once what needs them is written; gives their number.

    ``keep`` are tables to leave, and ``since`` an earlier ``scratch_tables()``, of which all are left.
    """
    paths = _SCRATCH - since - {t.__dict__.get("scratch_path") for t in keep}
    for path in paths:
        _delete(spark, path)
    _SCRATCH.difference_update(paths)
    return len(paths)


def quoted(column: str) -> str:
    """A column name that may hold dots, as ``F.col`` takes it."""
    return "`" + column.replace("`", "``") + "`"


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitively)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def _bits(n: int) -> int:
    """Bits of a filter of ``n`` keys: a power of two."""
    return max(1 << 12, 1 << max(0, FILTER_BITS_PER_KEY * n - 1).bit_length())


def membership_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """One row with ``words``: a bitmap of the hashed keys, ``bits / 64`` longs.

    A key that was put in always hits; others hit with a chance of the bitmap's fill.
    """
    pos = F.pmod(F.xxhash64(key), F.lit(bits))
    put = keys.select(pos.alias("p")).selectExpr("cast(p div 64 as int) AS w", "shiftleft(1L, cast(p % 64 as int)) AS b")
    none = keys.sparkSession.range(bits // 64).selectExpr("cast(id as int) AS w", "0L AS b")
    words = none.unionByName(put).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def may_contain(words: Column, key: Column, bits: int) -> Column:
    """Whether ``key`` may be among the keys of a ``membership_filter``."""
    pos = F.pmod(F.xxhash64(key), F.lit(bits))
    word = F.element_at(words, ((pos / 64).cast("int") + 1))
    return F.getbit(word, (pos % 64).cast("int")) == 1


def flag_members(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, flag: str) -> DataFrame:
    """Add ``flag``: false only where ``key`` is surely not among ``keys`` (a materialised table with the key ``keys_key``).

    A bitmap of ``FILTER_BITS_PER_KEY`` bits a key is broadcast for it; with so many keys that it
    would exceed ``MAX_FILTER_BITS`` every row is flagged, and the join that follows settles them all.
    """
    bits = _bits(keys.count())
    if bits > MAX_FILTER_BITS:
        return df.withColumn(flag, F.lit(True))
    words = free_name(df.columns, "words_")
    marked = df.crossJoin(F.broadcast(membership_filter(keys, keys_key, bits).withColumnRenamed("words", words)))
    return marked.withColumn(flag, F.coalesce(may_contain(F.col(words), key, bits), F.lit(False))).drop(words)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048) -> float | None:
    """Exact k-th largest non-null value of a double column (k >= 1), or None if there are fewer.

    Each round counts ``bins`` equal slices of the interval that holds the value;
    only those counts come to the driver.  Ends when the interval holds one value.
    """
    v = F.col(column)
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if n < k or k < 1:
        return None
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            width = hi - lo
        slot = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        rows = (
            df.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
            .groupBy(slot.alias("s"))
            .agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
            .collect()
        )
        for r in sorted(rows, key=lambda r: -r["s"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo
