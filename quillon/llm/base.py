"""Shared folder, lineage cuts and table access of the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import drop, place, shared, written

__all__ = ["BATCH", "HEAVY", "drop", "lean", "mapped", "parts", "place", "release", "released", "shared", "spread", "table", "tune", "written"]
#: Bytes that cross to Python at once (a single longer row crosses whole).
BATCH = 4 << 20
#: Keys of more than this share of the rows are joined by broadcast.
HEAVY = 4096


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as a row can hold a text of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def spread(rows: DataFrame, classes: DataFrame, keys: list[str], by: str, size: str = "size") -> DataFrame:
    """rows left join classes on the keys. classes, a written table, has a row for each key, and
    how many of the rows have it (``size``). Keys with more than one in HEAVY of all rows, of
    which there are less than HEAVY, are broadcast, and their rows spread by a hash of the
    column ``by``; so no key, however common, sends its rows to one task."""
    total = classes.agg(F.sum(size)).first()[0] or 0
    rest = [c for c in classes.columns if c not in keys]
    heavy = F.col(size) * HEAVY > total
    few = classes.where(heavy).select(*keys, F.struct(*rest).alias("_few"))
    many = classes.where(~heavy).select(*keys, F.struct(*rest).alias("_many"), F.lit(0).cast("long").alias("_salt"))
    rows = rows.join(F.broadcast(few), keys, "left")
    lone = F.col("_few").isNull()
    for key in keys:  # null finds nothing, but would all go one way
        lone = lone & F.col(key).isNotNull()
    rows = rows.withColumn("_salt", F.when(lone, 0).otherwise(1 + F.pmod(F.xxhash64(by), F.lit(HEAVY))).cast("long"))
    rows = rows.join(many, [*keys, "_salt"], "left").withColumn("_one", F.coalesce("_few", "_many"))
    return rows.select("*", *(F.col(f"_one.{c}").alias(c) for c in rest)).drop("_few", "_many", "_one", "_salt")


def release() -> None:
    """Gives memory back to the system, as Spark keeps workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """run, for applyInArrow: memory is given back behind each group."""

    def group(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            release()

    # Spark counts the parameters
    return (lambda a: group(a)) if run.__code__.co_argcount == 1 else (lambda a, b: group(a, b))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, whose workers give their memory back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)
