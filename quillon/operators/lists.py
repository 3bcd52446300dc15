"""List operators over (key, idx, value), idx from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.parsing import list_bounds
from quillon.operators.generic import literal


def _sized(lists: DataFrame) -> DataFrame:
    """With n, each list's length: one partial aggregation and a join, no window."""
    return lists.join(lists.groupBy("key").agg(F.count("*").alias("n")), "key")


def _reindexed(lists: DataFrame, order: str = "idx") -> DataFrame:
    place = F.row_number().over(W.partitionBy("key").orderBy(order)) - 1
    return lists.select("key", place.cast("bigint").alias("idx"), "value")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("n"))


def push(lists: DataFrame, key: str, values: list[str], left: bool) -> DataFrame:
    """LPUSH (each value in front of the one before) or RPUSH."""
    spark = lists.sparkSession
    schema = "key string, idx bigint, value string"
    if left:
        new = literal(spark, [(key, i, v) for i, v in enumerate(reversed(values))], schema)
        moved = lists.withColumn("idx", F.when(F.col("key") == key, F.col("idx") + len(values)).otherwise(F.col("idx")))
        return moved.unionByName(new)
    n = lists.where(F.col("key") == key).count()
    return lists.unionByName(literal(spark, [(key, n + i, v) for i, v in enumerate(values)], schema))


def pop(lists: DataFrame, key: str, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pos, value) of what goes, nearest the end first, and the table without it."""
    mine = _sized(lists.where(F.col("key") == key))
    pos = F.col("idx") if left else F.col("n") - 1 - F.col("idx")
    gone = mine.where(pos < count).select(pos.alias("pos"), "key", "idx", "value")
    rest = lists.join(gone.select("key", "idx"), ["key", "idx"], "left_anti")
    return gone.select("pos", "value"), _reindexed(rest) if left else rest


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """The inclusive slice of every list. Where no bound counts from the end, no lengths are needed."""
    if start >= 0 and stop >= 0:
        return lists.where(F.col("idx").between(start, stop))
    low, high = list_bounds(F.col("n"), start, stop)
    return _sized(lists).where(F.col("idx").between(low, high)).select(*lists.columns)


def lindex(lists: DataFrame, index: int) -> DataFrame:
    if index >= 0:
        return lists.where(F.col("idx") == index).select("key", "value")
    return _sized(lists).where(F.col("idx") == F.col("n") + index).select("key", "value")


def lset(lists: DataFrame, key: str, index: int, value: str) -> DataFrame:
    n = lists.where(F.col("key") == key).count()
    at = n + index if index < 0 else index
    if not 0 <= at < n:
        raise IndexError("index out of range")
    return lists.withColumn("value", F.when((F.col("key") == key) & (F.col("idx") == at), F.lit(value)).otherwise(F.col("value")))


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Every list cut to the slice, with new places."""
    return _reindexed(lrange(lists, start, stop))


def lrem(lists: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first count occurrences, the last -count, or, for 0, all."""
    if not count:
        return _reindexed(lists.where(F.col("value") != value))
    order = F.col("idx") if count > 0 else F.col("idx").desc()
    hits = lists.where(F.col("value") == value).withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(order)))
    return _reindexed(lists.join(hits.where(F.col("r") <= abs(count)).select("key", "idx"), ["key", "idx"], "left_anti"))


def linsert(lists: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """The value beside the first pivot of each list that has it."""
    at = lists.where(F.col("value") == pivot).groupBy("key").agg(F.min("idx").alias("at"))
    new = at.select("key", (F.col("at") + F.lit(-0.5 if before else 0.5)).alias("idx"), F.lit(value).alias("value"))
    return _reindexed(lists.withColumn("idx", F.col("idx").cast("double")).unionByName(new))


def lpos(lists: DataFrame, value: str) -> DataFrame:
    return lists.where(F.col("value") == value).groupBy("key").agg(F.min("idx").alias("idx"))
