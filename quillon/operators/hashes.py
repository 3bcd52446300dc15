"""Field maps over (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.parsing import strict_int
from quillon.operators.generic import asked, last_of, upsert


def hset(hashes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, field, value, pos): later rows win. (The new table, (key, added))."""
    new = last_of(rows, ["key", "field"], "pos")
    added = new.join(hashes, ["key", "field"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))
    return upsert(hashes, new, ["key", "field"]), added


def hsetnx(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(key, field, value): only fields that don't exist."""
    return hashes.unionByName(rows.select("key", "field", "value").join(hashes, ["key", "field"], "left_anti"))


def hget(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.where(F.col("field") == field).select("key", "value")


def hmget(hashes: DataFrame, key: str, names: list[str]) -> DataFrame:
    mine = hashes.where((F.col("key") == key) & F.col("field").isin(names)).select("field", "value")
    return asked(hashes.sparkSession, names, "field").join(mine, "field", "left").select("pos", "field", "value")


def hgetall(hashes: DataFrame) -> DataFrame:
    """(key, fields MAP)."""
    return hashes.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hkeys(hashes: DataFrame, key: str) -> DataFrame:
    return hashes.where(F.col("key") == key).select("field")


def hvals(hashes: DataFrame, key: str) -> DataFrame:
    return hashes.where(F.col("key") == key).select("value")


def hdel(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    return hashes.join(rows.select("key", "field").distinct(), ["key", "field"], "left_anti")


def hexists(hashes: DataFrame, key: str, field: str) -> DataFrame:
    return hashes.where((F.col("key") == key) & (F.col("field") == field)).agg(F.count("*").alias("found"))


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("n"))


def hincrby(hashes: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(key, field, delta bigint) -> (key, field, value bigint); what is no integer counts as 0."""
    total = steps.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    old = F.coalesce(strict_int(F.col("value")), F.lit(0))
    return total.join(hashes, ["key", "field"], "left").select("key", "field", (old + F.col("delta")).cast("bigint").alias("value"))


def hincrbyfloat(hashes: DataFrame, steps: DataFrame) -> DataFrame:
    total = steps.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    return total.join(hashes, ["key", "field"], "left").select("key", "field", (F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.col("delta")).alias("value"))


def hscan(hashes: DataFrame, cursor: int, count: int = 10) -> DataFrame:
    """(key, pos, field, value): a page of each map, in order of fields."""
    pos = F.row_number().over(W.partitionBy("key").orderBy("field")) - 1
    return hashes.withColumn("pos", pos).where((F.col("pos") >= cursor) & (F.col("pos") < cursor + count)).select("key", "pos", "field", "value")
