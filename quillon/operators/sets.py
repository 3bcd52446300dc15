"""Set operators over (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.generic import asked, literal


def sadd(sets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, member): (the new table, (key, added))."""
    new = rows.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")
    return sets.unionByName(new), new.groupBy("key").agg(F.count("*").alias("added"))


def srem(sets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, member): (the new table, (key, removed))."""
    rows = rows.select("key", "member").distinct()
    return sets.join(rows, ["key", "member"], "left_anti"), sets.join(rows, ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("removed"))


def smembers(sets: DataFrame, key: str) -> DataFrame:
    return sets.where(F.col("key") == key).select("member")


def sismember(sets: DataFrame, key: str, members: list[str]) -> DataFrame:
    """(pos, member, found) of each member asked."""
    mine = sets.where((F.col("key") == key) & F.col("member").isin(members)).select("member", F.lit(1).alias("hit"))
    return asked(sets.sparkSession, members, "member").join(mine, "member", "left").select("pos", "member", F.coalesce("hit", F.lit(0)).alias("found"))


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("n"))


def sunion(sets: DataFrame, names: list[str]) -> DataFrame:
    """Members of any of the sets; missing ones are empty."""
    return sets.where(F.col("key").isin(names)).select("member").distinct()


def sinter(sets: DataFrame, names: list[str]) -> DataFrame:
    """Members of all: one pass and one aggregation, however many sets."""
    names = sorted(set(names))
    hits = sets.where(F.col("key").isin(names)).groupBy("member").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(names)).select("member")


def sdiff(sets: DataFrame, names: list[str]) -> DataFrame:
    """Members of the first and none of the others: one pass and one aggregation."""
    first, rest = names[0], names[1:]
    hits = sets.where(F.col("key").isin(names)).groupBy("member").agg(F.max(F.col("key") == first).alias("mine"), F.max(F.col("key").isin(rest) if rest else F.lit(False)).alias("others"))
    return hits.where(F.col("mine") & ~F.col("others")).select("member")


def rows(sets: DataFrame, key: str, members: list[str]) -> DataFrame:
    return literal(sets.sparkSession, [(key, m) for m in members], "key string, member string")
