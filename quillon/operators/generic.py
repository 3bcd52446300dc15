"""Upserts, removals and renames that all tables share; every function is lazy and gives new tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.keyspace import Keyspace


class WrongType(TypeError):
    """A key holds another type than the operator takes."""


def ping(spark: SparkSession, message: str = "PONG") -> DataFrame:
    """One row: the message."""
    return literal(spark, [(message,)], "reply string")


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def asked(spark: SparkSession, names: Iterable[str], column: str = "key") -> DataFrame:
    """(pos, column): the arguments of a command in order."""
    return literal(spark, list(enumerate(names)), f"pos int, {column} string")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """new's rows instead of old's with the same ``on``; new must not repeat them."""
    return old.join(new.select(*on), on, "left_anti").unionByName(new.select(*old.columns))


def last_of(rows: DataFrame, on: list[str], order: str) -> DataFrame:
    """Of rows with the same ``on`` the one with the largest ``order`` (last writer wins)."""
    rest = [c for c in rows.columns if c not in (*on, order)]
    best = rows.groupBy(*on).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), order).alias("row"))
    return best.select(*on, *(F.col(f"row.{c}") for c in rest))


def without(ks: Keyspace, names: Iterable[str]) -> Keyspace:
    """DEL: no table has the keys any more."""
    names = list(names)
    return ks.with_(**{t: df.where(~F.col("key").isin(names)) for t, df in ks.tables().items() if t != "meta"}, meta=ks.meta.where(~F.col("key").isin(names)))


def rename(ks: Keyspace, old: str, new: str, keep_existing: bool = False, keys: DataFrame | None = None) -> Keyspace:
    """RENAME old new: new is overwritten, the expiry is not carried along. With
    keep_existing (RENAMENX) nothing changes where new exists, by the keys view."""
    if keep_existing and keys is not None and keys.where(F.col("key") == new).limit(1).count():
        return ks
    moved = {}
    for t, df in ks.tables().items():
        if t == "meta":
            moved[t] = df.where(~F.col("key").isin(old, new))
        else:
            moved[t] = df.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key")))
    return ks.with_(**moved)


def expect(keys: DataFrame, key: str, kind: str) -> None:
    """Raises WrongType where the key has another type."""
    row = keys.where(F.col("key") == key).select("type").first()
    if row and row[0] != kind:
        raise WrongType(f"WRONGTYPE {key} holds a {row[0]}")
