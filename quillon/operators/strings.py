"""String operators. Byte lengths and ranges, 64-bit counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.parsing import strict_int
from quillon.operators.generic import asked, expect, last_of, literal, upsert, without
from quillon.operators.keysview import keys_view
from quillon.sources.keyspace import Keyspace


def get(strings: DataFrame, key: str) -> DataFrame:
    return strings.where(F.col("key") == key).select("value")


def mget(strings: DataFrame, names: list[str]) -> DataFrame:
    """(pos, key, value) of the names asked; null for what is missing."""
    return asked(strings.sparkSession, names).join(strings.where(F.col("key").isin(names)), "key", "left").select("pos", "key", "value")


def mset(strings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The strings after SET, MSET: later pairs win. set_() also displaces keys of other types."""
    rows = literal(strings.sparkSession, [(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, pos int")
    return upsert(strings, last_of(rows, ["key"], "pos"), ["key"])


def setnx(strings: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """Sets where no key of any type exists."""
    new = literal(strings.sparkSession, [(key, value)], "key string, value string")
    return strings.unionByName(new.join(keys.select("key"), "key", "left_anti"))


def incr(strings: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(key, delta bigint), any number per key -> (key, value bigint): the counter
    after them. A missing one starts at 0; one that is no integer raises."""
    total = steps.groupBy("key").agg(F.sum("delta").alias("delta"))
    old = total.join(strings, "key", "left")
    number = F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.coalesce(strict_int(F.col("value")), F.raise_error(F.lit("value is not an integer"))))
    return old.select("key", (number.cast("bigint") + F.col("delta")).alias("value"))


def incrbyfloat(strings: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(key, delta double) -> (key, value double)."""
    total = steps.groupBy("key").agg(F.sum("delta").alias("delta"))
    return total.join(strings, "key", "left").select("key", (F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.col("delta")).alias("value"))


def appended(strings: DataFrame, parts: DataFrame) -> DataFrame:
    """parts(key, pos, text) -> (key, value, n): the strings with the parts behind them in
    order of pos, and their bytes."""
    tail = parts.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("tail"))
    value = F.concat(F.coalesce("value", F.lit("")), F.col("tail"))
    return tail.join(strings, "key", "left").select("key", value.alias("value"), F.octet_length(value).alias("n"))


def strlen(strings: DataFrame) -> DataFrame:
    return strings.select("key", F.octet_length("value").alias("n"))


def getrange(value: Column, start: int, stop: int) -> Column:
    """The inclusive slice; negative places count from the end."""
    n = F.length(value)
    low = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    high = F.greatest(F.lit(0), n + stop) if stop < 0 else F.least(F.lit(stop), n - 1)
    return F.when((low > high) | (low >= n), "").otherwise(F.substring(value, low + 1, high - low + 1))


def setrange(value: Column, offset: int, part: str) -> Column:
    """NUL-padded up to the offset, then overwritten."""
    padded = F.rpad(value, F.greatest(F.length(value), F.lit(offset)), F.lit("\0"))
    return F.overlay(padded, F.lit(part), F.lit(offset + 1))


def set_(ks: Keyspace, pairs: list[tuple[str, str]]) -> Keyspace:
    """SET, MSET on a keyspace: keys of any type are displaced, their expiry holds on."""
    return without(ks, [k for k, _ in pairs]).with_(strings=mset(ks.strings, pairs), meta=ks.meta)


def setex(ks: Keyspace, key: str, seconds: int, value: str, now_ms: int) -> Keyspace:
    """SET with an expiry."""
    if seconds < 0:
        raise ValueError("invalid expire time")
    due = literal(ks.meta.sparkSession, [(key, "string", now_ms + 1000 * seconds, None)], "key string, type string, expire_ms bigint, access_count bigint")
    ks = set_(ks, [(key, value)])
    return ks.with_(meta=upsert(ks.meta, due, ["key"]))


def getset(ks: Keyspace, key: str, value: str) -> tuple[DataFrame, Keyspace]:
    """(the old value, the new keyspace). A key of another type raises."""
    expect(keys_view(ks), key, "string")
    return get(ks.strings, key), set_(ks, [(key, value)])
