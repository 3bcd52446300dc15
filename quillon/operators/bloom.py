"""Bloom filters: deterministic, keyed, and packed.

A filter of m bits and k hashes sets, for each item, the bits (h1 + i * h2) mod m for
i < k. Bits are a table (key, word, bits) with 64 of them in a row, merged by bit_or in
part before the shuffle; so a filter costs what its bits cost, however many items it has.
An item is reported where all of its bits are set.

An item makes k rows, one for each bit. Spark joins small partitions by the bytes that it
shuffled, before it knows of those rows, so items are dealt to a fixed number of tasks
before they make them, whatever their keys, and the rows again by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.generic import literal

BITS = "key string, word bigint, bits bigint"
#: Shape of a filter that BF.ADD makes.
CAPACITY, RATE = 1_000_000, 0.01
#: Name of the one filter of build() and probe(), and of the row of its bits that holds its capacity.
ONE, SIZE = "", "#capacity"


def clamp(capacity: int, fpr: float = RATE) -> tuple[int, float]:
    return max(10, capacity), min(0.5, max(1e-4, fpr))


def shape(capacity: int, fpr: float) -> tuple[int, int]:
    """(m, k): the best number of bits, 8 at least, and of hashes, 1 to 32."""
    capacity, fpr = clamp(capacity, fpr)
    m = max(8, math.ceil(-capacity * math.log(fpr) / math.log(2) ** 2))
    return m, min(32, max(1, math.ceil(-math.log2(fpr))))


def shapes(capacity: Column, fpr: Column) -> tuple[Column, Column]:
    """The same of columns."""
    capacity, fpr = F.greatest(F.lit(10), capacity), F.least(F.lit(0.5), F.greatest(F.lit(1e-4), fpr))
    m = F.greatest(F.lit(8), F.ceil(-capacity * F.log(fpr) / F.pow(F.log(F.lit(2.0)), F.lit(2))))
    return m.cast("bigint"), F.least(F.lit(32), F.greatest(F.lit(1), F.ceil(-F.log2(fpr)))).cast("int")


def positions(item: Column, m: Column, k: Column) -> Column:
    a, b = F.pmod(F.xxhash64(item), m), F.pmod(F.hash(item).cast("bigint"), m)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.pmod(a + i.cast("bigint") * b, m))


def _tasks(df: DataFrame) -> int:
    """A quarter of the shuffle partitions, or 64 of more: each task writes a file for each of the next ones."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(n, 64), n // 4)


def _words(items: DataFrame, blooms: DataFrame) -> DataFrame:
    """items(key, item) -> (part, key, item, word, bits), a row for each bit of each different
    item, and one without a word for an item that has no filter. A part is in one task, and
    there are eight for each task, so that tasks are alike."""
    m, k = shapes(F.col("capacity"), F.col("fpr"))
    part = F.pmod(F.xxhash64("key", "item"), F.lit(8 * _tasks(items))).cast("int")
    shaped = items.select("key", "item").join(blooms.select("key", "capacity", "fpr"), "key", "left").withColumn("part", part)
    at = F.when(F.col("capacity").isNotNull(), positions(F.col("item"), m, k))
    rows = shaped.repartition(_tasks(items), "part").distinct().select("part", "key", "item", F.explode_outer(at).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    return rows.select("part", "key", "item", F.floor(F.col("at") / 64).alias("word"), bit.alias("bits"))


def _merged(bits: DataFrame) -> DataFrame:
    return bits.repartition(_tasks(bits), "key", "word").groupBy("key", "word").agg(F.bit_or("bits").alias("bits"))


def _bits(items: DataFrame, blooms: DataFrame) -> DataFrame:
    """The bits of the items, merged within each part."""
    return _words(items, blooms).where("word is not null").groupBy("part", "key", "word").agg(F.bit_or("bits").alias("bits")).select("key", "word", "bits")


def reserve(blooms: DataFrame, key: str, capacity: int, fpr: float = RATE) -> DataFrame:
    """BF.RESERVE."""
    if capacity <= 0 or not 0 < fpr < 1:
        raise ValueError("a capacity above 0 and a rate between 0 and 1")
    if blooms.where(F.col("key") == key).count():
        raise ValueError("key already exists")
    return blooms.unionByName(literal(blooms.sparkSession, [(key, capacity, fpr, 0)], "key string, capacity bigint, fpr double, items_added bigint"))


def exists(blooms: DataFrame, bits: DataFrame, items: DataFrame) -> DataFrame:
    """BF.EXISTS, BF.MEXISTS: items(key, item) -> (key, item, found): 1 for every item that
    was added, for a share of about fpr of the others, and 0 where there is no filter."""
    need = _words(items, blooms).select("key", "item", "word", F.col("bits").alias("need")).repartition(_tasks(items), "key", "word")
    hit = need.join(bits, ["key", "word"], "left").select("key", "item", (F.col("need").bitwiseAND(F.col("bits")) != 0).cast("int").alias("hit"))
    return hit.groupBy("key", "item").agg(F.min(F.coalesce("hit", F.lit(0))).alias("found"))


def add(blooms: DataFrame, bits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """BF.ADD, BF.MADD: items(key, item) -> (blooms, bits, (key, item, added) with 1 where the
    item looked new). Filters that are not there are made; items_added counts the adds that
    looked new. The items of one call are judged against the filter before it."""
    made = items.select("key").distinct().join(blooms.select("key"), "key", "left_anti")
    blooms = blooms.unionByName(made.select("key", F.lit(CAPACITY).cast("bigint").alias("capacity"), F.lit(RATE).alias("fpr"), F.lit(0).cast("bigint").alias("items_added")))
    replies = exists(blooms, bits, items).select("key", "item", (1 - F.col("found")).alias("added"))
    new = _merged(bits.unionByName(_bits(items, blooms)))
    counts = replies.groupBy("key").agg(F.sum("added").alias("n"))
    blooms = blooms.join(counts, "key", "left").select("key", "capacity", "fpr", (F.col("items_added") + F.coalesce("n", F.lit(0))).alias("items_added"))
    return blooms, new, replies


def card(blooms: DataFrame, key: str) -> DataFrame:
    """BF.CARD: one row, 0 where there is no filter."""
    return blooms.where(F.col("key") == key).agg(F.coalesce(F.max("items_added"), F.lit(0)).alias("n"))


def drop(blooms: DataFrame, bits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return blooms.where(F.col("key") != key), bits.where(F.col("key") != key)


def _one(df: DataFrame, capacity: int, fpr: float) -> DataFrame:
    return literal(df.sparkSession, [(ONE, capacity, fpr, 0)], "key string, capacity bigint, fpr double, items_added bigint")


def build(items: DataFrame, column: str, capacity: int = CAPACITY, fpr: float = RATE) -> DataFrame:
    """The bits of one filter for all items of a column. It is made for ``capacity`` items or,
    where the column has more different ones, for as many, so that the rate holds; how many is
    told to probe() by a row of the key SIZE."""
    rows = items.select(F.lit(ONE).alias("key"), F.col(column).alias("item"))
    most = rows.agg(F.count_distinct("item").alias("n"))
    one = _one(items, capacity, fpr).crossJoin(F.broadcast(most)).select("key", F.greatest("capacity", "n").alias("capacity"), "fpr")
    return _merged(_bits(rows, F.broadcast(one))).unionAll(one.select(F.lit(SIZE).alias("key"), F.lit(0).cast("bigint").alias("word"), F.col("capacity").alias("bits")))


def probe(bits: DataFrame, items: DataFrame, column: str, capacity: int = CAPACITY, fpr: float = RATE) -> DataFrame:
    """(item, found) of a column's items; bits, capacity and fpr as those of build()."""
    made = bits.where(F.col("key") == SIZE).agg(F.max("bits").alias("made"))
    one = _one(items, capacity, fpr).crossJoin(F.broadcast(made)).select("key", F.coalesce("made", "capacity").alias("capacity"), "fpr")
    return exists(F.broadcast(one), bits, items.select(F.lit(ONE).alias("key"), F.col(column).alias("item"))).select("item", "found")


def info(blooms: DataFrame) -> DataFrame:
    """(key, capacity, fpr, items_added, bits, hashes, memory, fill_percent)."""
    bits, hashes = shapes(F.col("capacity"), F.col("fpr"))
    return blooms.select("key", "capacity", "fpr", "items_added", bits.alias("bits"), hashes.cast("bigint").alias("hashes"), F.ceil(bits / 8).cast("bigint").alias("memory"), (F.col("items_added") * 100.0 / F.col("capacity")).alias("fill_percent"))


