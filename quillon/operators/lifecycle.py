"""Expiry, memory, eviction, command metrics and namespaces."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.parsing import glob_filter, namespace_name
from quillon.operators.keysview import keys_view, ranked
from quillon.sources.keyspace import Keyspace


def expire(meta: DataFrame, requests: DataFrame, compat: bool = False) -> DataFrame:
    """requests(key, expire_ms, seq): the last one holds; compat: the earliest of all deadlines."""
    pick = F.min("expire_ms") if compat else F.max_by("expire_ms", "seq")
    asked = requests.groupBy("key").agg(pick.alias("new"))
    out = meta.join(asked, "key", "full")
    due = F.least("expire_ms", "new") if compat else F.coalesce("new", "expire_ms")
    return out.select("key", "type", due.alias("expire_ms"), "access_count")


def ttl(keys: DataFrame, names: list[str]) -> DataFrame:
    """(key, ttl): -2 where there is no such key, -1 without expiry, else whole seconds left."""
    asked = keys.sparkSession.createDataFrame([(n,) for n in names], "key string")
    return asked.join(keys.where(F.col("key").isin(names)).select("key", "ttl"), "key", "left").select("key", F.coalesce("ttl", F.lit(-2)).alias("ttl"))


def purged(ks: Keyspace, as_of: int) -> Keyspace:
    """Without the keys that have expired as of an instant."""
    due = ks.meta.where(F.col("expire_ms") <= as_of).select("key")
    return ks.with_(**{t: df.join(due, "key", "left_anti") for t, df in ks.tables().items()})


def memory_by_type(keys: DataFrame) -> DataFrame:
    return keys.groupBy("type").agg(F.count("*").alias("n"), F.sum("memory").alias("memory"))


def evicted(keys: DataFrame, access: DataFrame, limit: int, protected: str | None = None) -> DataFrame:
    """(key): what goes, least accessed first and then by key, until at most ``limit`` bytes are used.
    Keys without access records stay, and so does the protected one.

    The running sums come from a range sort: sums inside partitions, shifted by those of
    the partitions before, of which there is one row each.
    """
    used = keys.agg(F.sum("memory").alias("used")).withColumn("one", F.lit(1))
    pool = keys.join(access.select("key", "access_count"), "key").where(F.col("access_count").isNotNull())
    if protected is not None:
        pool = pool.where(F.col("key") != protected)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pool.select("key", "memory", "access_count").repartitionByRange(n, "access_count", "key").withColumn("part", F.spark_partition_id())
    before_here = F.coalesce(F.sum("memory").over(W.partitionBy("part").orderBy("access_count", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("part").agg(F.sum("memory").alias("size"))
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    sums = dealt.withColumn("before", before_here).join(F.broadcast(offsets), "part").withColumn("one", F.lit(1)).join(F.broadcast(used), "one")
    return sums.where(F.col("used") - F.col("before") - F.col("offset") > limit).select("key")


def accesses(log: DataFrame) -> DataFrame:
    """(key, access_count) from a log with a key per command."""
    return log.groupBy("key").agg(F.count("*").alias("access_count"))


def hotkeys(access: DataFrame, n: int = 5) -> DataFrame:
    """The n keys with the most accesses, ties by key."""
    return access.orderBy(F.col("access_count").desc(), "key").limit(n)


def stats(log: DataFrame) -> DataFrame:
    """log(op, duration_ns) -> (op, calls, avg_ns)."""
    return log.groupBy("op").agg(F.count("*").alias("calls"), F.avg("duration_ns").alias("avg_ns"))


def slowlog(log: DataFrame, over_ns: int = 1_000_000, n: int = 128) -> DataFrame:
    """The n newest commands that took longer."""
    return log.where(F.col("duration_ns") > over_ns).orderBy(F.col("seq").desc()).limit(n)


def metrics(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(name, label, value): the gauges and counters of an exporter."""
    def rows(df: DataFrame, name: str, label, value) -> DataFrame:
        return df.select(F.lit(name).alias("name"), label.alias("label"), value.cast("double").alias("value"))

    kinds = memory_by_type(keys)
    return (
        rows(kinds, "keys_total", F.col("type"), F.col("n"))
        .unionAll(rows(kinds, "memory_bytes", F.col("type"), F.col("memory")))
        .unionAll(rows(stats(log), "commands_total", F.col("op"), F.col("calls")))
    )


def info(keys: DataFrame, log: DataFrame) -> DataFrame:
    """One row: (n_keys, memory, n_commands, n_slow)."""
    one = F.lit(1).alias("one")
    a = keys.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("memory"), F.lit(0)).alias("memory")).select("*", one)
    b = log.agg(F.count("*").alias("n_commands"), F.count_if(F.col("duration_ns") > 1_000_000).alias("n_slow")).select("*", one)
    return a.join(F.broadcast(b), "one").drop("one")


def settings(keys_limit: int | None, spark, pattern: str = "*") -> DataFrame:
    """CONFIG GET: (name, value) of the memory limit, the eviction policy and Spark's own settings."""
    own = [("maxmemory", str(keys_limit or 0)), ("eviction", "allkeys-lru")]
    rows = spark.createDataFrame(own + sorted(spark.sparkContext.getConf().getAll()), "name string, value string")
    return rows.where(glob_filter(F.col("name"), pattern))


def prometheus(df: DataFrame) -> DataFrame:
    """(line): text exposition of metrics()."""
    return df.select(F.format_string('%s{label="%s"} %s', "name", "label", F.col("value").cast("string")).alias("line"))


@dataclass
class Namespaces:
    """Separate keyspaces by name; ``default`` can't be deleted."""

    spaces: dict[str, Keyspace]
    limits: dict[str, int] = field(default_factory=dict)
    current: str = "default"

    def create(self, name: str, ks: Keyspace, limit: int | None = None) -> None:
        if namespace_name(name) in self.spaces:
            raise ValueError(f"{name} already exists")
        self.spaces[name] = ks
        if limit is not None:
            self.limits[name] = limit

    def use(self, name: str) -> Keyspace:
        self.current = name if name in self.spaces else self._missing(name)
        return self.spaces[name]

    def delete(self, name: str) -> None:
        if name == "default":
            raise ValueError("default can't be deleted")
        self.spaces.pop(name if name in self.spaces else self._missing(name))
        self.limits.pop(name, None)
        self.current = "default" if self.current == name else self.current

    def list(self) -> list[str]:
        return sorted(self.spaces)

    @staticmethod
    def _missing(name: str) -> str:
        raise KeyError(f"no namespace: {name}")

    def stats(self, as_of: int | None = None) -> DataFrame:
        """(ns, n_keys, memory, max_memory) of all."""
        parts = [keys_view(ks, as_of).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("memory"), F.lit(0)).alias("memory")).select(F.lit(ns).alias("ns"), "n_keys", "memory", F.lit(self.limits.get(ns)).cast("bigint").alias("max_memory")) for ns, ks in sorted(self.spaces.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def namespace_stats(keys: DataFrame) -> DataFrame:
    """(ns, n_keys, memory) where the namespace is what stands before a key's first colon."""
    ns = F.substring_index("key", ":", 1)
    return keys.groupBy(ns.alias("ns")).agg(F.count("*").alias("n_keys"), F.sum("memory").alias("memory"))


__all__ = ["Namespaces", "accesses", "evicted", "expire", "hotkeys", "info", "memory_by_type", "metrics", "namespace_stats", "prometheus", "purged", "ranked", "settings", "slowlog", "stats", "ttl"]
