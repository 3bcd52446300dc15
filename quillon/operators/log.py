"""Command logs: (seq, op, key, args ARRAY<STRING>), and their fold into a keyspace.

Every class of commands folds by the means that scales for it: last writers by max_by,
sets by the last command per member, lists (whose order matters) by one sorted fold per
key. A DEL and a SET are barriers: what stands before the last one of its key counts no
more, whatever its type. What is left of a key has the type of its first command that
creates one; commands for other types do nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.generic import last_of
from quillon.sources.keyspace import Keyspace, empty
from quillon.sources.shared import written

SCHEMA = "seq bigint, op string, key string, args array<string>"
#: Commands that a log keeps (fixed values).
WRITES = (
    "SET", "MSET", "APPEND", "SETRANGE", "INCR", "DECR",
    "LPUSH", "RPUSH", "LPOP", "RPOP", "LSET", "LTRIM",
    "SADD", "SREM",
    "ZADD", "ZREM", "ZINCRBY", "ZPOPMIN", "ZPOPMAX", "ZREMRANGEBYRANK", "ZREMRANGEBYSCORE",
    "HSET", "HSETNX", "HMSET", "HDEL", "HINCRBY", "HINCRBYFLOAT",
    "DEL", "RENAME", "RENAMENX", "EXPIRE",
)
#: What commands that are folded work on, and which of them create a key.
KINDS = {
    "string": ("SET", "INCR", "DECR", "INCRBY", "DECRBY", "APPEND"),
    "list": ("LPUSH", "RPUSH", "LPOP", "RPOP", "LTRIM", "LSET"),
    "set": ("SADD", "SREM"),
    "zset": ("ZADD", "ZREM"),
    "hash": ("HSET", "HMSET", "HDEL"),
}
CREATE = ("SET", "INCR", "DECR", "INCRBY", "DECRBY", "APPEND", "LPUSH", "RPUSH", "SADD", "ZADD", "HSET", "HMSET")
FLAGS = ("NX", "XX", "GT", "LT", "CH")
#: Items of a command of a compacted log.
CHUNK = 1024


def is_write(op):
    """Whether a command (a column or a name) changes anything."""
    return op.upper() in WRITES if isinstance(op, str) else F.upper(op).isin(*WRITES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; broken lines are left out (they come as nulls)."""
    rows = spark.read.schema(SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and seq is not null").drop("_corrupt_record")


def write(log: DataFrame, path: str) -> None:
    log.where(is_write(F.col("op"))).write.mode("append").json(path)


def single(log: DataFrame) -> DataFrame:
    """The log with one key to a command: MSET as SETs, a DEL of several keys as several.
    seq becomes the pair of a command's place and the key's place in it."""
    if isinstance(log.schema["seq"].dataType, T.StructType):
        return log
    op, args = F.upper("op"), F.col("args")
    mset = F.transform(F.sequence(F.lit(0), F.size(args), F.lit(2)), lambda i: F.struct((i / 2).cast("int").alias("pos"), F.lit("SET").alias("op"), F.when(i == 0, F.col("key")).otherwise(F.get(args, i - 1)).alias("key"), F.array(F.get(args, i)).alias("args")))
    dels = F.transform(F.concat(F.array("key"), args), lambda k, i: F.struct(i.alias("pos"), F.lit("DEL").alias("op"), k.alias("key"), F.array().cast("array<string>").alias("args")))
    same = F.array(F.struct(F.lit(0).alias("pos"), op.alias("op"), F.col("key").alias("key"), args.alias("args")))
    each = F.when((op == "MSET") & (F.size(args) % 2 == 1), mset).when(op == "DEL", dels).when(op != "MSET", same)
    rows = log.withColumn("args", F.coalesce(args, F.array().cast("array<string>"))).select("seq", F.explode(each).alias("c"))
    return rows.select(F.struct("seq", "c.pos").alias("seq"), "c.op", "c.key", "c.args")


def after_barriers(log: DataFrame) -> DataFrame:
    """(seq, op, key, args, kind) of the commands that count: from the last DEL or SET of
    their key on, and for the type that the first of them to create the key gives it."""
    if "kind" in log.columns:
        return log
    kind = F.coalesce(*(F.when(F.col("op").isin(*ops), F.lit(k)) for k, ops in KINDS.items()))
    log = single(log)
    barrier = log.where("op in ('DEL', 'SET')").groupBy("key").agg(F.max("seq").alias("barrier"))
    left = log.where("op <> 'DEL'").join(barrier, "key", "left").where("barrier is null or seq > barrier or (seq = barrier and op = 'SET')").withColumn("kind", kind).where("kind is not null")
    first = left.where(F.col("op").isin(*CREATE)).groupBy("key").agg(F.min_by("kind", "seq").alias("kind"))
    return left.join(first, ["key", "kind"]).select("seq", "op", "key", "args", "kind")


def strings(log: DataFrame) -> DataFrame:
    """SET, APPEND, INCR, DECR, INCRBY and DECRBY by key: from the last SET on, numbers
    add up and texts append."""
    mine = after_barriers(log).where("kind = 'string'")
    base = mine.where("op = 'SET'").groupBy("key").agg(F.max_by(F.element_at("args", 1), "seq").alias("value"), F.max("seq").alias("since"))
    later = mine.where("op <> 'SET'").join(base.select("key", "since"), "key", "left").where("since is null or seq > since")
    step = F.when(F.col("op") == "INCR", F.lit(1)).when(F.col("op") == "DECR", F.lit(-1)).when(F.col("op") == "INCRBY", F.try_element_at("args", F.lit(1)).try_cast("bigint")).when(F.col("op") == "DECRBY", -F.try_element_at("args", F.lit(1)).try_cast("bigint"))
    part = F.when(F.col("op") == "APPEND", F.struct("seq", F.try_element_at("args", F.lit(1)).alias("text")))
    sums = later.groupBy("key").agg(F.sum(step).alias("sum"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "").alias("tail"))
    out = base.join(sums, "key", "full")
    number = F.coalesce(F.col("value").try_cast("bigint"), F.lit(0)) + F.col("sum")
    return out.select("key", F.concat(F.when(F.col("sum").isNull(), F.coalesce("value", F.lit(""))).otherwise(number.cast("string")), F.coalesce("tail", F.lit(""))).alias("value"))


def _pairs(log: DataFrame, ops: tuple[str, ...], names: tuple[str, str]) -> DataFrame:
    """(key, seq, name, name) of commands whose arguments are pairs, behind their flags; later
    pairs of a command win."""
    plain = F.array_position(F.transform("args", lambda x: ~F.upper(x).isin(*FLAGS)), True)
    args = F.when(F.col("op") == "ZADD", F.slice("args", F.greatest(plain, F.lit(1)).cast("int"), F.size("args"))).otherwise(F.col("args"))
    mine = log.where(F.col("op").isin(*ops)).withColumn("args", args).select("key", "seq", F.posexplode("args").alias("pos", "a"), "args")
    return mine.where("pos % 2 = 0 and pos + 1 < size(args)").select("key", F.struct("seq", "pos").alias("seq"), F.col("a").alias(names[0]), F.try_element_at("args", F.col("pos") + 2).alias(names[1]))


def _members(log: DataFrame, ops: tuple[str, ...]) -> DataFrame:
    return log.where(F.col("op").isin(*ops)).select("key", F.struct("seq", F.lit(0).alias("pos")).alias("seq"), F.explode("args").alias("member"))


def hashes(log: DataFrame) -> DataFrame:
    log = after_barriers(log).where("kind = 'hash'")
    put = _pairs(log, ("HSET", "HMSET"), ("field", "value")).withColumn("live", F.lit(True))
    cut = _members(log, ("HDEL",)).select("key", "seq", F.col("member").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("live"))
    return last_of(put.unionByName(cut), ["key", "field"], "seq").where("live").select("key", "field", "value")


def zsets(log: DataFrame) -> DataFrame:
    log = after_barriers(log).where("kind = 'zset'")
    put = _pairs(log, ("ZADD",), ("score", "member")).select("key", "seq", "member", F.col("score").try_cast("double").alias("score"), F.lit(True).alias("live")).where("score is not null")
    cut = _members(log, ("ZREM",)).select("key", "seq", "member", F.lit(None).cast("double").alias("score"), F.lit(False).alias("live"))
    return last_of(put.unionByName(cut), ["key", "member"], "seq").where("live").select("key", "member", "score")


def sets(log: DataFrame) -> DataFrame:
    log = after_barriers(log).where("kind = 'set'")
    put = _members(log, ("SADD",)).withColumn("live", F.lit(True))
    cut = _members(log, ("SREM",)).withColumn("live", F.lit(False))
    return last_of(put.unionByName(cut), ["key", "member"], "seq").where("live").select("key", "member")


def fold_list(values: list[str], op: str, args: list[str]) -> list[str]:
    """A list after one command (in place where it can be)."""
    if op == "RPUSH":
        values += args
    elif op == "LPUSH":
        values[:0] = reversed(args)
    elif op in ("LPOP", "RPOP"):
        n = int(args[0]) if args else 1
        if op == "LPOP":
            del values[:n]
        else:
            del values[max(0, len(values) - n) :]
    elif op == "LTRIM":
        n, a, b = len(values), int(args[0]), int(args[1])
        a, b = max(0, n + a) if a < 0 else a, n + b if b < 0 else min(n - 1, b)
        values[:] = values[a : b + 1] if a <= b else []
    elif op == "LSET":
        i = int(args[0])
        if -len(values) <= i < len(values):
            values[i] = args[1]
    return values


def lists(log: DataFrame) -> DataFrame:
    """Lists by one fold per key, its commands streamed in order: a partition's rows come
    sorted, and only the open key's list is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, values = None, []
        for frame in frames:
            out = []
            for k, op, args in zip(frame["key"], frame["op"], frame["args"], strict=True):
                if k != key:
                    out += [(key, i, v) for i, v in enumerate(values)]
                    key, values = k, []
                values = fold_list(values, op, list(args))
            yield pd.DataFrame(out, columns=["key", "idx", "value"])
        yield pd.DataFrame([(key, i, v) for i, v in enumerate(values)], columns=["key", "idx", "value"])

    mine = after_barriers(log).where("kind = 'list'").select("key", "seq", "op", "args")
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mine.repartition(n, "key").sortWithinPartitions("key", "seq").select("key", "op", "args").mapInPandas(run, "key string, idx bigint, value string")


def _related(pairs: DataFrame) -> DataFrame:
    """pairs(key, new) -> (key, root): one root for all keys that renames connect. Each
    round takes the least root in reach and that root's own, so rounds grow with the logarithm
    of the longest chain; each is a table in the shared folder."""
    edges = written(pairs.union(pairs.select("new", "key")).toDF("key", "near").distinct(), "renames")
    roots = written(edges.groupBy("key").agg(F.least(F.min("near"), F.first("key")).alias("root")), "roots")
    while True:
        least = edges.join(roots.withColumnRenamed("key", "near"), "near").groupBy("key").agg(F.min("root").alias("least"))
        step = roots.join(least, "key").select("key", F.least("root", "least").alias("new"), "root")
        jump = roots.select(F.col("key").alias("new"), F.col("root").alias("far"))
        new = written(step.join(jump, "new", "left").select("key", F.least("new", F.coalesce("far", "new")).alias("root"), F.col("root").alias("old")), "roots")
        if not new.where("root <> old").limit(1).count():
            return new.select("key", "root")
        roots = new.select("key", "root")


def renamed(log: DataFrame) -> DataFrame:
    """The log with every command under its key's last name, without RENAMEs and what they
    or DELs leave behind. Only keys that some RENAME connects are followed in order: their
    commands are streamed by group of connected keys, and a task holds no more than the names
    of the group that is open."""
    log = single(log)
    pairs = log.where("op = 'RENAME' and size(args) = 1").select("key", F.element_at("args", 1).alias("new"))
    rest = log.where("op <> 'RENAME'")
    if not pairs.limit(1).count():
        return rest
    roots = _related(pairs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, live = None, {}  # name -> number of what it holds: where that was created
        names = ["seq", "pos", "op", "args", "held", "key"]

        def ends():
            return [(None, None, None, None, held, key) for key, held in live.items()]

        for frame in frames:
            out = []
            for group, seq, pos, op, key, args in frame[["root", "seq", "pos", "op", "key", "args"]].itertuples(index=False):
                if group != root:
                    out += ends()
                    root, live = group, {}
                if op == "DEL":
                    live.pop(key, None)
                elif op == "RENAME":
                    if len(args) == 1 and key in live:
                        live[args[0]] = live.pop(key)
                else:
                    if op == "SET" or op in CREATE and key not in live:
                        live[key] = f"{seq}.{pos}"
                    if key in live:
                        out.append((seq, pos, op, list(args), live[key], None))
            yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "pos": "Int32"})
        yield pd.DataFrame(ends(), columns=names).astype({"seq": "Int64", "pos": "Int32"})

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = log.join(roots, "key").select("root", "seq.seq", "seq.pos", "op", "key", "args")
    mine = written(mine.repartition(n, "root").sortWithinPartitions("root", "seq", "pos").mapInPandas(run, "seq bigint, pos int, op string, args array<string>, held string, key string"), "followed")
    ends = mine.where("op is null").select("held", "key")
    moved = mine.where("op is not null").drop("key").join(ends, "held").select(F.struct("seq", "pos").alias("seq"), "op", "key", "args")
    return rest.join(roots.select("key"), "key", "left_anti").select("seq", "op", "key", "args").unionAll(moved)


def replay(log: DataFrame) -> Keyspace:
    """The keyspace after all commands of a log. The commands that count are written once,
    by type, and each type's fold reads its own."""
    log = written(after_barriers(renamed(log)), "commands")
    return empty(log.sparkSession).with_(strings=strings(log), hashes=hashes(log), sets=sets(log), zsets=zsets(log), lists=lists(log))


def compacted(ks: Keyspace) -> DataFrame:
    """The shortest log that builds the keyspace: commands of at most CHUNK items each, those
    of a list in order. Bloom filters, series and JSON have no commands in a log."""

    def grouped(df: DataFrame, op: str, item: str, flat, chunk=None) -> DataFrame:
        if chunk is None:  # as many chunks as a key's items take
            sizes = df.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("n"))
            df, chunk = df.join(sizes, "key"), F.pmod(F.xxhash64(item), F.col("n"))
        items = F.sort_array(F.collect_list(F.struct(item, *(c for c in df.columns if c not in ("key", "n", item)))))
        rows = df.groupBy("key", chunk.cast("bigint").alias("chunk")).agg(items.alias("items"))
        return rows.select("chunk", F.lit(op).alias("op"), "key", F.flatten(F.transform("items", flat)).alias("args"))

    parts = [
        ks.strings.select(F.lit(0).cast("bigint").alias("chunk"), F.lit("SET").alias("op"), "key", F.array("value").alias("args")),
        grouped(ks.lists, "RPUSH", "idx", lambda x: F.array(x["value"]), F.floor(F.col("idx") / CHUNK)),
        grouped(ks.sets, "SADD", "member", lambda x: F.array(x["member"])),
        grouped(ks.zsets, "ZADD", "member", lambda x: F.array(x["score"].cast("string"), x["member"])),
        grouped(ks.hashes, "HSET", "field", lambda x: F.array(x["field"], x["value"])),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.orderBy("chunk", "key").select(F.monotonically_increasing_id().alias("seq"), "op", "key", "args")
