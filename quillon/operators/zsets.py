"""Sorted sets over (key, member, score), in the total order (score, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.parsing import rank_bounds, score_bound
from quillon.operators.generic import asked, upsert


def _order(descending: bool = False):
    return [F.col("score").desc(), F.col("member").desc()] if descending else ["score", "member"]


def ranked(zsets: DataFrame, descending: bool = False) -> DataFrame:
    """With rank, from 0, in the set's order or the reverse one."""
    return zsets.withColumn("rank", (F.row_number().over(W.partitionBy("key").orderBy(*_order(descending))) - 1).cast("bigint"))


def clean(rows: DataFrame) -> DataFrame:
    """NaN scores become 0."""
    return rows.withColumn("score", F.when(F.isnan("score"), F.lit(0.0)).otherwise(F.col("score")))


def zadd(zsets: DataFrame, rows: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, ch: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows(key, member, score, pos): (the new table, (key, n) as a reply).

    Pairs are judged one after the other in order of pos, and a repeated member sees the
    pair before; so for each member a fold over its sorted pairs gives the score and how
    many pairs were written. n: with a flag the pairs written; with ch alone all pairs;
    else members new or changed.
    """
    if nx and xx or gt and lt:
        raise ValueError("NX and XX, and GT and LT, exclude each other")
    pairs = clean(rows).groupBy("key", "member").agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("pairs"))
    old = pairs.join(zsets.withColumnRenamed("score", "old"), ["key", "member"], "left")

    def step(acc, pair):
        now, new = acc["score"], pair["score"]
        ok = F.lit(True)
        if nx:
            ok = ok & now.isNull()
        if xx:
            ok = ok & now.isNotNull()
        if gt:
            ok = ok & (now.isNull() | (new > now))
        if lt:
            ok = ok & (now.isNull() | (new < now))
        changed = ok & (now.isNull() | (now != new))
        return F.struct(F.when(ok, new).otherwise(now).alias("score"), (acc["accepted"] + ok.cast("int")).alias("accepted"), (acc["changed"] + changed.cast("int")).alias("changed"))

    start = F.struct(F.col("old").alias("score"), F.lit(0).alias("accepted"), F.lit(0).alias("changed"))
    done = old.withColumn("end", F.aggregate("pairs", start, step))
    count = F.sum("end.accepted") if nx or xx or gt or lt else F.sum(F.size("pairs")) if ch else F.sum("end.changed")
    reply = done.groupBy("key").agg(count.cast("bigint").alias("n"))
    return upsert(zsets, done.where("end.score is not null").select("key", "member", F.col("end.score").alias("score")), ["key", "member"]), reply


def zrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, rank, member, score) of the rank slice of every set. A slice of the lowest
    ranks keeps few rows per partition before the shuffle (window group limit)."""
    out = ranked(zsets)
    if start >= 0 and stop >= 0:
        return out.where((F.col("rank") >= start) & (F.col("rank") <= stop)).select("key", "rank", "member", "score")
    sized = out.join(zsets.groupBy("key").agg(F.count("*").alias("n")), "key")
    low, high = rank_bounds(F.col("n"), start, stop)
    return sized.where(F.col("rank").between(low, high)).select("key", "rank", "member", "score")


def zrevrange(zsets: DataFrame, start: int, stop: int, compat: bool = False) -> DataFrame:
    """(key, rank, member, score), highest first. Compat: the slice of the lowest, turned round."""
    if compat:
        out = zrange(zsets, start, stop)
        return out.select("key", (F.row_number().over(W.partitionBy("key").orderBy(F.col("rank").desc())) - 1).cast("bigint").alias("rank"), "member", "score")
    out = ranked(zsets, descending=True)
    if start >= 0 and stop >= 0:
        return out.where((F.col("rank") >= start) & (F.col("rank") <= stop)).select("key", "rank", "member", "score")
    sized = out.join(zsets.groupBy("key").agg(F.count("*").alias("n")), "key")
    low, high = rank_bounds(F.col("n"), start, stop)
    return sized.where(F.col("rank").between(low, high)).select("key", "rank", "member", "score")


def _within(low, high):
    (a, a_out), (b, b_out) = score_bound(low), score_bound(high)
    s = F.col("score")
    return (s > a if a_out else s >= a) & (s < b if b_out else s <= b)


def zrangebyscore(zsets: DataFrame, low, high, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(key, member, score) with scores in the bounds (``(5`` excludes 5); with a limit, by set."""
    found = zsets.where(_within(low, high))
    if limit is None:
        return found
    return ranked(found).where((F.col("rank") >= offset) & (F.col("rank") < offset + limit)).select("key", "member", "score")


def zcount(zsets: DataFrame, low, high) -> DataFrame:
    return zsets.groupBy("key").agg(F.count_if(_within(low, high)).alias("n"))


def zscore(zsets: DataFrame, key: str, members: list[str]) -> DataFrame:
    mine = zsets.where((F.col("key") == key) & F.col("member").isin(members)).select("member", "score")
    return asked(zsets.sparkSession, members, "member").join(mine, "member", "left").select("pos", "member", "score")


def zcard(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count("*").alias("n"))


def zrank(zsets: DataFrame, member: str, reverse: bool = False) -> DataFrame:
    """(key, rank) of a member in every set that has it: a count of what stands before it,
    a partial aggregation instead of a sort of whole sets."""
    mine = zsets.where(F.col("member") == member).select("key", F.col("score").alias("s"))
    before = (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < member))
    after = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") > member))
    return zsets.join(mine, "key").groupBy("key").agg(F.count_if(after if reverse else before).alias("rank"))


def zincrby(zsets: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(key, member, delta) -> (key, member, score) after all of them."""
    total = steps.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    return total.join(zsets, ["key", "member"], "left").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("delta")).alias("score"))


def zrem(zsets: DataFrame, rows: DataFrame) -> DataFrame:
    return zsets.join(rows.select("key", "member").distinct(), ["key", "member"], "left_anti")


def zremrangebyrank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return zrem(zsets, zrange(zsets, start, stop))


def zremrangebyscore(zsets: DataFrame, low, high) -> DataFrame:
    return zsets.where(~_within(low, high))


def zpop(zsets: DataFrame, highest: bool = False, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(what goes from every set, the table without it)."""
    gone = ranked(zsets, highest).where(F.col("rank") < count).select("key", "rank", "member", "score")
    return gone, zrem(zsets, gone)
