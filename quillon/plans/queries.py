"""The registered queries over the canonical keyspace, each with its twin in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.parsing import glob_filter
from quillon.operators import bloom, generic, hashes, jsondoc, keysview, lifecycle, lists, log, schema, sets, strings, timeseries, zsets
from quillon.plans import sql
from quillon.sources import keyspace
from quillon.sources.keyspace import AS_OF, Keyspace, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Build = Callable[[Keyspace], DataFrame]


def add(name: str, build: Build, query: str | None, *tables: str) -> None:
    """Registers a query over the keyspace; query: DuckDB SQL over the named tables of CTES."""
    QUERIES[name] = lambda spark, sf_dir: build(keyspace.from_tables(spark, sf_dir))
    if query is not None:
        ORACLE[name] = oracle(query, *tables)


def _keys(ks: Keyspace) -> DataFrame:
    return keysview.keys_view(ks, AS_OF)


def _run(statement: str) -> Build:
    return lambda ks: sql.query(_keys(ks), statement)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# SQL over keys
_ALL = "SELECT key, type, memory, ttl, length FROM keys"
add("sql_select_star", _run("SELECT * FROM keys"), "SELECT key, type, memory, ttl, length, value FROM keys", "keys")
add("sql_like", _run("SELECT key, length FROM keys WHERE key LIKE 'CUSTOMER:1%:name'"), "SELECT key, length FROM keys WHERE key ILIKE 'CUSTOMER:1%:name'", "keys")
add("sql_like_underscore", _run("SELECT key FROM keys WHERE key LIKE 'customer:_:NAME'"), "SELECT key FROM keys WHERE key ILIKE 'customer:_:NAME'", "keys")
add("sql_not_like", _run("SELECT key FROM keys WHERE type = 'set' AND key NOT LIKE 'type:%'"), "SELECT key FROM keys WHERE type = 'set' AND key NOT ILIKE 'type:%'", "keys")
add("sql_and_or", _run("SELECT key, memory FROM keys WHERE (type = 'zset' OR type = 'set') AND memory > 100"), "SELECT key, memory FROM keys WHERE (type = 'zset' OR type = 'set') AND memory > 100", "keys")
add("sql_numeric_cmp", _run("SELECT key, ttl FROM keys WHERE ttl >= 0 AND ttl < 40"), "SELECT key, ttl FROM keys WHERE ttl >= 0 AND ttl < 40", "keys")
add("sql_not_equal", _run("SELECT type, count(*) AS n FROM keys WHERE type <> 'json' GROUP BY type"), "SELECT type, count(*) AS n FROM keys WHERE type <> 'json' GROUP BY type", "keys")
add("sql_alias", _run("SELECT key AS name, length AS size FROM keys WHERE type = 'hash'"), "SELECT key AS name, length AS size FROM keys WHERE type = 'hash'", "keys")
add("sql_value_filter", _run("SELECT key, value FROM keys WHERE type = 'string' AND value LIKE '%1'"), "SELECT key, value FROM keys WHERE type = 'string' AND value ILIKE '%1'", "keys")
add("sql_count", _run("SELECT COUNT(*) AS n FROM keys WHERE type = 'list'"), "SELECT count(*) AS n FROM keys WHERE type = 'list'", "keys")
add("sql_group_by", _run("SELECT type, COUNT(*) AS n, SUM(memory) AS memory FROM keys GROUP BY type HAVING COUNT(*) > 1"), "SELECT type, count(*) AS n, CAST(sum(memory) AS BIGINT) AS memory FROM keys GROUP BY type HAVING count(*) > 1", "keys")
add("sql_order_limit", _run("SELECT key, memory FROM keys ORDER BY memory DESC, key LIMIT 20 OFFSET 5"), "SELECT key, memory FROM keys ORDER BY memory DESC, key LIMIT 20 OFFSET 5", "keys")
add("sql_in_between", _run("SELECT key, length FROM keys WHERE type IN ('list', 'hash') AND length BETWEEN 4 AND 9"), "SELECT key, length FROM keys WHERE type IN ('list', 'hash') AND length BETWEEN 4 AND 9", "keys")
add("sql_join", _run("SELECT a.key AS key, b.length AS orders FROM keys a JOIN keys b ON b.key = concat(a.key, ':orders') WHERE a.type = 'hash' AND b.type = 'list'"), "SELECT a.key AS key, b.length AS orders FROM keys a JOIN keys b ON b.key = a.key || ':orders' WHERE a.type = 'hash' AND b.type = 'list'", "keys")
add("sql_rollup", _run("SELECT type, substring_index(key, ':', 1) AS ns, COUNT(*) AS n FROM keys GROUP BY ROLLUP (type, substring_index(key, ':', 1))"), "SELECT type, ns, count(*) AS n FROM (SELECT type, split_part(key, ':', 1) AS ns FROM keys) GROUP BY ROLLUP (type, ns)", "keys")
add("sql_window", _run("SELECT key, type, rank() OVER (PARTITION BY type ORDER BY memory DESC, key) AS place FROM keys WHERE type IN ('set', 'zset', 'timeseries')"), "SELECT key, type, CAST(rank() OVER (PARTITION BY type ORDER BY memory DESC, key) AS INTEGER) AS place FROM keys WHERE type IN ('set', 'zset', 'timeseries')", "keys")
add("sql_union_except", _run("SELECT key FROM keys WHERE type = 'zset' UNION SELECT key FROM keys WHERE type = 'set' EXCEPT SELECT key FROM keys WHERE length > 26"), "(SELECT key FROM keys WHERE type = 'zset' UNION SELECT key FROM keys WHERE type = 'set') EXCEPT SELECT key FROM keys WHERE length > 26", "keys")
add("sql_delete_remaining", lambda ks: sql.query(_keys(ks), "DELETE FROM keys WHERE type = 'json' OR key LIKE 'customer:%'").remaining.select("key", "type"), "SELECT key, type FROM keys WHERE NOT (type = 'json' OR key ILIKE 'customer:%')", "keys")
add("sql_compat", lambda ks: sql.query(_keys(ks), "SELECT key, length FROM keys WHERE type = 'zset' AND length > '-5' AND key NOT LIKE 'BOARD:%' LIMIT 1", compat=True), "SELECT key, CAST(length AS VARCHAR) AS length FROM keys WHERE type = 'zset' AND length > -5 AND key ILIKE 'BOARD:%'", "keys")

# keys
add("keys_glob", lambda ks: _keys(ks).where(glob_filter(F.col("key"), "customer:*:orders")).select("key"), "SELECT key FROM keys WHERE key LIKE 'customer:%:orders'", "keys")
add("keys_all", lambda ks: _keys(ks).where(glob_filter(F.col("key"), "*")).select("key", "type"), "SELECT key, type FROM keys", "keys")
add("scan_page", lambda ks: keysview.scan_page(_keys(ks), 100, 50), "SELECT pos, key FROM (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM keys) WHERE pos >= 100 AND pos < 150", "keys")
add("scan_match", lambda ks: keysview.scan_page(_keys(ks), 0, 500, "counter:*"), "SELECT pos, key FROM (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM keys) WHERE pos < 500 AND key LIKE 'counter:%'", "keys")
_NAMES = ["customer:1", "customer:1", "customer:2:name", "board:nowhere", "event:7"]
add("exists", lambda ks: keysview.exists(_keys(ks), _NAMES), f"SELECT count(*) AS n FROM (SELECT unnest({_NAMES!r}) AS a) x WHERE a IN (SELECT key FROM keys)", "keys")
add("type_of", lambda ks: keysview.type_of(_keys(ks), "event:7"), "SELECT coalesce(max(type), 'none') AS type FROM keys WHERE key = 'event:7'", "keys")
add("type_none", lambda ks: keysview.type_of(_keys(ks), "nobody"), "SELECT coalesce(max(type), 'none') AS type FROM keys WHERE key = 'nobody'", "keys")


def _renamed(ks: Keyspace) -> DataFrame:
    from quillon.operators.generic import rename

    return rename(ks, "customer:1", "vip:1").hashes


add("renamenx", lambda ks: (lambda r: r(r(ks, "customer:1", "customer:2", True, _keys(ks)), "customer:1", "vip:1", True, _keys(ks)).hashes)(generic.rename), "SELECT CASE WHEN key = 'customer:1' THEN 'vip:1' ELSE key END AS key, field, value FROM hashes", "hashes")
add("ping", lambda ks: generic.ping(ks.strings.sparkSession), "SELECT 'PONG' AS reply")
ORACLE["ping"] = ORACLE["ping"].removeprefix("WITH  ")
add("rename", _renamed, "SELECT CASE WHEN key = 'customer:1' THEN 'vip:1' ELSE key END AS key, field, value FROM hashes", "hashes")


def _deleted(ks: Keyspace) -> DataFrame:
    from quillon.operators.generic import without

    return without(ks, ["customer:1", "customer:2"]).hashes


add("del", _deleted, "SELECT key, field, value FROM hashes WHERE key NOT IN ('customer:1', 'customer:2')", "hashes")

# strings
_MGET = ["customer:3:name", "missing", "customer:1:name", "counter:click"]
add("get", lambda ks: strings.get(ks.strings, "customer:5:name"), "SELECT value FROM strings WHERE key = 'customer:5:name'", "strings")
add("mget", lambda ks: strings.mget(ks.strings, _MGET), f"SELECT CAST(pos AS INTEGER) AS pos, x.key AS key, value FROM (SELECT unnest({_MGET!r}) AS key, unnest(range(4)) AS pos) x LEFT JOIN strings s ON x.key = s.key", "strings")
add("mset", lambda ks: strings.mset(ks.strings, [("customer:1:name", "A"), ("new", "B"), ("new", "C")]), "SELECT key, value FROM strings WHERE key <> 'customer:1:name' UNION ALL SELECT 'customer:1:name', 'A' UNION ALL SELECT 'new', 'C'", "strings")
add("setnx", lambda ks: strings.setnx(strings.setnx(ks.strings, _keys(ks), "customer:1", "x"), _keys(ks), "fresh", "y"), "SELECT key, value FROM strings UNION ALL SELECT 'fresh', 'y'", "strings")
_ANY = [("customer:1", "a"), ("customer:1:orders", "b"), ("customer:2:name", "c")]
add("set_displaces", lambda ks: _keys(strings.set_(ks, _ANY)).select("key", "type", "length"), """SELECT key, type, length FROM keys WHERE key NOT IN ('customer:1', 'customer:1:orders', 'customer:2:name')
  UNION ALL SELECT 'customer:1', 'string', 1 UNION ALL SELECT 'customer:1:orders', 'string', 1 UNION ALL SELECT 'customer:2:name', 'string', 1""", "keys")
add("setex", lambda ks: _keys(strings.setex(ks, "customer:1", 90, "a", AS_OF)).select("key", "type", "ttl"), "SELECT key, type, ttl FROM keys WHERE key <> 'customer:1' UNION ALL SELECT 'customer:1', 'string', 90", "keys")
add("getset", lambda ks: strings.getset(ks, "customer:5:name", "new")[1].strings, "SELECT key, CASE WHEN key = 'customer:5:name' THEN 'new' ELSE value END AS value FROM strings", "strings")
add("getset_old", lambda ks: strings.getset(ks, "customer:5:name", "new")[0], "SELECT value FROM strings WHERE key = 'customer:5:name'", "strings")
add("strlen", lambda ks: strings.strlen(ks.strings), "SELECT key, CAST(strlen(value) AS INTEGER) AS n FROM strings", "strings")
add("getrange", lambda ks: ks.strings.select("key", strings.getrange(F.col("value"), -5, -2).alias("part")), "SELECT key, CASE WHEN length(value) - 2 < greatest(0, length(value) - 5) THEN '' ELSE substr(value, greatest(0, length(value) - 5) + 1, length(value) - 2 - greatest(0, length(value) - 5) + 1) END AS part FROM strings", "strings")
add("setrange", lambda ks: ks.strings.select("key", strings.setrange(F.col("value"), 2, "ZZ").alias("value")), "SELECT key, substr(value, 1, 2) || 'ZZ' || substr(value, 5) AS value FROM strings", "strings")


def _steps(ks: Keyspace) -> DataFrame:
    return ks.json.select(F.concat(F.lit("counter:"), F.get_json_object("doc", "$.type")).alias("key"), F.lit(2).cast("bigint").alias("delta"))


add("incr_fold", lambda ks: strings.incr(ks.strings, _steps(ks)), "SELECT s.key AS key, CAST(s.value AS BIGINT) * 3 AS value FROM strings s WHERE s.key LIKE 'counter:%'", "strings")
add("incrbyfloat", lambda ks: strings.incrbyfloat(ks.strings, _steps(ks).withColumn("delta", F.lit(0.5))), "SELECT s.key AS key, CAST(s.value AS DOUBLE) * 1.5 AS value FROM strings s WHERE s.key LIKE 'counter:%'", "strings")
add("append", lambda ks: strings.appended(ks.strings, ks.strings.where("key like 'counter:%'").select("key", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("é").alias("text")), F.struct(F.lit(2).alias("pos"), F.lit("!").alias("text")))).alias("x")).select("key", "x.*")), "SELECT key, value || 'é!' AS value, CAST(strlen(value || 'é!') AS INTEGER) AS n FROM strings WHERE key LIKE 'counter:%'", "strings")

# lists
_SIZED = "(SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lists)"
add("llen", lambda ks: lists.llen(ks.lists), "SELECT key, count(*) AS n FROM lists GROUP BY key", "lists")
add("lrange", lambda ks: lists.lrange(ks.lists, 2, 5), "SELECT key, idx, value FROM lists WHERE idx BETWEEN 2 AND 5", "lists")
add("lrange_negative", lambda ks: lists.lrange(ks.lists, -3, -2), f"SELECT key, idx, value FROM {_SIZED} WHERE idx BETWEEN greatest(0, n - 3) AND n - 2", "lists")
add("lindex", lambda ks: lists.lindex(ks.lists, -1), f"SELECT key, value FROM {_SIZED} WHERE idx = n - 1", "lists")
add("ltrim", lambda ks: lists.ltrim(ks.lists, 1, -2), f"SELECT key, idx - 1 AS idx, value FROM {_SIZED} WHERE idx BETWEEN 1 AND n - 2", "lists")
add("lrem", lambda ks: lists.lrem(ks.lists.withColumn("value", F.expr("cast(cast(value as bigint) % 3 as string)")), -2, "1"), """SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM (
  SELECT *, CASE WHEN value = '1' THEN row_number() OVER (PARTITION BY key, value ORDER BY idx DESC) ELSE 99 END AS r FROM (SELECT key, idx, CAST(CAST(value AS BIGINT) % 3 AS VARCHAR) AS value FROM lists)) WHERE r > 2""", "lists")
add("linsert", lambda ks: lists.linsert(ks.lists.withColumn("value", F.expr("cast(cast(value as bigint) % 3 as string)")), "1", "new"), """SELECT key, row_number() OVER (PARTITION BY key ORDER BY p) - 1 AS idx, value FROM (
  SELECT key, CAST(idx AS DOUBLE) AS p, CAST(CAST(value AS BIGINT) % 3 AS VARCHAR) AS value FROM lists UNION ALL SELECT key, min(idx) - 0.5, 'new' FROM lists WHERE CAST(value AS BIGINT) % 3 = 1 GROUP BY key)""", "lists")
add("lpos", lambda ks: lists.lpos(ks.lists.withColumn("value", F.expr("cast(cast(value as bigint) % 3 as string)")), "2"), "SELECT key, min(idx) AS idx FROM lists WHERE CAST(value AS BIGINT) % 3 = 2 GROUP BY key", "lists")
add("lset", lambda ks: lists.lset(ks.lists, "customer:1:orders", 0, "first"), "SELECT key, idx, CASE WHEN key = 'customer:1:orders' AND idx = 0 THEN 'first' ELSE value END AS value FROM lists", "lists")
add("lpush", lambda ks: lists.push(ks.lists, "customer:1:orders", ["a", "b"], True), "SELECT key, CASE WHEN key = 'customer:1:orders' THEN idx + 2 ELSE idx END AS idx, value FROM lists UNION ALL SELECT 'customer:1:orders', 0, 'b' UNION ALL SELECT 'customer:1:orders', 1, 'a'", "lists")
add("rpush", lambda ks: lists.push(ks.lists, "customer:1:orders", ["a", "b"], False), "SELECT key, idx, value FROM lists UNION ALL SELECT 'customer:1:orders', (SELECT count(*) FROM lists WHERE key = 'customer:1:orders') + i, x FROM (VALUES (0, 'a'), (1, 'b')) v(i, x)", "lists")
add("lpop", lambda ks: lists.pop(ks.lists, "customer:1:orders", 3)[0], "SELECT idx AS pos, value FROM lists WHERE key = 'customer:1:orders' AND idx < 3", "lists")
add("rpop", lambda ks: lists.pop(ks.lists, "customer:1:orders", 3, left=False)[0], f"SELECT n - 1 - idx AS pos, value FROM {_SIZED} WHERE key = 'customer:1:orders' AND n - 1 - idx < 3", "lists")

# sets
_SEGMENTS = ["segment:BUILDING:nations", "segment:MACHINERY:nations"]
_USERS = ["type:click:users", "type:purchase:users", "type:view:users"]
add("smembers", lambda ks: sets.smembers(ks.sets, "type:click:users"), "SELECT member FROM sets WHERE key = 'type:click:users'", "sets")
add("sismember", lambda ks: sets.sismember(ks.sets, "type:click:users", ["1", "2", "x"]), "SELECT CAST(pos AS INTEGER) AS pos, m AS member, CASE WHEN EXISTS (SELECT 1 FROM sets WHERE key = 'type:click:users' AND member = m) THEN 1 ELSE 0 END AS found FROM (VALUES (0, '1'), (1, '2'), (2, 'x')) v(pos, m)", "sets")
add("scard", lambda ks: sets.scard(ks.sets), "SELECT key, count(*) AS n FROM sets GROUP BY key", "sets")
add("sunion", lambda ks: sets.sunion(ks.sets, [*_USERS, "missing"]), f"SELECT DISTINCT member FROM sets WHERE key IN {tuple(_USERS)!r}", "sets")
add("sinter", lambda ks: sets.sinter(ks.sets, _USERS), " INTERSECT ".join(f"SELECT member FROM sets WHERE key = {k!r}" for k in _USERS), "sets")
_APART = ["type:click:users", _SEGMENTS[0], "missing"]
add("sdiff", lambda ks: sets.sdiff(ks.sets, _APART), " EXCEPT ".join(f"SELECT member FROM sets WHERE key = {k!r}" for k in _APART), "sets")
add("sadd", lambda ks: sets.sadd(ks.sets, sets.rows(ks.sets, "type:click:users", ["1", "new", "new"]))[0], "SELECT key, member FROM sets UNION SELECT 'type:click:users', '1' UNION SELECT 'type:click:users', 'new'", "sets")
add("srem", lambda ks: sets.srem(ks.sets, sets.rows(ks.sets, "type:click:users", ["1", "2", "none"]))[0], "SELECT key, member FROM sets WHERE NOT (key = 'type:click:users' AND member IN ('1', '2'))", "sets")

# sorted sets
_RANK = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM zsets)"
_DOWN = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zsets)"
add("zrange", lambda ks: zsets.zrange(ks.zsets, 0, 9), f"SELECT key, rank, member, score FROM {_RANK} WHERE rank <= 9", "zsets")
add("zrange_negative", lambda ks: zsets.zrange(ks.zsets, -4, -1), f"SELECT key, rank, member, score FROM {_RANK} WHERE rank BETWEEN n - 4 AND n - 1", "zsets")
add("zrevrange_strict", lambda ks: zsets.zrevrange(ks.zsets, 0, 9), f"SELECT key, rank, member, score FROM {_DOWN} WHERE rank <= 9", "zsets")
add("zrevrange_compat", lambda ks: zsets.zrevrange(ks.zsets, 0, 9, compat=True), f"SELECT key, 9 - rank AS rank, member, score FROM {_RANK} WHERE rank <= 9", "zsets")
add("zrangebyscore", lambda ks: zsets.zrangebyscore(ks.zsets, "(0", 1000), "SELECT key, member, score FROM zsets WHERE score > 0 AND score <= 1000", "zsets")
add("zrangebyscore_limit", lambda ks: zsets.zrangebyscore(ks.zsets, "-inf", "+inf", 2, 3), f"SELECT key, member, score FROM {_RANK} WHERE rank BETWEEN 2 AND 4", "zsets")
_MEMBER = "Customer#000000007"
add("zrank", lambda ks: zsets.zrank(ks.zsets, ks.zsets.agg(F.min("member")).first()[0]), f"SELECT key, rank FROM {_RANK} WHERE member = (SELECT min(member) FROM zsets)", "zsets")
add("zrevrank", lambda ks: zsets.zrank(ks.zsets, ks.zsets.agg(F.min("member")).first()[0], reverse=True), f"SELECT key, rank FROM {_DOWN} WHERE member = (SELECT min(member) FROM zsets)", "zsets")
add("zscore", lambda ks: zsets.zscore(ks.zsets, "board:BUILDING", ["nobody", _MEMBER]), f"SELECT CAST(pos AS INTEGER) AS pos, m AS member, score FROM (VALUES (0, 'nobody'), (1, '{_MEMBER}')) v(pos, m) LEFT JOIN zsets ON key = 'board:BUILDING' AND member = m", "zsets")
add("zcard", lambda ks: zsets.zcard(ks.zsets), "SELECT key, count(*) AS n FROM zsets GROUP BY key", "zsets")
add("zcount", lambda ks: zsets.zcount(ks.zsets, 0, 5000), "SELECT key, count(*) FILTER (score BETWEEN 0 AND 5000) AS n FROM zsets GROUP BY key", "zsets")
add("zincrby_fold", lambda ks: _rounded(zsets.zincrby(ks.zsets, ks.zsets.where("score < 0").select("key", "member", F.explode(F.array(F.lit(10.0), F.lit(2.5))).alias("delta"))), "score"), "SELECT key, member, round(score + 12.5, 6) AS score FROM zsets WHERE score < 0", "zsets")
add("zadd_gt", lambda ks: zsets.zadd(ks.zsets, ks.zsets.select("key", "member", F.lit(5000.0).alias("score"), F.lit(0).alias("pos")), gt=True)[0], "SELECT key, member, greatest(score, 5000.0) AS score FROM zsets", "zsets")
_HALF = lambda ks: ks.zsets.select("key", F.when(F.length("member") % 2 == 0, F.col("member")).otherwise(F.concat(F.lit("new:"), "member")).alias("member"), F.lit(100.0).alias("score"), F.lit(0).alias("pos"))
_FRESH = "SELECT key, 'new:' || member AS member, CAST(100 AS DOUBLE) AS score FROM zsets WHERE length(member) % 2 = 1"
add("zadd_nx", lambda ks: zsets.zadd(ks.zsets, _HALF(ks), nx=True)[0], f"SELECT key, member, score FROM zsets UNION ALL {_FRESH}", "zsets")
add("zadd_xx", lambda ks: zsets.zadd(ks.zsets, _HALF(ks), xx=True)[0], "SELECT key, member, CASE WHEN length(member) % 2 = 0 THEN 100 ELSE score END AS score FROM zsets", "zsets")
add("zadd_lt", lambda ks: zsets.zadd(ks.zsets, _HALF(ks), lt=True)[0], f"SELECT key, member, CASE WHEN length(member) % 2 = 0 THEN least(score, 100) ELSE score END AS score FROM zsets UNION ALL {_FRESH}", "zsets")
add("zadd_ch", lambda ks: zsets.zadd(ks.zsets, _HALF(ks), ch=True)[1], "SELECT key, count(*) AS n FROM zsets GROUP BY key", "zsets")
add("zadd_reply", lambda ks: zsets.zadd(ks.zsets, ks.zsets.select("key", "member", F.lit(5000.0).alias("score"), F.lit(0).alias("pos")), gt=True)[1], "SELECT key, CAST(count(*) FILTER (score < 5000) AS BIGINT) AS n FROM zsets GROUP BY key", "zsets")
add("zrem", lambda ks: zsets.zrem(ks.zsets, ks.zsets.where("score > 0")), "SELECT key, member, score FROM zsets WHERE NOT score > 0", "zsets")
add("zremrangebyrank", lambda ks: zsets.zremrangebyrank(ks.zsets, 3, -4), f"SELECT key, member, score FROM {_RANK} WHERE NOT rank BETWEEN 3 AND n - 4", "zsets")
add("zremrangebyscore", lambda ks: zsets.zremrangebyscore(ks.zsets, 0, "(5000"), "SELECT key, member, score FROM zsets WHERE NOT (score >= 0 AND score < 5000)", "zsets")
add("zpopmin", lambda ks: zsets.zpop(ks.zsets, count=2)[0], f"SELECT key, rank, member, score FROM {_RANK} WHERE rank < 2", "zsets")
add("zpopmax", lambda ks: zsets.zpop(ks.zsets, highest=True, count=2)[0], f"SELECT key, rank, member, score FROM {_DOWN} WHERE rank < 2", "zsets")

# hashes
_MAP = "SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields, count(*) AS n FROM hashes GROUP BY key"
add("hget", lambda ks: hashes.hget(ks.hashes, "nation"), "SELECT key, value FROM hashes WHERE field = 'nation'", "hashes")
add("hmget", lambda ks: hashes.hmget(ks.hashes, "customer:4", ["segment", "none", "name"]), "SELECT CAST(pos AS INTEGER) AS pos, f AS field, value FROM (VALUES (0, 'segment'), (1, 'none'), (2, 'name')) v(pos, f) LEFT JOIN hashes ON key = 'customer:4' AND field = f", "hashes")
add("hgetall", lambda ks: hashes.hgetall(ks.hashes).select("key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields")), f"SELECT key, fields FROM ({_MAP})", "hashes")
add("hkeys", lambda ks: hashes.hkeys(ks.hashes, "customer:4"), "SELECT field FROM hashes WHERE key = 'customer:4'", "hashes")
add("hvals", lambda ks: hashes.hvals(ks.hashes, "customer:4"), "SELECT value FROM hashes WHERE key = 'customer:4'", "hashes")
add("hlen", lambda ks: hashes.hlen(ks.hashes), f"SELECT key, n FROM ({_MAP})", "hashes")
add("hexists", lambda ks: hashes.hexists(ks.hashes, "customer:4", "name"), "SELECT count(*) AS found FROM hashes WHERE key = 'customer:4' AND field = 'name'", "hashes")
add("hset", lambda ks: hashes.hset(ks.hashes, ks.hashes.where("field = 'name'").select("key", F.lit("segment").alias("field"), F.lit("X").alias("value"), F.lit(0).alias("pos")))[0], "SELECT key, field, CASE WHEN field = 'segment' THEN 'X' ELSE value END AS value FROM hashes", "hashes")
add("hsetnx", lambda ks: hashes.hsetnx(ks.hashes, ks.hashes.where("field = 'name'").select("key", F.explode(F.array(F.lit("segment"), F.lit("level"))).alias("field"), F.lit("X").alias("value"))), "SELECT key, field, value FROM hashes UNION ALL SELECT DISTINCT key, 'level', 'X' FROM hashes", "hashes")
add("hdel", lambda ks: hashes.hdel(ks.hashes, ks.hashes.where("field in ('name', 'nation')")), "SELECT key, field, value FROM hashes WHERE field NOT IN ('name', 'nation')", "hashes")
add("hincrby_fold", lambda ks: hashes.hincrby(ks.hashes, ks.lists.select(F.regexp_replace("key", ":orders$", "").alias("key"), F.lit("orders").alias("field"), F.lit(1).cast("bigint").alias("delta"))), "SELECT replace(key, ':orders', '') AS key, 'orders' AS field, count(*) AS value FROM lists GROUP BY 1", "lists")
add("hincrbyfloat", lambda ks: _rounded(hashes.hincrbyfloat(ks.hashes, ks.hashes.where("field = 'acctbal'").select("key", "field", F.lit(0.25).alias("delta"))), "value"), "SELECT key, field, round(CAST(value AS DOUBLE) + 0.25, 6) AS value FROM hashes WHERE field = 'acctbal'", "hashes")
add("hscan", lambda ks: hashes.hscan(ks.hashes, 1, 2).select("key", "field", "value"), "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS pos FROM hashes) WHERE pos BETWEEN 1 AND 2", "hashes")

# JSON
add("json_get", lambda ks: ks.json.select("key", jsondoc.get(F.col("doc"), "$.tags").alias("tags"), jsondoc.get(F.col("doc"), "props.k").try_cast("bigint").alias("k")), """SELECT key, '["' || json_extract_string(doc, '$.tags[0]') || '","' || json_extract_string(doc, '$.tags[1]') || '"]' AS tags, CAST(json_extract_string(doc, '$.props.k') AS BIGINT) AS k FROM json""", "json")
add("json_get_string", lambda ks: ks.json.select("key", jsondoc.get(F.col("doc"), "type").alias("type")), """SELECT key, '"' || json_extract_string(doc, '$.type') || '"' AS type FROM json""", "json")
add("json_get_recursive", lambda ks: ks.json.select("key", jsondoc.get(F.col("doc"), "$..k").alias("k")), "SELECT key, json_extract_string(doc, '$.props.k') AS k FROM json", "json")
add("json_mget", lambda ks: jsondoc.mget(ks.json, ["event:3", "none", "event:1"], "$.user"), "SELECT CAST(pos AS INTEGER) AS pos, k AS key, json_extract_string(doc, '$.user') AS value FROM (VALUES (0, 'event:3'), (1, 'none'), (2, 'event:1')) v(pos, k) LEFT JOIN json ON key = k", "json")
add("json_type", lambda ks: ks.json.select("key", *(jsondoc.type_of(F.col("doc"), p).alias(n) for n, p in (("a", "$.user"), ("b", "$.tags"), ("c", "$.props"), ("d", "$.type"), ("e", "$.none")))), "SELECT key, 'integer' AS a, 'array' AS b, 'object' AS c, 'string' AS d, 'null' AS e FROM json", "json")
add("json_arrlen", lambda ks: ks.json.select("key", jsondoc.arrlen(F.col("doc"), "$.tags").alias("n"), jsondoc.arrlen(F.col("doc"), "$.type").alias("none")), "SELECT key, CAST(json_array_length(doc, '$.tags') AS INTEGER) AS n, CAST(NULL AS INTEGER) AS none FROM json", "json")
add("json_objkeys", lambda ks: ks.json.select("key", F.array_join(jsondoc.objkeys(F.col("doc")), ",").alias("fields")), "SELECT key, 'props,tags,type,user' AS fields FROM json", "json")
add("json_objlen", lambda ks: ks.json.select("key", jsondoc.objlen(F.col("doc"), "$.props").alias("n")), "SELECT key, CAST(len(json_keys(doc, '$.props')) AS INTEGER) AS n FROM json", "json")
add("json_numincrby", lambda ks: ks.json.select("key", jsondoc.numincrby(F.col("doc"), "$.user", 1.5).alias("value")), "SELECT key, CAST(json_extract_string(doc, '$.user') AS DOUBLE) + 1.5 AS value FROM json", "json")
add("json_incremented", lambda ks: ks.json.select("key", jsondoc.get(jsondoc.incremented(F.col("doc"), "$.user", 1.5), "$.user").cast("double").alias("value"), F.array_join(jsondoc.objkeys(jsondoc.incremented(F.col("doc"), "$.type", 1)), ",").alias("fields")), "SELECT key, CAST(json_extract_string(doc, '$.user') AS DOUBLE) + 1.5 AS value, 'props,tags,type,user' AS fields FROM json", "json")
add("json_set_key", lambda ks: jsondoc.set_key(jsondoc.set_key(ks.json, "event:1", "$", "[1]"), "new", "$.a", "2"), """SELECT key, CASE WHEN key = 'event:1' THEN '[1]' ELSE doc END AS doc FROM json UNION ALL SELECT 'new', '{"a":2}'""", "json")
add("json_del_key", lambda ks: jsondoc.del_key(ks.json, "event:1").select("key"), "SELECT key FROM json WHERE key <> 'event:1'", "json")
add("json_set", lambda ks: ks.json.select("key", jsondoc.get(jsondoc.set_(F.col("doc"), "$.props.z", "[1,2]"), "$.props.z").alias("z")), "SELECT key, '[1,2]' AS z FROM json", "json")
add("json_del", lambda ks: ks.json.select("key", F.array_join(jsondoc.objkeys(jsondoc.del_(F.col("doc"), "$.tags")), ",").alias("fields")), "SELECT key, 'props,type,user' AS fields FROM json", "json")
add("json_arrappend", lambda ks: ks.json.select("key", jsondoc.arrlen(jsondoc.arrappend(F.col("doc"), "$.tags", '"x"', "1"), "$.tags").alias("n")), "SELECT key, CAST(4 AS INTEGER) AS n FROM json", "json")

# time series
_DAY, _FROM = 86_400_000, 1_600_000_000_123
_AGG = {
    "avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "first": "arg_min(value, ts_ms)",
    "last": "arg_max(value, ts_ms)", "range": "max(value) - min(value)", "stddev": "stddev_pop(value)",
}
_BUCKET = f"ts_ms - (ts_ms - {_FROM}) % {_DAY}"


def _aggregate(*names: str) -> None:
    label = names[0] if len(names) == 1 else "all"
    shown = ", ".join(f"count(value) AS {n}" if n == "count" else f"round({_AGG[n]}, 6) AS {n}" for n in names)
    add(f"ts_range_agg_{label}", lambda ks: _rounded(timeseries.aggregated(ks.series, _FROM, "+", _DAY, *names), *(n for n in names if n != "count")), f"SELECT key, {_BUCKET} AS bucket_ms, {shown} FROM series WHERE ts_ms >= {_FROM} GROUP BY key, 2", "series")


for _name in _AGG:
    _aggregate(_name)
_aggregate(*_AGG)
add("ts_range", lambda ks: timeseries.range_(ks.series, _FROM, "+").where("key = 'ts:click'").select("key", "ts_ms", "value"), f"SELECT key, ts_ms, value FROM series WHERE key = 'ts:click' AND ts_ms >= {_FROM}", "series")
add("ts_get", lambda ks: timeseries.get(ks.series), "SELECT key, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM series GROUP BY key", "series")
add("ts_mrange", lambda ks: timeseries.mrange(ks.series, ks.series_meta, "-", "+", {"parity": "even"}).select("key", "ts_ms", "value"), "SELECT s.key AS key, ts_ms, value FROM series s JOIN series_meta m ON s.key = m.key WHERE parity = 'even'", "series", "series_meta")


def _overwritten(ks: Keyspace) -> DataFrame:
    """The samples, every third of which is written again with a value larger by one."""
    again = ks.series.where("seq % 3 = 0").select("key", "ts_ms", (F.col("value") + 1).alias("value"), (F.col("seq") + 1_000_000_000).alias("seq"), keyspace.SAMPLE)
    return timeseries.add(ks.series, again)


_AGAIN = "(SELECT key, ts_ms, value + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS value FROM series)"
add("ts_range_overwritten", lambda ks: _rounded(timeseries.range_(_overwritten(ks), _FROM, "+").select("key", "ts_ms", "value"), "value"), f"SELECT key, ts_ms, round(value, 6) AS value FROM {_AGAIN} WHERE ts_ms >= {_FROM}", "series")
add("ts_agg_overwritten", lambda ks: _rounded(timeseries.aggregated(_overwritten(ks), _FROM, "+", _DAY, "sum", "count", "last"), "sum", "last"), f"SELECT key, {_BUCKET} AS bucket_ms, round(sum(value), 6) AS sum, count(value) AS count, round(arg_max(value, ts_ms), 6) AS last FROM {_AGAIN} WHERE ts_ms >= {_FROM} GROUP BY key, 2", "series")
add("ts_mrange_overwritten", lambda ks: _rounded(timeseries.mrange(_overwritten(ks), ks.series_meta, "-", "+", {"parity": "even"}).select("key", "ts_ms", "value"), "value"), f"SELECT s.key AS key, ts_ms, round(value, 6) AS value FROM {_AGAIN} s JOIN series_meta m ON s.key = m.key WHERE parity = 'even'", "series", "series_meta")
add("keys_overwritten", lambda ks: _keys(ks.with_(series=_overwritten(ks))).select("key", "length", "memory"), "SELECT key, length, memory FROM keys", "keys")
add("ts_create", lambda ks: timeseries.create(ks.series_meta, "new", 1000, {"a": "b"}).select("key", F.coalesce("retention_ms", F.lit(0)).alias("retention_ms"), F.size("labels").alias("n_labels")), "SELECT key, CAST(0 AS BIGINT) AS retention_ms, 2 AS n_labels FROM series_meta UNION ALL SELECT 'new', 1000, 1", "series_meta")


def _madd(ks: Keyspace) -> tuple[DataFrame, DataFrame]:
    rows = ks.series.select((F.col("seq") % 100_000).cast("int").alias("pos"), "key", keyspace.SAMPLE, F.when(F.col("seq") % 5 == 0, "x").otherwise(F.col("ts_ms").cast("string")).alias("ts"), F.when(F.col("seq") % 7 == 0, "y").otherwise(F.col("seq").cast("string")).alias("value"))
    return timeseries.madd(ks.series.where("seq < 0"), rows, 0)


add("ts_madd", lambda ks: timeseries.range_(_madd(ks)[0], "-", "+").select("key", "ts_ms", "value"), "SELECT key, ts_ms, CAST(seq AS DOUBLE) AS value FROM series WHERE seq % 5 <> 0 AND seq % 7 <> 0", "series")
add("ts_madd_replies", lambda ks: _madd(ks)[1].groupBy("error").agg(F.count("*").alias("n")), "SELECT CASE WHEN seq % 5 = 0 THEN 'invalid timestamp' WHEN seq % 7 = 0 THEN 'value must be a number' END AS error, count(*) AS n FROM series GROUP BY 1", "series")


def _shuffled(ks: Keyspace) -> DataFrame:
    """The samples as if they had come in another order."""
    return ks.series.withColumn("seq", F.col("seq") * 7919 % 100_003)


add(
    "ts_retention",
    lambda ks: timeseries.retained(_shuffled(ks), ks.series_meta.withColumn("retention_ms", F.lit(7 * _DAY).cast("bigint"))).select("key", "ts_ms", "value"),
    f"SELECT key, ts_ms, value FROM (SELECT *, max(ts_ms) OVER (PARTITION BY key ORDER BY seq * 7919 % 100003 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM series) WHERE ahead IS NULL OR ts_ms >= ahead - {7 * _DAY}",
    "series",
)
add("ts_current", lambda ks: timeseries.current(timeseries.add(ks.series, ks.series.select("key", "ts_ms", (F.col("value") + 1).alias("value"), (F.col("seq") + 1_000_000_000).alias("seq"), keyspace.SAMPLE).where("seq % 2 = 0"))).select("key", "ts_ms", F.round("value", 6).alias("value")), "SELECT key, ts_ms, round(value + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END, 6) AS value FROM series", "series")
add("ts_incrby", lambda ks: _rounded(timeseries.incrby(ks.series.where("seq < 100"), ks.series.where("seq >= 100").select("key", "ts_ms", F.col("value").alias("delta"), "seq")).select("key", "ts_ms", "value"), "value"), """SELECT s.key AS key, s.ts_ms AS ts_ms, round(coalesce(b.base, 0) + sum(s.value) OVER (PARTITION BY s.key ORDER BY s.seq), 6) AS value
  FROM series s LEFT JOIN (SELECT key, arg_max(value, ts_ms) AS base FROM series WHERE seq < 100 GROUP BY key) b ON s.key = b.key WHERE s.seq >= 100""", "series")
add("ts_del", lambda ks: timeseries.del_(ks.series, "ts:click", _FROM, "+")[0].groupBy("key").agg(F.count("*").alias("n")), f"SELECT key, count(*) AS n FROM series WHERE NOT (key = 'ts:click' AND ts_ms >= {_FROM}) GROUP BY key", "series")
add("ts_info", lambda ks: timeseries.info(ks.series, ks.series_meta).drop("labels", "retention_ms"), "SELECT s.key AS key, count(*) AS total_samples, count(DISTINCT ts_ms) AS current_samples, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, 64 * count(DISTINCT ts_ms) + any_value(strlen(kind) + strlen(parity)) + 10 + 96 + 128 AS memory FROM series s JOIN series_meta m ON s.key = m.key GROUP BY s.key", "series", "series_meta")
add("ts_alter", lambda ks: timeseries.alter(ks.series_meta, "ts:click", 5000, {"site": "x"}).select("key", "retention_ms", F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("labels")), "SELECT key, CASE WHEN key = 'ts:click' THEN CAST(5000 AS BIGINT) END AS retention_ms, 'kind=' || kind || ',parity=' || parity || CASE WHEN key = 'ts:click' THEN ',site=x' ELSE '' END AS labels FROM series_meta", "series_meta")
add("ts_asof", lambda ks: timeseries.asof(ks.series.where("key = 'ts:purchase'").withColumn("key", F.lit("x")), ks.series.where("key = 'ts:click'").withColumn("key", F.lit("x"))).select("ts_ms", "value", "as_of"), "SELECT a.ts_ms AS ts_ms, a.value AS value, b.value AS as_of FROM (SELECT * FROM series WHERE key = 'ts:purchase') a ASOF LEFT JOIN (SELECT * FROM series WHERE key = 'ts:click') b ON a.ts_ms >= b.ts_ms", "series")

# Bloom filters
add("bf_info", lambda ks: bloom.info(ks.blooms), "SELECT 'seen:purchase' AS key, CAST(1000000 AS BIGINT) AS capacity, CAST(0.01 AS DOUBLE) AS fpr, CAST(0 AS BIGINT) AS items_added, CAST(ceil(-1000000 * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS bits, CAST(ceil(-log2(0.01)) AS BIGINT) AS hashes, CAST(ceil(ceil(-1000000 * ln(0.01) / pow(ln(2), 2)) / 8) AS BIGINT) AS memory, CAST(0 AS DOUBLE) AS fill_percent")
ORACLE["bf_info"] = ORACLE["bf_info"].removeprefix("WITH  ")
_BOUGHT = "key = 'type:purchase:users'"
add("bf_members", lambda ks: bloom.probe(bloom.build(ks.sets.where(_BOUGHT), "member"), ks.sets.where(_BOUGHT), "member"), f"SELECT member AS item, CAST(1 AS INTEGER) AS found FROM sets WHERE {_BOUGHT}", "sets")
add(
    "bf_exists",  # nothing that was added is missed; bf_false_positives bounds the others
    lambda ks: bloom.probe(bloom.build(ks.sets.where(_BOUGHT), "member", 10_000), ks.sets, "member", 10_000).join(ks.sets.where(_BOUGHT).select(F.col("member").alias("item"), F.lit(1).alias("added")), "item", "left").agg(F.count_if(F.expr("found = 0 and added = 1")).alias("missed")),
    "SELECT CAST(0 AS BIGINT) AS missed",
)
ORACLE["bf_exists"] = ORACLE["bf_exists"].removeprefix("WITH  ")
add(
    "bf_false_positives",
    lambda ks: bloom.probe(bloom.build(ks.sets.where(_BOUGHT), "member", 20_000, 0.01), ks.strings.select(F.concat(F.lit("x"), "value").alias("v")), "v", 20_000, 0.01).agg((F.count_if(F.expr("found = 1")) <= 0.03 * F.count("*")).alias("few"), F.count("*").alias("n")),
    "SELECT true AS few, count(DISTINCT value) AS n FROM strings",
    "strings",
)
def _added(ks: Keyspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every set's members in a filter of its own, roomy enough to tell them apart."""
    none = ks.blooms.where("key = ''")
    blooms = none.unionByName(ks.sets.select("key").distinct().select("key", F.lit(1 << 40).cast("bigint").alias("capacity"), F.lit(1e-4).alias("fpr"), F.lit(0).cast("bigint").alias("items_added")))
    items = ks.sets.select("key", F.col("member").alias("item"))
    return bloom.add(blooms, ks.sets.sparkSession.createDataFrame([], bloom.BITS), items)


add("bf_add", lambda ks: _added(ks)[2], "SELECT key, member AS item, 1 AS added FROM sets", "sets")
add("bf_add_again", lambda ks: (lambda b: bloom.add(b[0], b[1], ks.sets.select("key", F.col("member").alias("item")))[2])(_added(ks)), "SELECT key, member AS item, 0 AS added FROM sets", "sets")
add("bf_card", lambda ks: _added(ks)[0].select("key", "items_added"), "SELECT key, count(*) AS items_added FROM sets GROUP BY key", "sets")
add("bf_reserve", lambda ks: bloom.reserve(ks.blooms, "more", 500, 0.02).select("key", "capacity", "fpr"), "SELECT 'seen:purchase' AS key, CAST(1000000 AS BIGINT) AS capacity, CAST(0.01 AS DOUBLE) AS fpr UNION ALL SELECT 'more', 500, 0.02")
ORACLE["bf_reserve"] = ORACLE["bf_reserve"].removeprefix("WITH  ")

# schemas
_USER = {"user": "integer", "type": "string", "tags": "array<string>", "props": "any", "note": "string?"}
_WRONG = {"user": "string", "type": "string", "size": "float", "props": "any"}


def _validated(definition: dict[str, str]) -> Build:
    def build(ks: Keyspace) -> DataFrame:
        registry = schema.Registry()
        registry.define("event", str(definition).replace("'", '"'))
        return registry.validate(ks.json, "event").select("key", F.array_join("errors", ";").alias("errors"))

    return build


add("schema_validate", _validated(_USER), "SELECT key, '' AS errors FROM json", "json")
add("schema_validate_wrong", _validated(_WRONG), "SELECT key, 'user: expected string;size: missing;tags: unknown' AS errors FROM json", "json")



_EVENT = '{"user":7,"type":"t","tags":["a"],"props":{}}'


def _defined() -> schema.Registry:
    registry = schema.Registry()
    registry.define("event", str(_USER).replace("'", '"'))
    return registry


def _typed(ks: Keyspace) -> DataFrame:
    """Strings that are typed envelopes, beside plain ones."""
    typed = ks.json.select("key", F.concat(F.lit('{"schema_name":"event","data":'), F.col("doc"), F.lit("}")).alias("value"))
    return typed.unionByName(ks.strings)


add("tget_field", lambda ks: schema.tget(_typed(ks), "user"), "SELECT key, json_extract_string(doc, '$.user') AS value FROM json UNION ALL SELECT key, value FROM strings", "json", "strings")
add("tset", lambda ks: _defined().tset(_typed(ks), "event:new", _EVENT), """SELECT key, '{"schema_name":"event","data":' || doc || '}' AS value FROM json UNION ALL SELECT key, value FROM strings UNION ALL SELECT 'event:new', '{"data":{"props":{},"tags":["a"],"type":"t","user":7},"schema_name":"event"}'""", "json", "strings")
add("tkeys", lambda ks: schema.tkeys(_typed(ks), "event:1"), "SELECT key FROM json WHERE starts_with(key, 'event:1')", "json")

# lifecycle
_TTL = ["customer:3:name", "customer:21:name", "customer:22:name", "customer:24:name", "nobody"]
add("ttl_as_of", lambda ks: lifecycle.ttl(_keys(ks), _TTL), f"SELECT a AS key, coalesce(ttl, -2) AS ttl FROM (SELECT unnest({_TTL!r}) AS a) x LEFT JOIN keys ON a = key", "keys")
add("expire_last", lambda ks: lifecycle.expire(ks.meta, ks.meta.select("key", F.explode(F.array(F.struct((F.col("expire_ms") + 5000).alias("expire_ms"), F.lit(1).alias("seq")), F.struct((F.col("expire_ms") - 1).alias("expire_ms"), F.lit(2).alias("seq")))).alias("r")).select("key", "r.*")).select("key", "expire_ms"), "SELECT key, expire_ms - 1 AS expire_ms FROM meta", "meta")
add("purge_expired", lambda ks: lifecycle.purged(ks, AS_OF).strings, f"SELECT key, value FROM strings WHERE key NOT IN (SELECT key FROM meta WHERE expire_ms <= {AS_OF})", "strings", "meta")
add("memory_by_type", lambda ks: lifecycle.memory_by_type(_keys(ks)), "SELECT type, count(*) AS n, CAST(sum(memory) AS BIGINT) AS memory FROM keys GROUP BY type", "keys")
add("memory_of_key", lambda ks: _keys(ks).where("key = 'board:BUILDING'").select("key", "memory"), "SELECT key, memory FROM keys WHERE key = 'board:BUILDING'", "keys")


def _evicted(ks: Keyspace) -> DataFrame:
    keys = keysview.keys_view(ks).where("type = 'string'")
    access = ks.strings.select("key", (F.length("key") * 31 % 17).cast("bigint").alias("access_count"))
    return lifecycle.evicted(keys, access, 5000)


add("evict_lfu", _evicted, "SELECT key FROM (SELECT key, m, sum(m) OVER () AS used, coalesce(sum(m) OVER (ORDER BY c, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT key, strlen(value) AS m, length(key) * 31 % 17 AS c FROM strings)) WHERE used - before > 5000", "strings")

# command log
_LOG = "SELECT event_id AS seq, upper(event_type) AS op, 'user:' || user_id AS key, CAST(floor(value * 40000) AS BIGINT) AS duration_ns FROM events"


def _events(name: str, build: Callable[[DataFrame], DataFrame], query: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = keyspace.source(spark, sf_dir, "events")
        return build(e.select(F.col("event_id").alias("seq"), F.upper("event_type").alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.floor(F.col("value") * 40000).alias("duration_ns")))

    QUERIES[name] = run
    if query:
        ORACLE[name] = f"WITH log AS ({_LOG}) {query}"


_events("hotkeys", lambda df: lifecycle.hotkeys(lifecycle.accesses(df)), "SELECT key, count(*) AS access_count FROM log GROUP BY key ORDER BY 2 DESC, key LIMIT 5")
_events("stats_by_cmd", lambda df: _rounded(lifecycle.stats(df), "avg_ns"), "SELECT op, count(*) AS calls, round(avg(duration_ns), 6) AS avg_ns FROM log GROUP BY op")
_events("slowlog", lambda df: lifecycle.slowlog(df), "SELECT * FROM log WHERE duration_ns > 1000000 ORDER BY seq DESC LIMIT 128")


def _with_log(name: str, build: Callable[[DataFrame, DataFrame], DataFrame], query: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = keyspace.source(spark, sf_dir, "events")
        commands = e.select(F.col("event_id").alias("seq"), F.upper("event_type").alias("op"), F.floor(F.col("value") * 40000).alias("duration_ns"))
        return build(_keys(keyspace.from_tables(spark, sf_dir)), commands)

    QUERIES[name] = run
    ORACLE[name] = oracle(query, "keys").replace("WITH ", f"WITH log AS ({_LOG}), ", 1)


_with_log("info", lifecycle.info, "SELECT n_keys, memory, n_commands, n_slow FROM (SELECT count(*) AS n_keys, CAST(sum(memory) AS BIGINT) AS memory FROM keys), (SELECT count(*) AS n_commands, count(*) FILTER (duration_ns > 1000000) AS n_slow FROM log)")
_with_log("metrics", lifecycle.metrics, "SELECT 'keys_total' AS name, type AS label, CAST(count(*) AS DOUBLE) AS value FROM keys GROUP BY type UNION ALL SELECT 'memory_bytes', type, CAST(sum(memory) AS DOUBLE) FROM keys GROUP BY type UNION ALL SELECT 'commands_total', op, CAST(count(*) AS DOUBLE) FROM log GROUP BY op")
add("ns_stats", lambda ks: lifecycle.namespace_stats(_keys(ks)), "SELECT split_part(key, ':', 1) AS ns, count(*) AS n_keys, CAST(sum(memory) AS BIGINT) AS memory FROM keys GROUP BY 1", "keys")


_OPS = ("SET", "APPEND", "SADD", "SREM", "HSET", "ZADD", "RPUSH", "LPUSH", "LPOP", "LTRIM")
_TYPES = ("str", "str", "set", "set", "hash", "zset", "list", "list", "list", "list")


def _log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: the op by event, the key by user and op; every seventh key takes ops
    of all types. Now and then a DEL of two keys, an MSET of two, a RENAME or a GET."""
    e = keyspace.source(spark, sf_dir, "events").select(F.col("event_id").alias("e"), (F.col("user_id") % 50).alias("u"))
    one = (F.col("e") % 10 + 1).cast("int")
    op = F.when(F.col("e") % 97 == 0, "DEL").when(F.col("e") % 89 == 0, "MSET").when(F.col("e") % 101 == 0, "RENAME").when(F.col("e") % 103 == 0, "GET").otherwise(F.element_at(F.array(*map(F.lit, _OPS)), one))
    e = e.withColumns({"op": op, "kind": F.element_at(F.array(*map(F.lit, _TYPES)), one), "v": F.col("e").cast("string"), "m": (F.col("e") % 7).cast("string")})
    user = F.concat(F.lit("u"), F.col("u").cast("string"))
    after = F.concat(F.lit("u"), ((F.col("u") + 1) % 50).cast("string"), F.lit(":str"))
    key = (
        F.when(F.col("op") == "DEL", F.concat(user, F.lit(":list"))).when(F.col("op") == "MSET", F.concat(user, F.lit(":str")))
        .when((F.col("op") != "RENAME") & (F.col("e") % 7 == 0), user).otherwise(F.concat(user, F.lit(":"), "kind"))
    )
    none = F.array().cast("array<string>")
    args = (
        F.when(F.col("op") == "DEL", F.array(F.concat(user, F.lit(":set")))).when(F.col("op") == "MSET", F.array(F.col("v"), after, F.col("v"))).when(F.col("op") == "RENAME", F.array(F.concat(F.lit("r"), "v")))
        .when(F.col("op") == "HSET", F.array("m", "v")).when(F.col("op") == "ZADD", F.array("v", "m")).when(F.col("op").isin("SADD", "SREM"), F.array("m"))
        .when(F.col("op") == "LPOP", F.array(F.lit("1"))).when(F.col("op") == "LTRIM", F.array(F.lit("0"), F.lit("4"))).when(F.col("op") == "GET", none).otherwise(F.array("v"))
    )
    return e.select(F.col("e").alias("seq"), "op", key.alias("key"), args.alias("args"))


_LOG_SQL = f"""WITH RECURSIVE given AS (SELECT event_id AS e, user_id % 50 AS u, {list(_TYPES)!r}[event_id % 10 + 1] AS t, CAST(event_id AS VARCHAR) AS v, CAST(event_id % 7 AS VARCHAR) AS m,
  CASE WHEN event_id % 97 = 0 THEN 'DEL' WHEN event_id % 89 = 0 THEN 'MSET' WHEN event_id % 101 = 0 THEN 'RENAME' WHEN event_id % 103 = 0 THEN 'GET' ELSE {list(_OPS)!r}[event_id % 10 + 1] END AS op FROM events),
raw AS (SELECT e AS seq, CASE op WHEN 'MSET' THEN 'SET' ELSE op END AS op, v, m,
    CASE WHEN op = 'DEL' THEN 'u' || u || ':list' WHEN op = 'MSET' THEN 'u' || u || ':str' WHEN op <> 'RENAME' AND e % 7 = 0 THEN 'u' || u ELSE 'u' || u || ':' || t END AS key FROM given
  UNION ALL SELECT e, 'DEL', v, m, 'u' || u || ':set' FROM given WHERE op = 'DEL' UNION ALL SELECT e, 'SET', v, m, 'u' || (u + 1) % 50 || ':str' FROM given WHERE op = 'MSET'),
timed AS (SELECT *, min(CASE WHEN op IN ('DEL', 'RENAME') THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM raw),
ends AS (SELECT seq AS stop, key, op AS how FROM raw WHERE op IN ('DEL', 'RENAME')),
named AS (SELECT seq, op, v, m, CASE how WHEN 'RENAME' THEN 'r' || stop ELSE key END AS key,
  CASE WHEN op IN ('SET', 'APPEND') THEN 'string' WHEN op IN ('SADD', 'SREM') THEN 'set' WHEN op = 'HSET' THEN 'hash' WHEN op = 'ZADD' THEN 'zset' ELSE 'list' END AS kind
  FROM timed LEFT JOIN ends USING (key, stop) WHERE op NOT IN ('DEL', 'RENAME', 'GET') AND coalesce(how, '') <> 'DEL'),
alive AS (SELECT * FROM (SELECT *, max(CASE WHEN op = 'SET' THEN seq END) OVER (PARTITION BY key) AS since FROM named) WHERE since IS NULL OR seq >= since),
kinds AS (SELECT key, arg_min(kind, seq) AS kind FROM alive WHERE op NOT IN ('SREM', 'LPOP', 'LTRIM') GROUP BY key),
log AS (SELECT alive.* FROM alive JOIN kinds USING (key, kind)),
strings AS (SELECT key, string_agg(v, '' ORDER BY seq) AS value FROM log WHERE kind = 'string' GROUP BY key),
sets AS (SELECT key, m AS member FROM log WHERE kind = 'set' GROUP BY key, m HAVING arg_max(op, seq) = 'SADD'),
hashes AS (SELECT key, m AS field, arg_max(v, seq) AS value FROM log WHERE kind = 'hash' GROUP BY key, m),
zsets AS (SELECT key, m AS member, CAST(arg_max(v, seq) AS DOUBLE) AS score FROM log WHERE kind = 'zset' GROUP BY key, m),
steps AS (SELECT key, op, v, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM log WHERE kind = 'list'),
folded AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS l FROM (SELECT DISTINCT key FROM steps)
  UNION ALL SELECT f.key, f.n + 1, CASE s.op WHEN 'RPUSH' THEN list_append(l, s.v) WHEN 'LPUSH' THEN list_prepend(s.v, l) WHEN 'LPOP' THEN l[2:] ELSE l[1:5] END FROM folded f JOIN steps s ON s.key = f.key AND s.n = f.n + 1),
lists AS (SELECT key, unnest(range(len(l))) AS idx, unnest(l) AS value FROM (SELECT key, arg_max(l, n) AS l FROM folded GROUP BY key)) """


def _fold(name: str, build: Callable[[DataFrame], DataFrame], query: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_log_rows(spark, sf_dir))
    ORACLE[name] = _LOG_SQL + query


def _flat(ks: Keyspace) -> DataFrame:
    """(type, key, item, value) of a replayed keyspace."""
    parts = [
        ks.strings.select(F.lit("string").alias("type"), "key", F.lit("").alias("item"), "value"),
        ks.lists.select(F.lit("list"), "key", F.col("idx").cast("string"), "value"),
        ks.sets.select(F.lit("set"), "key", "member", F.lit("")),
        ks.hashes.select(F.lit("hash"), "key", "field", "value"),
        ks.zsets.select(F.lit("zset"), "key", "member", F.col("score").cast("bigint").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_FLAT = """SELECT 'string' AS type, key, '' AS item, value FROM strings UNION ALL SELECT 'list', key, CAST(idx AS VARCHAR), value FROM lists UNION ALL SELECT 'set', key, member, '' FROM sets
  UNION ALL SELECT 'hash', key, field, value FROM hashes UNION ALL SELECT 'zset', key, member, CAST(CAST(score AS BIGINT) AS VARCHAR) FROM zsets"""
_fold("aof_fold_sets", lambda df: log.sets(log.renamed(df)), "SELECT key, member FROM sets")
_fold("aof_fold_hashes", lambda df: log.hashes(log.renamed(df)), "SELECT key, field, value FROM hashes")
_fold("aof_fold_zsets", lambda df: log.zsets(log.renamed(df)), "SELECT key, member, score FROM zsets")
_fold("aof_fold_strings", lambda df: log.strings(log.renamed(df)), "SELECT key, value FROM strings")
_fold("aof_fold_lists", lambda df: log.lists(log.renamed(df)), "SELECT key, idx, value FROM lists")
_fold("aof_replay", lambda df: _flat(log.replay(df)), _FLAT)
_fold("aof_compaction", lambda df: _flat(log.replay(log.compacted(log.replay(df)))), _FLAT)
_fold("aof_write_filter", lambda df: df.where(log.is_write(F.col("op"))).groupBy("op").agg(F.count("*").alias("n")), "SELECT op, count(*) AS n FROM given WHERE op <> 'GET' GROUP BY op")


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.series import windowed

    e = keyspace.source(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return windowed(e, "1 day", "count", "max", slide="12 hours").select("key", F.unix_seconds("start").alias("start_s"), "count", "max")


QUERIES["ts_sliding_window"] = _windowed
ORACLE["ts_sliding_window"] = "SELECT event_type AS key, s AS start_s, count(*) AS count, max(value) AS max FROM (SELECT *, unnest([(epoch_us(ts) // 43200000000) * 43200, (epoch_us(ts) // 43200000000) * 43200 - 43200]) AS s FROM events) GROUP BY 1, 2"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.series import sessions

    e = keyspace.source(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "12 hours").groupBy("key").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES["ts_sessions"] = _sessions
ORACLE["ts_sessions"] = """WITH s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events)),
c AS (SELECT user_id, g, count(*) AS n FROM s GROUP BY 1, 2) SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1"""

__all__ = ["ORACLE", "QUERIES", "W"]
