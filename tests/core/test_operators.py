"""Operators on small literals, and against plain loops on random input."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import parsing
from quillon.operators import bloom, generic, hashes, jsondoc, keysview, lifecycle, lists, log, schema, sets, strings, timeseries, zsets
from quillon.plans import sql
from quillon.sources import keyspace


def table(spark, name, rows):
    return spark.createDataFrame(rows, keyspace.SCHEMAS[name])


@pytest.fixture(scope="module")
def small(spark):
    return keyspace.of(
        spark,
        strings=[("user:123", "a"), ("user:1", "b"), ("item:123", "é"), ("n", "5")],
        lists=[("l", 0, "a"), ("l", 1, "b"), ("l", 2, "c")],
        sets=[("s", "x"), ("s", "y"), ("t", "y")],
        zsets=[("z", "alice", 100.0), ("z", "bob", 200.0), ("z", "charlie", 150.0)],
        hashes=[("h", "f", "1"), ("h", "g", "x")],
        json=[("j", '{"a": {"b": [1, 2]}, "s": "t"}')],
        series=[("ts", 1000, 10.0, 1), ("ts", 2000, 20.0, 2)],
        series_meta=[("ts", None, {"room": "1"})],
        meta=[("user:1", "string", 5000, 1), ("n", "string", 65_500, 2)],
    )


def test_like_table(spark):
    cases = [("user:123", "user:%", True), ("user:456", "user:%", True), ("item:123", "user:%", False), ("user:1", "user:_", True), ("user:12", "user:_", False), ("hello", "%", True), ("", "%", True), ("USER:1", "user:%", True), ("É", "é", False), ("a\\b", "a\\b", True), ("a%b", "a%b", True)]
    for text, pattern, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(sql.like(F.col("t"), pattern)).first()[0]
        assert got is want, (text, pattern)


def test_keys_view_and_expiry(small):
    keys = {r.key: r for r in keysview.keys_view(small, as_of=5000).collect()}
    assert "user:1" not in keys
    assert (keys["item:123"].memory, keys["item:123"].length, keys["item:123"].ttl, keys["item:123"].value) == (2, 2, -1, "é")
    assert (keys["n"].ttl, keys["z"].memory, keys["l"].length, keys["h"].memory, keys["j"].length) == (60, 60, 3, 4, 1)
    assert keys["ts"].memory == 2 * 64 + 4 + 1 + 48 + 128 and keys["j"].value == "<json>"


def test_sql_statements(small):
    keys = keysview.keys_view(small)
    run = lambda s, **k: sql.query(keys, s, **k)
    assert {r.key for r in run("SELECT key FROM keys WHERE key LIKE 'USER:%'").collect()} == {"user:123", "user:1"}
    assert run("SELECT COUNT(*) AS n FROM keys WHERE NOT type = 'string' AND length > 1").first().n == 5
    gone = run("DELETE FROM keys WHERE key IN ('l', 's')")
    assert gone.count == 2 and gone.remaining.count() == keys.count() - 2
    assert run("DELETE FROM keys").remaining.count() == 0
    assert "Scan" in sql.explain(keys, "SELECT key FROM keys") or "Logical" in sql.explain(keys, "SELECT key FROM keys")
    with pytest.raises(sql.InvalidTable):
        run("SELECT * FROM others")
    with pytest.raises(sql.InvalidColumn):
        run("SELECT nothing FROM keys")
    with pytest.raises(sql.UnsupportedQuery):
        run("UPDATE keys SET key = 1")
    with pytest.raises(sql.UnsupportedQuery):
        run("SELECT key FROM keys; SELECT key FROM keys")
    with pytest.raises(sql.ParseFailure):
        run("SELECT key FROM keys WHERE")


def test_sql_compat(small):
    keys = keysview.keys_view(small)
    run = lambda s: sql.query(keys, s, compat=True)
    n = keys.count()
    assert run("SELECT COUNT(*) FROM keys").first()[0] == n
    assert run("SELECT key FROM keys WHERE key IN ('l') LIMIT 1").count() == n
    assert run("SELECT key FROM keys WHERE key BETWEEN 'a' AND 'b' AND type = 'set'").count() == 2
    assert run("SELECT key FROM keys WHERE key NOT LIKE 'user:%'").count() == 2
    assert run("SELECT key FROM keys WHERE ttl = -1").count() == 0
    assert run("SELECT key AS length FROM keys WHERE key = 'l'").first()[0] == "3"
    assert run("SELECT key AS x FROM keys WHERE key = 'l'").first()[0] == "NULL"
    assert run("SELECT memory FROM keys WHERE length > 2 OR (type = 'set' AND length < 2)").first()[0] is not None
    with pytest.raises(sql.InvalidColumn):
        run("SELECT nothing FROM keys")


def test_scan_pages_cover_all_keys(small):
    keys = keysview.keys_view(small)
    seen, cursor, total = [], 0, keys.count()
    while True:
        seen += [r.key for r in keysview.scan_page(keys, cursor, 4).orderBy("pos").collect()]
        cursor = keysview.next_cursor(total, cursor, 4)
        if not cursor:
            break
    assert seen == sorted(r.key for r in keys.select("key").collect())


def test_strings(spark, small):
    s = small.strings
    assert [r.value for r in strings.mget(s, ["n", "no", "n"]).orderBy("pos").collect()] == ["5", None, "5"]
    one = lambda k, d: strings.incr(s, spark.createDataFrame([(k, d)], "key string, delta bigint")).first().value
    assert one("new", 1) == 1 and one("n", 1) == 6 and one("n", -2) == 3
    with pytest.raises(Exception, match="integer"):
        one("user:1", 1)
    slices = {(0, -1): "hello", (1, 3): "ell", (-3, -2): "ll", (3, 1): "", (0, 99): "hello", (7, 9): ""}
    for (a, b), want in slices.items():
        assert spark.createDataFrame([("hello",)], "v string").select(strings.getrange(F.col("v"), a, b)).first()[0] == want
    assert spark.createDataFrame([("ab",)], "v string").select(strings.setrange(F.col("v"), 4, "x")).first()[0] == "ab\0\0x"
    assert strings.setnx(s, keysview.keys_view(small), "l", "v").count() == s.count()
    assert strings.setnx(s, keysview.keys_view(small), "fresh", "v").count() == s.count() + 1
    old, new = strings.getset(small, "n", "7")
    assert old.first().value == "5" and strings.get(new.strings, "n").first().value == "7"
    ks = strings.set_(small, [("l", "x"), ("s", "y")])
    assert {r.key: r.type for r in keysview.keys_view(ks).collect() if r.key in ("l", "s")} == {"l": "string", "s": "string"} and ks.lists.where("key = 'l'").count() == 0
    ks = strings.setex(small, "l", 60, "x", 1000)
    assert ks.meta.where("key = 'l'").first().expire_ms == 61_000 and keysview.keys_view(ks, 60_999).where("key = 'l'").first().ttl == 0 and keysview.keys_view(ks, 61_000).where("key = 'l'").count() == 0
    assert generic.ping(spark).first()[0] == "PONG" and generic.ping(spark, "hi").first()[0] == "hi"
    with pytest.raises(generic.WrongType):
        strings.getset(small, "l", "x")


def by_place(df, key):
    return [r.value for r in df.where(F.col("key") == key).orderBy("idx").collect()]


def test_lists(small):
    l = small.lists  # noqa: E741
    assert by_place(lists.push(l, "l", ["x", "y"], True), "l") == ["y", "x", "a", "b", "c"]
    assert by_place(lists.push(l, "l", ["x", "y"], False), "l") == ["a", "b", "c", "x", "y"]
    for a, b, want in [(0, -1, "abc"), (1, 1, "b"), (-2, -1, "bc"), (2, 0, ""), (-9, 9, "abc"), (0, -4, "")]:
        assert "".join(by_place(lists.lrange(l, a, b), "l")) == want
        assert "".join(by_place(lists.ltrim(l, a, b), "l")) == want
    gone, rest = lists.pop(l, "l", 2)
    assert [r.value for r in gone.orderBy("pos").collect()] == ["a", "b"] and by_place(rest, "l") == ["c"]
    gone, rest = lists.pop(l, "l", 2, left=False)
    assert [r.value for r in gone.orderBy("pos").collect()] == ["c", "b"] and by_place(rest, "l") == ["a"]
    assert by_place(lists.linsert(l, "b", "n"), "l") == ["a", "n", "b", "c"]
    assert by_place(lists.linsert(l, "b", "n", before=False), "l") == ["a", "b", "n", "c"]
    assert by_place(lists.lset(l, "l", -1, "z"), "l") == ["a", "b", "z"]
    with pytest.raises(IndexError):
        lists.lset(l, "l", 3, "z")
    assert lists.lpos(l, "c").first().idx == 2 and lists.lindex(l, -3).first().value == "a" and lists.lindex(l, 3).count() == 0


def test_sets(small):
    s = small.sets
    new, added = sets.sadd(s, sets.rows(s, "s", ["x", "z", "z"]))
    assert added.first().added == 1 and new.count() == 4
    left, removed = sets.srem(s, sets.rows(s, "s", ["x", "q"]))
    assert removed.first().removed == 1 and left.count() == 2
    members = lambda df: {r.member for r in df.collect()}
    assert members(sets.sunion(s, ["s", "t", "no"])) == {"x", "y"}
    assert members(sets.sinter(s, ["s", "t"])) == {"y"} and members(sets.sinter(s, ["s", "no"])) == set()
    assert members(sets.sdiff(s, ["s", "t", "no"])) == {"x"} and members(sets.sdiff(s, ["s"])) == {"x", "y"}


def test_sorted_sets(spark, small):
    z = small.zsets
    assert {m: zsets.zrank(z, m).first().rank for m in ("alice", "charlie", "bob")} == {"alice": 0, "charlie": 1, "bob": 2}
    assert [r.member for r in zsets.zrange(z, 0, 1).orderBy("rank").collect()] == ["alice", "charlie"]
    assert [r.member for r in zsets.zrevrange(z, 0, 1).orderBy("rank").collect()] == ["bob", "charlie"]
    assert [r.member for r in zsets.zrevrange(z, 0, 1, compat=True).orderBy("rank").collect()] == ["charlie", "alice"]
    assert zsets.zrange(z, 0, -4).count() == 0
    assert zsets.zrangebyscore(z, "(100", "200").count() == 2 and zsets.zcount(z, "-inf", "(200").first().n == 2
    rows = lambda *r: spark.createDataFrame([("z", m, s, i) for i, (m, s) in enumerate(r)], "key string, member string, score double, pos int")
    score = lambda df, m: {r.member: r.score for r in df.collect()}.get(m)
    new, n = zsets.zadd(z, rows(("alice", 1.0), ("dora", 2.0), ("dora", float("nan"))))
    assert score(new, "alice") == 1.0 and score(new, "dora") == 0.0 and n.first().n == 3
    new, n = zsets.zadd(z, rows(("alice", 1.0), ("dora", 2.0)), nx=True)
    assert score(new, "alice") == 100.0 and score(new, "dora") == 2.0 and n.first().n == 1
    new, n = zsets.zadd(z, rows(("alice", 150.0), ("alice", 120.0), ("dora", 2.0)), xx=True, gt=True)
    assert score(new, "alice") == 150.0 and score(new, "dora") is None and n.first().n == 1
    assert zsets.zadd(z, rows(("alice", 100.0)), ch=True)[1].first().n == 1
    with pytest.raises(ValueError):
        zsets.zadd(z, rows(("a", 1.0)), nx=True, xx=True)
    gone, rest = zsets.zpop(z, highest=True)
    assert gone.first().member == "bob" and rest.count() == 2


def test_hashes(spark, small):
    h = small.hashes
    new, added = hashes.hset(h, spark.createDataFrame([("h", "f", "2", 0), ("h", "k", "3", 1), ("h", "k", "4", 2)], "key string, field string, value string, pos int"))
    assert added.first().added == 1 and {(r.field, r.value) for r in new.collect()} == {("f", "2"), ("g", "x"), ("k", "4")}
    steps = spark.createDataFrame([("h", "f", 2), ("h", "g", 1), ("h", "q", 5)], "key string, field string, delta bigint")
    assert {r.field: r.value for r in hashes.hincrby(h, steps).collect()} == {"f": 3, "g": 1, "q": 5}
    assert hashes.hgetall(h).first().fields == {"f": "1", "g": "x"}


def test_json(spark):
    docs = spark.createDataFrame([('{"a": {"b": [1, 2.5, null]}, "s": "t", "t": true}',)], "d string")
    one = lambda c: docs.select(c).first()[0]
    d = F.col("d")
    assert one(jsondoc.get(d, "$.a.b")) == "[1,2.5,null]" and one(jsondoc.get(d, "s")) == '"t"' and one(jsondoc.get(d, "$.no")) is None
    assert one(jsondoc.get(d, "$..b")) == "[1,2.5,null]" and one(jsondoc.get(d, "$.a.b[*]")) == "[1,2.5,null]"
    kinds = {"$": "object", "$.a.b": "array", "$.a.b[0]": "integer", "$.a.b[1]": "number", "$.a.b[2]": "null", "$.s": "string", "$.t": "boolean", "$.no": "null"}
    assert {p: one(jsondoc.type_of(d, p)) for p in kinds} == kinds
    assert one(jsondoc.get(jsondoc.set_(d, "$.x.y[2]", "7"), "$.x")) == '{"y":[null,null,7]}'
    assert one(jsondoc.get(jsondoc.set_(d, "$.s", "1", nx=True), "s")) == '"t"' and one(jsondoc.get(jsondoc.set_(d, "$.q", "1", xx=True), "q")) is None
    assert one(jsondoc.get(jsondoc.del_(d, "a.b.0"), "a.b")) == "[2.5,null]"
    assert one(jsondoc.arrlen(jsondoc.arrappend(d, "$.a.b", "1", '"x"'), "$.a.b")) == 5 and one(jsondoc.arrlen(d, "$.s")) is None
    assert one(jsondoc.numincrby(d, "$.a.b[0]", 1.5)) == 2.5 and one(jsondoc.numincrby(d, "$.s", 1)) is None
    assert one(jsondoc.get(jsondoc.incremented(d, "$.a.b[0]", 1.5), "a.b")) == "[2.5,2.5,null]" and one(jsondoc.get(jsondoc.incremented(d, "$.s", 1), "s")) == '"t"'


def loop_retention(samples, retention):
    live = {}
    for t, v in samples:
        live[t] = v
        live = {k: x for k, x in live.items() if k >= t - retention}
    return live


def test_series_against_loops(spark):
    rng = random.Random(3)
    meta = table(spark, "series_meta", [("k", 50, {})])
    for _ in range(5):
        samples = [(rng.randrange(200), float(i)) for i in range(30)]
        df = table(spark, "series", [("k", t, v, i) for i, (t, v) in enumerate(samples)])
        assert {r.ts_ms: r.value for r in timeseries.retained(df, meta).collect()} == loop_retention(samples, 50)
        start, stop, width = rng.randrange(50), 100 + rng.randrange(90), rng.randrange(1, 40)
        live = dict(samples)
        want = {}
        for t, v in live.items():
            if start <= t <= stop:
                want.setdefault(start + (t - start) // width * width, []).append(v)
        got = timeseries.aggregated(timeseries.current(df), start, stop, width, "count", "RANGE")
        assert {r.bucket_ms: (r["count"], r["range"]) for r in got.collect()} == {b: (len(v), max(v) - min(v)) for b, v in want.items()}
    fixture = table(spark, "series", [("k", t, float(v), t) for t, v in ((0, 10), (1000, 20), (2000, 30), (3000, 40))])
    assert [r["avg"] for r in timeseries.aggregated(fixture, 0, 4000, 2000, "AVG").orderBy("bucket_ms").collect()] == [15.0, 35.0]
    assert timeseries.aggregated(fixture, "-", "+", 2000, "std.p").count() == 3  # anchored at the least time
    assert timeseries.range_(fixture, 500, 2500).count() == 2 and timeseries.range_(fixture, 9, 1).count() == 0
    left, n = timeseries.del_(fixture, "k", 1000, 2000)
    assert left.count() == 2 and n.first().n == 2


def test_eviction_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(f"k{i}", rng.randrange(1, 50), rng.choice([None, rng.randrange(4)])) for i in range(25)]
        limit, protected = rng.randrange(600), "k3"
        used, gone = sum(m for _, m, _ in rows), set()
        for k, m, _ in sorted((r for r in rows if r[2] is not None and r[0] != protected), key=lambda r: (r[2], r[0])):
            if used <= limit:
                break
            used -= m
            gone.add(k)
        keys = spark.createDataFrame([(k, m) for k, m, _ in rows], "key string, memory bigint")
        access = spark.createDataFrame([(k, c) for k, _, c in rows], "key string, access_count bigint")
        assert {r.key for r in lifecycle.evicted(keys, access, limit, protected).collect()} == gone


def test_expiry_and_namespaces(spark, small):
    keys = keysview.keys_view(small, 5000)
    assert {r.key: r.ttl for r in lifecycle.ttl(keys, ["n", "l", "no", "user:1"]).collect()} == {"n": 60, "l": -1, "no": -2, "user:1": -2}
    spaces = lifecycle.Namespaces({"default": small})
    spaces.create("tenant_a", keyspace.empty(spark), limit=100)
    for bad in ("tenant_a", "", "a b", "x" * 65):
        with pytest.raises(ValueError):
            spaces.create(bad, small)
    assert {r.ns: r.n_keys for r in spaces.stats().collect()} == {"default": keysview.keys_view(small).count(), "tenant_a": 0}
    with pytest.raises(ValueError):
        spaces.delete("default")
    spaces.use("tenant_a")
    spaces.delete("tenant_a")
    assert spaces.list() == ["default"] and spaces.current == "default"


def test_rename_and_types(small):
    moved = generic.rename(small, "s", "t")
    assert {r.member for r in sets.smembers(moved.sets, "t").collect()} == {"x", "y"} and sets.smembers(moved.sets, "s").count() == 0
    assert generic.rename(small, "s", "t", True, keysview.keys_view(small)) is small
    with pytest.raises(generic.WrongType):
        generic.expect(keysview.keys_view(small), "s", "list")
    assert generic.without(small, ["s", "no"]).sets.count() == 1


def test_schemas(spark):
    r = schema.Registry()
    r.define("user", '{"id":"integer","name":"string","active":"boolean"}')
    r.define("profile", "{name: string, bio: string?}")
    r.define("tags", '{"items":"array<string>"}')
    wrong = lambda name, doc: r.validate(spark.createDataFrame([(doc,)], "doc string"), name).first().errors
    assert wrong("user", '{"id":1,"name":"x","active":true}') == []
    assert wrong("user", '{"id":5.0,"name":"x","active":true}') == []
    assert wrong("user", '{"id":5.5,"name":"x","active":true}') == ["id: expected integer"]
    assert wrong("user", '{"id":"1","name":"x"}') == ["id: expected integer", "active: missing"]
    assert wrong("user", "[1]") == ["not an object"] and wrong("user", "no") == ["not an object"]
    for doc in ('{"name":"a"}', '{"name":"a","bio":"b"}', '{"name":"a","bio":null}'):
        assert wrong("profile", doc) == []
    assert wrong("profile", '{"name":"a","x":1}') == ["x: unknown"]
    assert wrong("tags", '{"items":["a","b"]}') == [] and wrong("tags", '{"items":["a",1]}') != []
    assert str(schema.parse_type("ARRAY<int>")) == "array<integer>" and str(schema.parse_type("str?")) == "string?"
    with pytest.raises(ValueError):
        schema.parse_type("decimal")
    assert r.list() == ["profile", "tags", "user"] and r.drop("tags") and not r.drop("tags")


def test_log_replay_and_compaction(spark):
    rows = [
        (1, "SET", "a", ["x"]), (2, "APPEND", "a", ["y"]), (3, "SADD", "s", ["1", "2"]), (4, "SREM", "s", ["1"]), (5, "ZADD", "z", ["1.5", "m"]),
        (6, "HSET", "h", ["f", "1", "f", "2"]), (7, "RPUSH", "l", ["a", "b", "c"]), (8, "LPOP", "l", []), (9, "RENAME", "a", ["b"]), (10, "APPEND", "b", ["z"]),
        (11, "DEL", "h", []), (12, "HSET", "h", ["g", "3"]), (13, "INCR", "c", []), (14, "INCRBY", "c", ["4"]), (15, "GET", "c", []),
    ]
    ks = log.replay(spark.createDataFrame(rows, log.SCHEMA))

    def check(ks):
        assert {(r.key, r.value) for r in ks.strings.collect()} == {("b", "xyz"), ("c", "5")}
        assert [tuple(r) for r in ks.sets.collect()] == [("s", "2")] and [tuple(r) for r in ks.hashes.collect()] == [("h", "g", "3")]
        assert [tuple(r) for r in ks.zsets.collect()] == [("z", "m", 1.5)] and by_place(ks.lists, "l") == ["b", "c"]

    check(ks)
    check(log.replay(log.compacted(ks)))
    assert log.is_write("hset") and log.is_write("ZADD") and not log.is_write("GET")


def test_snapshots_and_logs_on_disk(spark, small, tmp_path):
    keyspace.save(small, str(tmp_path / "snap"))
    again = keyspace.load(spark, str(tmp_path / "snap"))
    assert sorted(keysview.keys_view(again).collect()) == sorted(keysview.keys_view(small).collect())
    rows = spark.createDataFrame([(1, "SET", "a", ["x"]), (2, "GET", "a", [])], log.SCHEMA)
    log.write(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("{nothing\n")
    assert [r.op for r in log.read(spark, str(tmp_path / "log")).collect()] == ["SET"]


def test_log_replay_follows_keys_through_types_and_names(spark):
    def state(rows):
        ks = log.replay(spark.createDataFrame(rows, log.SCHEMA))
        out = {r.key: r.value for r in ks.strings.collect()}
        for r in sorted(ks.lists.collect()):
            out.setdefault(r.key, []).append(r.value)
        for r in ks.sets.collect():
            out.setdefault(r.key, set()).add(r.member)
        for r in ks.hashes.collect():
            out.setdefault(r.key, {})[r.field] = r.value
        return out

    assert state([(1, "MSET", "k1", ["1", "k2", "2"]), (2, "RPUSH", "l", ["a"]), (3, "SET", "l", ["s"]), (4, "SET", "x", ["1"]), (5, "DEL", "y", ["x"]), (6, "SADD", "l", ["no"]), (7, "mset", "k3", ["3"])]) == {"k1": "1", "k2": "2", "l": "s", "k3": "3"}
    many = [x for i in range(1500) for x in (f"f{i}", "old")]
    got = state([(1, "HSET", "h", many), (2, "HSET", "h", ["f1499", "new"]), (3, "HSET", "h", ["f0", "a", "f0", "b", "odd"])])["h"]
    assert len(got) == 1500 and got["f1499"] == "new" and got["f0"] == "b" and got["f7"] == "old"
    rows = [
        (1, "SADD", "a", ["1"]), (2, "RENAME", "a", ["b"]), (3, "RENAME", "b", ["c"]), (4, "SADD", "a", ["2"]), (5, "SADD", "c", ["3"]),
        (6, "RENAME", "nobody", ["a"]), (7, "SET", "d", ["x"]), (8, "RENAME", "d", ["e"]), (9, "SET", "e", ["y"]), (10, "SADD", "z", ["9"]), (11, "RENAME", "z", ["z"]),
        (12, "SET", "p", ["p"]), (13, "SET", "q", ["q"]), (14, "RENAME", "p", ["t"]), (15, "RENAME", "q", ["p"]), (16, "RENAME", "t", ["q"]), (17, "RPUSH", "far", ["1"]),
    ]
    rows += [(100 + i, "RENAME", "far" if i == 0 else f"far{i}", [f"far{i + 1}"]) for i in range(20)] + [(200, "RPUSH", "far20", ["2"]), (201, "DEL", "c", [])]
    assert state(rows) == {"a": {"2"}, "e": "y", "z": {"9"}, "p": "q", "q": "p", "far20": ["1", "2"]}
    assert state([(1, "ZADD", "z", ["NX", "CH", "1", "m"]), (2, "LPOP", "none", []), (3, "SREM", "no", ["x"])]) == {}


def test_compaction_writes_chunks(spark, monkeypatch):
    monkeypatch.setattr(log, "CHUNK", 7)
    ks = keyspace.of(spark, lists=[("l", i, f"v{i}") for i in range(40)], sets=[("s", str(i)) for i in range(30)], zsets=[("z", str(i), i / 2) for i in range(20)], hashes=[("h", str(i), "x") for i in range(25)], strings=[("k", "v")])
    short = log.compacted(ks)
    assert short.where("size(args) > 40").count() == 0 and short.where("op = 'RPUSH'").count() == 6 and short.select("seq").distinct().count() == short.count()
    again = log.replay(short)
    assert by_place(again.lists, "l") == [f"v{i}" for i in range(40)]
    for name in ("strings", "sets", "zsets", "hashes"):
        assert sorted(getattr(again, name).collect()) == sorted(getattr(ks, name).collect())


def test_series_are_read_as_overwritten(spark):
    s = spark.createDataFrame([("k", 1000, 1.0, 1), ("k", 1000, 5.0, 2), ("k", 2000, 2.0, 3)], keyspace.SCHEMAS["series"])
    meta = spark.createDataFrame([("k", None, {"a": "b"})], keyspace.SCHEMAS["series_meta"])
    assert sorted((r.ts_ms, r.value) for r in timeseries.range_(s, "-", "+").collect()) == [(1000, 5.0), (2000, 2.0)]
    r = timeseries.aggregated(s, 0, "+", 10_000, "sum", "count").first()
    assert (r["sum"], r["count"]) == (7.0, 2)
    assert sorted((r.ts_ms, r.value) for r in timeseries.mrange(s, meta, "-", "+", {"a": "b"}).collect()) == [(1000, 5.0), (2000, 2.0)]
    ks = keyspace.empty(spark).with_(series=s, series_meta=meta)
    assert keysview.keys_view(ks).first().length == 2
    rows = spark.createDataFrame([(0, "k", "1000", "7"), (1, "k", "x", "1"), (2, "n", "*", "1"), (3, "n", "5", "y")], "pos int, key string, ts string, value string")
    new, replies = timeseries.madd(s, rows, 42)
    assert [tuple(r) for r in replies.orderBy("pos").collect()] == [(0, 1000, None), (1, None, "invalid timestamp"), (2, 42, None), (3, None, "value must be a number")]
    assert sorted((r.key, r.ts_ms, r.value) for r in timeseries.range_(new, "-", "+").collect()) == [("k", 1000, 7.0), ("k", 2000, 2.0), ("n", 42, 1.0)]


def test_json_keys(spark):
    t = spark.createDataFrame([("a", '{"x":1}'), ("bad", "{no"), ("none", None)], "key string, doc string")
    docs = lambda df: {r.key: r.doc for r in df.collect()}
    assert docs(jsondoc.set_key(t, "a", "$.y.z", "2"))["a"] == '{"x":1,"y":{"z":2}}' and docs(jsondoc.set_key(t, "new", "$.y", "2"))["new"] == '{"y":2}' and docs(jsondoc.set_key(t, "new", "$", "[1]"))["new"] == "[1]"
    assert jsondoc.set_key(t, "a", "$", "1", nx=True) is t and jsondoc.set_key(t, "b", "$", "1", xx=True) is t
    assert "a" not in docs(jsondoc.del_key(t, "a")) and docs(jsondoc.del_key(t, "a", "$.x"))["a"] == "{}"
    assert docs(t.withColumn("doc", jsondoc.set_(F.col("doc"), "$.q", "1"))) == {"a": '{"q":1,"x":1}', "bad": "{no", "none": None}
    assert [r[0] for r in t.select(jsondoc.get(F.col("doc"), "$..x")).collect()] == ["1", None, None]
    with pytest.raises(ValueError):
        jsondoc.set_key(t, "a", "$", "{no")


def test_keyed_blooms(spark):
    none = keyspace.empty(spark).blooms
    bits = spark.createDataFrame([], bloom.BITS)
    blooms = bloom.reserve(none, "small", 100, 0.01)
    with pytest.raises(ValueError):
        bloom.reserve(blooms, "small", 100)
    items = spark.createDataFrame([("small", str(i)) for i in range(50)] + [("made", "x"), ("made", "x")], "key string, item string")
    blooms, bits, replies = bloom.add(blooms, bits, items)
    assert {r.added for r in replies.collect()} == {1} and bloom.card(blooms, "small").first().n == 50 and bloom.card(blooms, "made").first().n == 1 and bloom.card(blooms, "no").first().n == 0
    blooms, bits, replies = bloom.add(blooms, bits, items)
    assert {r.added for r in replies.collect()} == {0} and bloom.card(blooms, "small").first().n == 50
    assert {r.found for r in bloom.exists(blooms, bits, items).collect()} == {1}
    assert {(r.key, r.found) for r in bloom.exists(blooms, bits, spark.createDataFrame([("made", "1"), ("no", "x")], "key string, item string")).collect()} == {("made", 0), ("no", 0)}
    assert {r.key for r in bloom.drop(blooms, bits, "made")[1].select("key").distinct().collect()} == {"small"}


def test_config_source(spark, tmp_path):
    from quillon.sources import config

    assert config.load(tmp_path / "none.toml") == config.DEFAULTS
    (tmp_path / "c.toml").write_text('[memory]\nmax_memory = "64MB"\n[server]\nport = 1\n')
    got = config.load(tmp_path / "c.toml")
    assert got["memory.max_memory"] == "64MB" and got["server.port"] == 1 and got["logging.level"] == "info"
    assert {r.name: r.value for r in config.table(spark, got).collect()}["persistence.aof_enabled"] == "false"
    (tmp_path / "c.toml").write_text("[broken")
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.toml")


def test_parsing():
    assert parsing.memory_size("256MB") == 256 << 20 and parsing.memory_size("1024") == 1024 and parsing.memory_size("1gb") == 1 << 30
    assert parsing.format_size(1536) == "1.50 KB" and parsing.score_bound("(5") == (5.0, True) and parsing.score_bound("(5", strict=False) == (5.0, False)
    assert parsing.timestamp("-") == parsing.I64_MIN and parsing.timestamp("*", 7) == 7
    for bad in ("", "x", "12QB"):
        with pytest.raises(ValueError):
            parsing.memory_size(bad)


def test_streams(spark, tmp_path):
    from quillon.streaming import series as streams

    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("k", 100, 1.0, 1), ("k", 500, 2.0, 2), ("k", 900, 3.0, 3), ("k", 1500, 4.0, 4), ("k", 600, 5.0, 5)], keyspace.SCHEMAS["series"]).coalesce(1).write.mode("overwrite").parquet(str(src))
    stream = spark.readStream.schema(keyspace.SCHEMAS["series"]).parquet(str(src))
    q = streams.retained(stream, 1000).writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("kept").collect()] == [("k", 4, 500, 1500)]
    timed = stream.withColumn("ts", F.timestamp_millis("ts_ms"))
    q = streams.windowed(timed, "1 second", "count", "max").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["count"], r["max"]) for r in spark.table("w").collect()) == [(1, 4.0), (4, 5.0)]
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.createDataFrame([(1, "SET", "a", ["x"]), (2, "GET", "a", [])], log.SCHEMA).coalesce(1).write.mode("overwrite").json(str(logs))
    q = streams.log_sink(spark.readStream.schema(log.SCHEMA).json(str(logs)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_plans(spark, small):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = keysview.keys_view(small)
    assert "member" not in plan(keys.where("type = 'string'"))
    assert "TakeOrderedAndProject" in plan(lifecycle.hotkeys(spark.range(9).selectExpr("cast(id as string) as key", "id as access_count")))


def test_bits_of_one_filter_are_made_and_merged_in_many_tasks(spark):
    rows = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    items = spark.range(4000).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("item"))
    blooms = spark.range(1).select(F.lit("hot").alias("key"), F.lit(1 << 40).alias("capacity"), F.lit(1e-4).alias("fpr"), F.lit(0).cast("bigint").alias("items_added"))
    for made in (bloom._words(items, blooms), bloom.add(blooms, spark.createDataFrame([], bloom.BITS), items)[1]):
        assert len(rows(made)) > 1 and max(rows(made)) < 0.6 * sum(rows(made)) and sum(rows(made)) > 0.99 * 4000 * 14


def test_blooms_of_repeated_null_and_unknown_items(spark):
    items = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x"), (None, "x")], "key string, item string")
    blooms, bits, replies = bloom.add(bloom.reserve(keyspace.empty(spark).blooms, "a", 10), spark.createDataFrame([], bloom.BITS), items.where("key = 'a'"))
    assert sorted((r.key, r.item or "", r.added) for r in replies.collect()) == [("a", "", 1), ("a", "x", 1)]
    assert sorted((r.key or "", r.item or "", r.found) for r in bloom.exists(blooms, bits, items).collect()) == [("", "x", 0), ("a", "", 1), ("a", "x", 1), ("b", "x", 0)]
