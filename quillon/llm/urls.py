"""URL filters: a sort-merge range join on reversed-host keys.

A rule (host, path prefix) fits its host and all subdomains. Each url has a key for its
host and for each domain above it: that domain's labels, reversed, a ``/`` (which no host
has) and the url's path. A rule is then the interval of all keys that begin with its own,
and intervals are nested or apart. Keys and rules are cut into ranges of about equal
size at sampled bounds, and each range is sorted and swept once with a stack of the
rules that are open; the top of the stack is the longest that fits. A rule goes to every
range that its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import base

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys for each range; their number, and so what the driver gets, is bounded.
SAMPLES = 32


def host_and_path(url):
    """(host, path) columns: the host stands after the first ``://`` up to ``/``, ``?``,
    ``#`` or the end, A-Z in lower case, the path from there up to ``?``, ``#`` or the
    end. Null or without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host, upto=None):
    labels = F.reverse(F.split(host, r"\."))
    return F.concat_ws(".", labels if upto is None else F.slice(labels, F.lit(1), upto))


def _ranges(bounds: list[tuple[str, int]], rules: bool):
    """Puts the range's number in front: of each key by (key, tie), of a rule once for
    each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if rules:
                rows, places = [], []
                for i, key in enumerate(keys):
                    first = last = bisect_left(bounds, (key,))
                    while last < len(bounds) and bounds[last][0].startswith(key):
                        last += 1
                    rows += [i] * (last + 1 - first)
                    places += range(first, last + 1)
                batch = batch.take(pa.array(rows, pa.int64()))
            else:
                places = [bisect_right(bounds, (k, t)) for k, t in zip(keys, ties, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), *batch.columns], names=["place", *batch.schema.names])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, key, tie, host, path, rule, verdict, is_key), sorted by place, key and
    rules first -> (host, path, rule, verdict, size) of keys that a rule fits."""
    now, stack = None, []
    names = ["host", "path", "rule", "verdict", "size"]
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for place, key, _, host, path, rule, verdict, is_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != now:
                now, stack = place, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_key:
                stack.append((key, rule, verdict))
            elif stack:
                for column, value in zip(out, (host, path, stack[-1][1], stack[-1][2], len(stack[-1][1])), strict=True):
                    column.append(value)
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages(page_id, url string, ...), rules(host, path, verdict) -> (page_id, host,
    path, rule, verdict), a row per page. rule: host and path of the longest rule that
    fits, null if none does; verdict: the rule's, else ``otherwise``.

    Rules that are equally long and both fit: the one with the longer host, then block
    before allow. Of equal rules with two verdicts, block holds. Rules with a null are
    left out. Null urls and such without ``://`` have an empty host and path. Other columns
    are ignored; repeated rows are judged alike. No rules: ``otherwise`` for all.
    """
    spark = pages.sparkSession
    n = base.parts(spark)
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id"), F.col("url").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rules = base.lean(rules, "host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict")).alias("v"))
    rules = rules.select(F.concat(_reversed(F.col("host")), F.lit("/"), "path").alias("key"), F.lit(0).cast("long").alias("tie"), "host", "path", F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("verdict"), F.lit(False).alias("is_key"))

    places = base.written(pages.select("host", "path").distinct(), "places")
    depth = F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\."))))
    keys = places.withColumn("depth", depth).select(F.concat(_reversed(F.col("host"), F.col("depth")), F.lit("/"), "path").alias("key"), F.xxhash64("host", "path").alias("tie"), "host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"), F.lit(True).alias("is_key"))
    sample = keys.select("key", "tie").orderBy(F.xxhash64("key", "tie"), "key", "tie").limit(SAMPLES * n).collect()
    sample = sorted((r.key, r.tie) for r in sample)
    step = max(1, len(sample) // n)
    bounds = sample[step::step]

    kinds = "place long, key string, tie long, host string, path string, rule string, verdict string, is_key boolean"
    both = base.mapped(keys, _ranges(bounds, False), kinds).union(base.mapped(rules, _ranges(bounds, True), kinds))
    both = both.repartition(n, "place").sortWithinPartitions("place", "key", "is_key", "tie")
    found = base.mapped(both, _sweep, "host string, path string, rule string, verdict string, size long")
    best = found.groupBy("host", "path").agg(F.max(F.struct("size", F.length(F.substring_index("rule", "/", 1)).alias("h"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: The registered query's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
places AS (SELECT DISTINCT host, path FROM split),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
"""
