"""JSON documents: (key, doc), doc as text.

Reads of plain paths (``$.a.b[0]``, ``a.b``) are VARIANT expressions; paths with ``..`` or
``*``, and all writes inside a document, are one Arrow UDF over the documents.
Values are JSON text: strings keep their quotes.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.generic import asked

STEP = re.compile(r"\.\.|\.?([^.\[\]]+)|\[(\d+|\*|'[^']*'|\"[^\"]*\")\]")


def steps(path: str) -> list[str | int]:
    """``$.a[0].b`` or ``a.0.b`` as keys and places; ``*`` and ``..`` are steps of their own."""
    text = path.removeprefix("$")
    out: list[str | int] = []
    at = 0
    while at < len(text):
        if text[at] == "." and at + 1 == len(text):
            break
        m = STEP.match(text, at)
        if not m:
            raise ValueError(f"no path: {path}")
        at = m.end()
        if m[0] == "..":
            out.append("..")
        elif m[2] is not None:
            out.append(int(m[2]) if m[2].isdigit() else m[2].strip("'\""))
        else:
            out.append(m[1])
    return out


def plain(path: str) -> bool:
    return not any(s in ("*", "..") for s in steps(path))


def variant_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps(path))


def _find(doc: Any, path: list[str | int]) -> list[Any]:
    if not path:
        return [doc]
    head, rest = path[0], path[1:]
    if head == "..":
        found = _find(doc, rest) if rest else [doc]
        inner = doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else ()
        return found + [y for x in inner for y in _find(x, path)]
    if head == "*":
        inner = list(doc.values()) if isinstance(doc, dict) else doc if isinstance(doc, list) else []
        return [y for x in inner for y in _find(x, rest)]
    if isinstance(doc, dict):
        return _find(doc[str(head)], rest) if str(head) in doc else []
    if isinstance(doc, list) and str(head).isdigit() and int(head) < len(doc):
        return _find(doc[int(head)], rest)
    return []


def dumps(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def loads(text: str | None) -> tuple[bool, Any]:
    """(whether it is a document, the document)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def get(doc: Column, path: str = "$") -> Column:
    """JSON text at the path; null where there is none. Several hits of a wildcard are an array."""
    if plain(path):
        v = F.try_parse_json(doc)
        return F.to_json(F.try_variant_get(v, variant_path(path), "variant")) if steps(path) else F.to_json(v)
    way = steps(path)

    @F.pandas_udf("string")
    def find(docs: pd.Series) -> pd.Series:
        def one(text):
            good, root = loads(text)
            if not good:
                return None
            hits = _find(root, way)
            return None if not hits else dumps(hits[0] if len(hits) == 1 else hits)

        return docs.map(one)

    return find(doc)


def mget(table: DataFrame, names: list[str], path: str = "$") -> DataFrame:
    mine = table.where(F.col("key").isin(names)).select("key", get(F.col("doc"), path).alias("value"))
    return asked(table.sparkSession, names).join(mine, "key", "left").select("pos", "key", "value")


def type_of(doc: Column, path: str = "$") -> Column:
    """null, boolean, integer, number, string, array or object; a missing path is ``null``."""
    v = F.try_parse_json(doc)
    v = F.try_variant_get(v, variant_path(path), "variant") if steps(path) else v
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer")
        .when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    )


def arrlen(doc: Column, path: str = "$") -> Column:
    return F.json_array_length(get(doc, path))


def objkeys(doc: Column, path: str = "$") -> Column:
    return F.sort_array(F.json_object_keys(get(doc, path)))


def objlen(doc: Column, path: str = "$") -> Column:
    return F.size(F.json_object_keys(get(doc, path)))


def _write(doc: Column, path: str, change) -> Column:
    """doc with change(root, steps) applied; null and malformed documents stay as they are."""
    way = steps(path)

    @F.pandas_udf("string")
    def written(docs: pd.Series) -> pd.Series:
        def one(text):
            good, root = loads(text)
            return dumps(change(root, way)) if good else text

        return docs.map(one)

    return written(doc)


def _descend(doc: Any, way: list[str | int], create: bool) -> tuple[Any, str | int] | None:
    for here, following in zip(way, way[1:], strict=False):
        fresh: Any = [] if isinstance(following, int) else {}
        if isinstance(doc, list):
            if not str(here).isdigit():
                return None
            here = int(here)
            if create:
                doc += [None] * (here + 1 - len(doc))
            if here >= len(doc):
                return None
            if create and not isinstance(doc[here], (dict, list)):
                doc[here] = fresh
            doc = doc[here]
        elif isinstance(doc, dict):
            here = str(here)
            if here not in doc or create and not isinstance(doc[here], (dict, list)):
                if not create:
                    return None
                doc[here] = fresh
            doc = doc[here]
        else:
            return None
    return doc, way[-1]


def set_(doc: Column, path: str, value: str, nx: bool = False, xx: bool = False) -> Column:
    """JSON.SET: missing objects and arrays on the way are made, short arrays padded with null."""

    def change(root: Any, way: list) -> Any:
        new = json.loads(value)
        there = bool(_find(root, way))
        if nx and there or xx and not there:
            return root
        if not way:
            return new
        if not isinstance(root, (dict, list)):
            root = {}
        found = _descend(root, way, True)
        if found:
            box, last = found
            if isinstance(box, list) and str(last).isdigit():
                box += [None] * (int(last) + 1 - len(box))
                box[int(last)] = new
            elif isinstance(box, dict):
                box[str(last)] = new
        return root

    return _write(doc, path, change)


def del_(doc: Column, path: str) -> Column:
    def change(root: Any, way: list) -> Any:
        found = _descend(root, way, False) if way else None
        if found:
            box, last = found
            if isinstance(box, dict):
                box.pop(str(last), None)
            elif isinstance(box, list) and str(last).isdigit() and int(last) < len(box):
                del box[int(last)]
        return root if way else None

    return _write(doc, path, change)


def arrappend(doc: Column, path: str, *values: str) -> Column:
    """The document with the values behind the array at the path; arrlen() of it is the reply."""
    def change(root: Any, way: list) -> Any:
        for hit in _find(root, way):
            if isinstance(hit, list):
                hit += [json.loads(v) for v in values]
        return root

    return _write(doc, path, change)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def numincrby(doc: Column, path: str, by: float) -> Column:
    """The number at the path plus ``by``, as a double; null where there is none. This is the
    reply; incremented() is the document behind it."""
    v = F.try_parse_json(doc)
    v = F.try_variant_get(v, variant_path(path), "variant") if steps(path) else v
    s = F.schema_of_variant(v)
    number = (s == "BIGINT") | s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT")
    return F.when(number, F.try_variant_get(v, "$", "double") + F.lit(float(by)))


def incremented(doc: Column, path: str, by: float) -> Column:
    """The document with ``by`` added to the number at the path; as it is where there is none."""

    def change(root: Any, way: list) -> Any:
        if not way:
            return float(root) + by if _number(root) else root
        found = _descend(root, way, False)
        if found:
            box, last = found
            if isinstance(box, dict) and _number(box.get(str(last))):
                box[str(last)] = float(box[str(last)]) + by
            elif isinstance(box, list) and str(last).isdigit() and int(last) < len(box) and _number(box[int(last)]):
                box[int(last)] = float(box[int(last)]) + by
        return root

    return _write(doc, path, change)


def set_key(table: DataFrame, key: str, path: str, value: str, nx: bool = False, xx: bool = False) -> DataFrame:
    """JSON.SET key path value: a missing key is made, from an empty object if the path is
    not the root; NX and XX ask for the key."""
    if nx and xx:
        raise ValueError("NX and XX are mutually exclusive")
    there = table.where(F.col("key") == key).limit(1).count() > 0
    if nx and there or xx and not there:
        return table
    json.loads(value)
    doc = F.lit(value) if not steps(path) else set_(F.col("doc"), path, value)
    if there:
        return table.withColumn("doc", F.when(F.col("key") == key, doc).otherwise(F.col("doc")))
    fresh = table.sparkSession.createDataFrame([(key, "{}")], "key string, doc string")
    return table.unionByName(fresh.select("key", doc.alias("doc")))


def del_key(table: DataFrame, key: str, path: str = "$") -> DataFrame:
    """JSON.DEL key path: the root goes with its key."""
    mine = F.col("key") == key
    if not steps(path):
        return table.where(~mine)
    return table.withColumn("doc", F.when(mine, del_(F.col("doc"), path)).otherwise(F.col("doc")))
