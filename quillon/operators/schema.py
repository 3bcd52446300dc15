"""Typed documents: a registry of flat schemas, and their checks as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of types (fixed values).
NAMES = {
    "string": "string", "str": "string", "integer": "integer", "int": "integer", "i64": "integer",
    "float": "float", "f64": "float", "number": "float", "boolean": "boolean", "bool": "boolean", "any": "any",
}


@dataclass(frozen=True)
class FieldType:
    """kind: a scalar, ``array`` or ``optional`` (these with an inner type)."""

    kind: str
    inner: FieldType | None = None

    def __str__(self) -> str:
        return f"array<{self.inner}>" if self.kind == "array" else f"{self.inner}?" if self.kind == "optional" else self.kind


def parse_type(text: str) -> FieldType:
    t = text.strip().lower()
    if t.endswith("?"):
        return FieldType("optional", parse_type(t[:-1]))
    if t.startswith("array<") and t.endswith(">"):
        return FieldType("array", parse_type(t[6:-1]))
    if t not in NAMES:
        raise ValueError(f"unknown type: {text}")
    return FieldType(NAMES[t])


def _split(text: str) -> list[str]:
    """At commas outside quotes, braces and angle brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "{<[":
            depth += 1
        elif c in "}>]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x for x in [*out, text[start:]] if x.strip()]


def parse_definition(text: str) -> dict[str, FieldType]:
    """``{"id": "integer", name: string?}`` as field types in order."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise ValueError("a schema is an object")
    out = {}
    for part in _split(body[1:-1]):
        name, colon, kind = part.partition(":")
        if not colon:
            raise ValueError(f"no type: {part}")
        out[name.strip().strip("\"'")] = parse_type(kind.strip().strip("\"'"))
    return out


def _fault(v: Column, kind: FieldType, path: str, s: Column | None = None) -> Column:
    """Null where the variant, of schema s, fits, else a message."""
    s = F.schema_of_variant(v) if s is None else s
    number = (s == "BIGINT") | s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT")
    d = F.try_variant_get(v, "$", "double")
    null = v.isNull() | F.is_variant_null(v)
    if kind.kind == "any":
        return F.lit(None).cast("string")
    if kind.kind == "optional":
        return F.when(null, F.lit(None).cast("string")).otherwise(_fault(v, kind.inner, path, s))
    wrong = F.lit(f"{path}: expected {kind}")
    if kind.kind == "array":
        inner = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _fault(x, kind.inner, f"{path}[]")), lambda e: e.isNotNull())
        return F.when(null | ~s.startswith("ARRAY"), wrong).otherwise(F.try_element_at(inner, F.lit(1)))
    good = {"string": s == "STRING", "boolean": s == "BOOLEAN", "float": number, "integer": number & (d == F.floor(d))}[kind.kind]
    return F.when(null | ~F.coalesce(good, F.lit(False)), wrong)


def validated(docs: DataFrame, column: str, fields: dict[str, FieldType]) -> DataFrame:
    """docs with errors ARRAY<STRING>: what is wrong with a document (text), empty where it
    fits. Missing fields are wrong unless optional, unknown ones always. A document is
    parsed once, and each field taken and looked at once, in projections of their own."""
    v, names = F.col("_variant"), F.col("_names")
    parsed = docs.withColumns({"_variant": F.try_parse_json(column), "_names": F.json_object_keys(column)})
    for k, name in enumerate(fields):
        parsed = parsed.withColumn(f"_field{k}", F.try_variant_get(v, f"$['{name}']", "variant"))
    for k in range(len(fields)):
        parsed = parsed.withColumn(f"_kind{k}", F.schema_of_variant(F.col(f"_field{k}")))
    tests = []
    for k, (name, kind) in enumerate(fields.items()):
        missing = F.lit(None).cast("string") if kind.kind == "optional" else F.lit(f"{name}: missing")
        tests.append(F.when(F.array_contains(names, name), _fault(F.col(f"_field{k}"), kind, name, F.col(f"_kind{k}"))).otherwise(missing))
    unknown = F.transform(F.array_except(names, F.array(*(F.lit(n) for n in fields)) if fields else F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(": unknown")))
    found = F.concat(F.array(*tests) if tests else F.array().cast("array<string>"), F.sort_array(unknown))
    errors = F.when(v.isNull() | names.isNull(), F.array(F.lit("not an object"))).otherwise(F.filter(found, lambda e: e.isNotNull()))
    return parsed.select(*(F.col(f"`{c}`") for c in docs.columns), errors.alias("errors"))


@dataclass
class Registry:
    """SCHEMA DEFINE, LIST, GET, DROP."""

    schemas: dict[str, dict[str, FieldType]] = field(default_factory=dict)

    def define(self, name: str, definition: str) -> None:
        self.schemas[name] = parse_definition(definition)

    def list(self) -> list[str]:
        return sorted(self.schemas)

    def get(self, name: str) -> dict[str, FieldType]:
        if name not in self.schemas:
            raise KeyError(f"no schema: {name}")
        return self.schemas[name]

    def drop(self, name: str) -> bool:
        return self.schemas.pop(name, None) is not None

    def validate(self, docs: DataFrame, name: str, column: str = "doc") -> DataFrame:
        """docs with errors ARRAY<STRING>."""
        return validated(docs, column, self.get(name))

    def tset(self, strings: DataFrame, key: str, doc: str) -> DataFrame:
        """The strings with a typed envelope at the key, whose schema is what stands before its first colon."""
        from quillon.operators.strings import mset

        name = key.split(":", 1)[0]
        spark = strings.sparkSession
        wrong = self.validate(spark.createDataFrame([(doc,)], "doc string"), name).first().errors
        if wrong:
            raise ValueError("; ".join(wrong))
        return mset(strings, [(key, json.dumps({"schema_name": name, "data": json.loads(doc)}, separators=(",", ":"), sort_keys=True))])


def tget(strings: DataFrame, path: str | None = None) -> DataFrame:
    """(key, value): the data of typed envelopes, or a field of it; other strings as they are."""
    v = F.try_parse_json("value")
    typed = F.try_variant_get(v, "$.schema_name", "string").isNotNull()
    data = F.to_json(F.try_variant_get(v, "$.data" + (f"['{path}']" if path else ""), "variant"))
    return strings.select("key", F.when(typed, data).otherwise(F.col("value")).alias("value"))


def tkeys(strings: DataFrame, prefix: str = "") -> DataFrame:
    """Keys of typed envelopes with a prefix."""
    typed = F.try_variant_get(F.try_parse_json("value"), "$.schema_name", "string").isNotNull()
    return strings.where(F.col("key").startswith(prefix) & typed).select("key")
