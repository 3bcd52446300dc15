"""SQL over the virtual table ``keys``.

Strict mode (the default) is Spark SQL with the dialect's LIKE, which ignores case and
has no escape: ORDER BY, LIMIT, grouping, joins and functions work, every predicate means what
it says, results are typed. Compat mode keeps the historical reading of a statement:
what follows WHERE's condition is dropped, predicates that it doesn't know hold for every
row, NOT LIKE is LIKE, ordering compares integers only, and all cells are text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.parsing import strict_int


class QueryError(Exception):
    """Any failure of a statement."""


class ParseFailure(QueryError):
    """It is no SQL."""


class UnsupportedQuery(QueryError):
    """Neither SELECT nor DELETE, or more than one statement."""


class InvalidTable(QueryError):
    """A table other than keys."""


class InvalidColumn(QueryError):
    """A column that keys doesn't have."""


COLUMNS = ("key", "type", "memory", "ttl", "length", "value")
TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][\w.]*|\"[^\"]+\"|`[^`]+`)|(?P<sign><>|!=|<=|>=|\|\||[^\s]))")


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    sql = sql.strip().rstrip(";").rstrip()
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m or m.end() == at:
            raise ParseFailure(sql[at:])
        out.append((m.lastgroup or "", m[m.lastgroup]))
        at = m.end()
    return out


def escape_for(pattern: str) -> str:
    """A character that the pattern doesn't hold."""
    return next(c for c in "~^|!#\x01\x02\x03\x04\x05" if c not in pattern)


def like(column: Column, pattern: str) -> Column:
    """LIKE without case (of ASCII letters) and without escape. A pattern whose text
    before the first wildcard has no letters keeps that prefix as a plain filter, which reaches
    the Parquet scan."""
    regex = "(?s)^" + "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in _fold(pattern)) + "$"
    folded = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prefix = re.match(r"[^%_A-Za-z]*", pattern)[0]
    test = folded.rlike(regex)
    return column.startswith(prefix) & test if prefix else test


def _fold(text: str) -> str:
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)


def rewritten(sql: str) -> str:
    """The statement with LIKE as ILIKE with an escape that its pattern doesn't hold."""
    out, toks = [], tokens(sql)
    for i, (kind, t) in enumerate(toks):
        if kind == "word" and t.upper() == "LIKE":
            out.append("ILIKE")
        elif kind == "text" and i and toks[i - 1][1].upper() == "LIKE":
            explicit = i + 1 < len(toks) and toks[i + 1][1].upper() == "ESCAPE"
            out.append(t.replace("\\", "\\\\") if explicit else f"{t.replace(chr(92), chr(92) * 2)} ESCAPE '{escape_for(t)}'")
        elif kind == "text":
            out.append(t.replace("\\", "\\\\"))
        else:
            out.append(t)
    return " ".join(out)


@dataclass
class Deleted:
    """What a DELETE leaves, and the keys that went."""

    remaining: DataFrame
    gone: DataFrame

    @property
    def count(self) -> int:
        return self.gone.count()


def _spark_sql(keys: DataFrame, sql: str) -> DataFrame:
    try:
        return keys.sparkSession.sql(sql, keys=keys)
    except ParseException as e:
        raise ParseFailure(str(e)) from e
    except AnalysisException as e:
        condition = e.getCondition() or ""
        kind = InvalidTable if "TABLE" in condition else InvalidColumn if "COLUMN" in condition else QueryError
        raise kind(str(e)) from e


def query(keys: DataFrame, sql: str, compat: bool = False) -> DataFrame | Deleted:
    """Runs one SELECT (a DataFrame) or DELETE (Deleted) over the keys table."""
    toks = tokens(sql)
    if not toks:
        raise ParseFailure("empty")
    if any(t == ";" for _, t in toks):
        raise UnsupportedQuery("more than one statement")
    verb = toks[0][1].upper()
    if verb not in ("SELECT", "DELETE", "WITH"):
        raise UnsupportedQuery(verb)
    if compat:
        return _compat(keys, toks)
    if verb == "DELETE":
        words = [t.upper() for _, t in toks]
        if len(toks) < 3 or words[1] != "FROM":
            raise ParseFailure(sql)
        if words[2] != "KEYS":
            raise InvalidTable(toks[2][1])
        if len(toks) > 3 and words[3] != "WHERE":
            raise ParseFailure(sql)
        where = rewritten(sql).split(" ", 3)[3] if len(toks) > 3 else ""
        gone = _spark_sql(keys, f"SELECT key FROM {{keys}} AS keys {where}")
        return Deleted(keys.join(gone, "key", "left_anti"), gone)
    text = re.sub(r"(?i)\b(FROM|JOIN)\s+keys\b(?!\s*\.)", r"\1 {keys}", rewritten(sql))
    text = re.sub(r"(?i)(\{keys\})(?!\s+(?:AS\s+)?(?!WHERE\b|GROUP\b|ORDER\b|LIMIT\b|HAVING\b|JOIN\b|ON\b|LEFT\b|RIGHT\b|INNER\b|FULL\b|CROSS\b|UNION\b|INTERSECT\b|EXCEPT\b|OFFSET\b|WINDOW\b|SEMI\b|ANTI\b|USING\b)[A-Za-z_])", r"\1 AS keys", text)
    if "{keys}" not in text:
        raise InvalidTable("the table is keys")
    return _spark_sql(keys, text)


def explain(keys: DataFrame, sql: str) -> str:
    """The plans of a SELECT, from parsed to physical."""
    df = query(keys, sql)
    df = df.gone if isinstance(df, Deleted) else df
    return df._jdf.queryExecution().explainString(keys.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


class _Where:
    """Compat predicates, by recursive descent."""

    def __init__(self, toks: list[tuple[str, str]]):
        self.toks, self.at = toks, 0

    def peek(self) -> str:
        return self.toks[self.at][1].upper() if self.at < len(self.toks) else ""

    def next(self) -> tuple[str, str]:
        if self.at == len(self.toks):
            raise ParseFailure("unfinished condition")
        self.at += 1
        return self.toks[self.at - 1]

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "OR":
            self.next()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "AND":
            self.next()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() == "(":
            self.next()
            out = self.either()
            if self.next()[1] != ")":
                raise ParseFailure("no )")
            return out
        if self.peek() == "NOT":
            self.next()
            self.one()
            return F.lit(True)
        left = self.value()
        op = self.peek()
        if op in ("=", "<>", "!=", "<", "<=", ">", ">="):
            self.next()
            right = self.value()
            if op == "=":
                return left == right
            if op in ("<>", "!="):
                return left != right
            a, b = strict_int(left), strict_int(right)
            test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            return F.coalesce(test, F.lit(False))
        negated = op == "NOT"
        if negated:
            self.next()
        if self.peek() == "LIKE":
            self.next()
            kind, t = self.next()
            return like(left, t[1:-1].replace("''", "'")) if kind == "text" else F.lit(True)
        depth = 0
        between = self.peek() == "BETWEEN"
        while self.at < len(self.toks):  # a predicate that it doesn't know holds
            t = self.peek()
            if not depth and (t in ("OR", ")") or t == "AND" and not between):
                break
            between = between and t != "AND"
            depth += (t == "(") - (t == ")")
            self.next()
        return F.lit(True)

    def value(self) -> Column:
        kind, t = self.next()
        if kind == "text":
            return F.lit(t[1:-1].replace("''", "'"))
        if kind == "number":
            return F.lit(t)
        if kind == "sign":
            if t == "-":
                self.next()
            return F.lit("")
        name = t.strip('"`')
        if "." in name:
            return F.lit("")
        name = name.lower()
        return F.col(name).cast("string") if name in COLUMNS and name != "value" else F.lit("NULL")


def _compat(keys: DataFrame, toks: list[tuple[str, str]]) -> DataFrame | Deleted:
    words = [t.upper() for _, t in toks]
    if words[0] not in ("SELECT", "DELETE") or "FROM" not in words:
        raise UnsupportedQuery(words[0])
    start = words.index("FROM")
    if start + 1 == len(toks):
        raise ParseFailure("no table")
    if words[start + 1] != "KEYS":
        raise InvalidTable(toks[start + 1][1])
    rest = toks[start + 2 :]
    tests = F.lit(True)
    if rest and rest[0][1].upper() == "WHERE":
        tail = next((i for i, (k, t) in enumerate(rest) if k == "word" and t.upper() in ("ORDER", "GROUP", "LIMIT", "OFFSET", "HAVING")), len(rest))
        tests = _Where(rest[1:tail]).either()
    found = keys.where(tests)
    if words[0] == "DELETE":
        return Deleted(keys.join(found.select("key"), "key", "left_anti"), found.select("key"))
    items: list[list[tuple[str, str]]] = [[]]
    depth = 0
    for k, t in toks[1:start]:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            items.append([])
        else:
            items[-1].append((k, t))
    if any(len(i) > 1 and i[0][1].upper() == "COUNT" and i[1][1] == "(" and i[-1][1] == ")" for i in items):
        return found.agg(F.count("*").alias("count"))
    out = []
    for item in items:
        names = [t.strip('"`') for _, t in item]
        if names == ["*"]:
            out += [F.col(c).cast("string") for c in COLUMNS[:-1]]
            continue
        column = names[0].split(".")[-1].lower()
        if column not in COLUMNS:
            raise InvalidColumn(names[0])
        alias = names[-1] if len(names) > 1 else names[0].split(".")[-1]
        shown = alias.lower() if len(names) > 1 else column
        cell = F.coalesce(F.col(shown).cast("string"), F.lit("NULL")) if shown in COLUMNS else F.lit("NULL")
        out.append(cell.alias(alias))
    return found.select(*out)
