"""License scans: canonical digest lookup, with DataFrame functions only.

A text's canonical form is that in lower case, without copyright lines, with one
spelling for equivalent words, other punctuation and white space reduced to single
spaces. Its digest is joined to the digests of known licence texts and notices. The
texts of a document are the whole document, and each of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import base, licence_texts

#: Known rows are broadcast up to this many.
FEW = 1 << 16
#: A wrapped line can begin with the word, so a year, a sign, a place for one or a holder has to follow.
COPYRIGHT = r"(?m)^[ \t]*(?:all rights reserved|(?:portions )?copyright[ \t:]*(?:\(c\)|©|[0-9<\[{]|by )|(?:\(c\)|©)[ \t]*(?:copyright|[0-9<\[{]))[^\n]*$"
#: What a text with a copyright line holds.
COPYRIGHTS = ["copyright", "(c)", "©", "all rights reserved"]
#: Equivalent spellings: what a text with one holds, its pattern, and what stays.
SAME = [
    ("licence", r"\b(sub)?licence(s|d)?\b", "$1license$2"),
    ("organis", r"\borganis", "organiz"),
    ("acknowledgement", r"\backnowledgement", "acknowledgment"),
    ("favour", r"\bfavour", "favor"),
    ("copyright owner", r"\bcopyright owner", "copyright holder"),
    ("commercial", r"\bnon[- \n]*commercial", "noncommercial"),
    ("https://", r"\bhttps://", "http://"),
    ("&", r"&", " and "),
]
_SIGNS = r"!-/:-@\[-`{-~“”‘’«»–—•©®™\t\r\f\x0B\x{A0}"
#: Punctuation with the spaces around it, and runs of spaces.
PUNCTUATION = rf" *[{_SIGNS}][{_SIGNS} ]*|  +"
LINES = " ?\n[ \n]*"


def _where(text, held: list[str], pattern: str, one: str):
    """text with a pattern replaced where it holds one of the strings; text is evaluated once."""

    def changed(t):
        test = t.contains(held[0])
        for h in held[1:]:
            test = test | t.contains(h)
        return F.when(test, F.regexp_replace(t, pattern, one)).otherwise(t)

    return F.element_at(F.transform(F.array(text), changed), 1)


def canonical(text):
    """A column's canonical text, lines kept apart by one \\n each. A pattern runs only
    over texts that hold what it takes."""
    out = _where(F.lower(text), COPYRIGHTS, COPYRIGHT, "")
    for has, pattern, one in SAME:
        out = _where(out, [has], pattern, one)
    return F.regexp_replace(F.regexp_replace(out, PUNCTUATION, " "), LINES, "\n")


def digest(canon):
    """SHA-256 of a canonical text, null if it is empty."""
    return F.when(F.length(canon) > 0, F.sha2(canon, 256))


def whole(canon):
    return F.trim(F.replace(canon, F.lit("\n"), F.lit(" ")))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text, digest): texts to be digested, and digests of the longest."""
    rows = [(spdx, text, None) for spdx, text in licence_texts.notices()] + [(spdx, None, x) for spdx, x in licence_texts.DIGESTS]
    return spark.createDataFrame(rows, "licence string, text string, digest string")


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id long, text string, ...), known(licence, text, digest) -> (doc_id, digest,
    licence, notices, n_notices), a row per input row. digest: of the whole canonical
    text, null for null, empty or bare texts; licence: the known text that it is, else
    null (of several names for one text the least); notices: the sorted names of known
    texts that are one of its lines, joined by commas, else null; n_notices: how many of its
    lines are known texts, 0 if none. Of known, digest is that of a canonical text, and
    text is digested where it is null.

    Rows that share a doc_id, or have none, are judged each for itself. Other columns are
    ignored. No rows give no rows; no known texts give no names. Every text is read and
    made canonical once; only the rows, and the lines that are known, are shuffled.
    """
    docs, known = base.lean(docs, "doc_id", "text"), base.lean(known, "licence", "text", "digest")
    known = known.select("licence", "digest", canonical(F.col("text")).alias("canon")).select("licence", "digest", whole(F.col("canon")).alias("w"))
    known = known.select("licence", F.coalesce("digest", digest(F.col("w"))).alias("digest")).where("digest is not null and licence is not null")
    known = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    if known.count() <= FEW:
        known = F.broadcast(known)

    def entry(is_whole: bool, x):
        return F.struct(F.lit(is_whole).alias("whole"), x.alias("digest"))

    def digests(canon):
        lines = F.filter(F.transform(F.split(canon, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        return F.concat(F.array(entry(True, digest(whole(canon)))), F.transform(lines, lambda x: entry(False, F.sha2(x, 256))))

    each = F.element_at(F.transform(F.array(F.coalesce(canonical(F.col("text")), F.lit(""))), digests), 1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", each.alias("each"))  # a row's number, before it is taken apart
    rows = rows.select("row", "doc_id", F.inline("each")).join(known, "digest", "left").where("whole or licence is not null")
    line = F.when(~F.col("whole"), F.col("licence"))
    out = rows.groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.struct("doc_id", "digest", "licence"))).alias("of"),
        F.array_join(F.sort_array(F.collect_set(line)), ",").alias("notices"),
        F.count(line).alias("n_notices"),
    )
    return out.select("of.doc_id", "of.digest", "of.licence", F.when(F.col("n_notices") > 0, F.col("notices")).alias("notices"), "n_notices")


def sql() -> str:
    """The same over DuckDB's ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(column: str) -> str:
        out = f"regexp_replace(lower({column}), {quoted(COPYRIGHT)}, '', 'g')"
        for _, pattern, one in SAME:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(one.replace('$', chr(92)))}, 'g')"
        return f"regexp_replace(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'), ' ?' || chr(10) || '[ ' || chr(10) || ']*', chr(10), 'g')"

    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licence_texts.notices())
    more = "".join(f" UNION ALL SELECT {quoted(name)}, {quoted(x)}" for name, x in licence_texts.DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(n) AS licence FROM (SELECT n, sha256(trim(replace({canon("t")}, chr(10), ' '))) AS digest FROM (VALUES {known}) v(n, t){more}) GROUP BY 1),
canon AS (SELECT row_number() OVER () AS r, doc_id, {canon("text")} AS canon FROM documents),
lines AS (SELECT r, trim(unnest(string_split(canon, chr(10)))) AS line FROM canon),
notices AS (SELECT r, array_to_string(list_sort(list_distinct(list(licence))), ',') AS notices, count(*) AS n_notices
  FROM lines JOIN known ON sha256(line) = digest WHERE length(line) > 0 GROUP BY r),
texts AS (SELECT r, doc_id, CASE WHEN length(w) > 0 THEN sha256(w) END AS digest FROM (SELECT r, doc_id, trim(replace(canon, chr(10), ' ')) AS w FROM canon))
SELECT doc_id, digest, licence, notices, coalesce(n_notices, 0) AS n_notices
FROM texts LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
"""
