"""Substring dedup by recompression.

A text's words are renamed in rounds: first runs of one word, then, round after round,
pairs. A round halves the symbols by a bit of their names and merges each left one that
is followed by a right one; the pair's name is a hash of the two. Whether two neighbours
merge depends on their names alone, and a name on nothing but the words below it, so
Spark's tasks give equal substrings equal symbols without agreeing on anything but the
rule. In the first ROUNDS rounds symbols of CAP words or more merge no further; in the
later ones all do, and those of a window's length or more are the high symbols.

A round can merge only the first and the last whole symbol of a substring with what
stands around it. Names of fewer than CAP words are at most 1, 2, 4, 7, 7 words long in
the first rounds, so a substring loses at most 21 words at either end, and at most 5 and
2 more where a run crosses an end: of 50 words, one at least lies in a whole low symbol
that every occurrence has. So a window can only repeat if all low symbols that it has
wherever it stands (its inner ones) are shared; low symbols of fewer than LEAST words
are too common to tell anything and are not asked for.

Documents are dealt into buckets of some megabytes by a hash of the row. A bucket posts each
of its symbols once, with its least and largest doc_id, so the commonest symbol costs a row
a bucket. High symbols that a smaller document has (the name and a second hash of all
words, 128 bits, agree) reveal long repeats whole; the windows outside of them whose
inner symbols are all shared are posted with 128 bits of their words, again once a bucket,
and verify the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import base
from quillon.llm import words as W

ROUNDS, CAP, RUN = 5, 8, 3
#: All rounds (a quarter of the symbols goes in each), and words of a posted low symbol.
HEIGHT, LEAST = 20, 4
#: Shortest window whose every repeat the first rounds reveal.
LEAST_WINDOW = 50
#: Bytes of text of a bucket.
BUCKET = 4 << 20
_U = np.uint64
_FLAGS = 1 << 20
_COIN = W._splitmix(19, 64)


@dataclass
class Symbols:
    """Low symbols (name, first word, words) in order, with lead and tail by word: in whatever
    context the words i to j stand, the symbols from number lead[i] to tail[j] - 1 are
    the same (none where lead[i] >= tail[j]). High symbols: name, first word, end."""

    names: np.ndarray
    at: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    tail: np.ndarray
    high: tuple[np.ndarray, np.ndarray, np.ndarray]


def recompress(names: np.ndarray, text_of: np.ndarray, height: int = HEIGHT, window: int = LEAST_WINDOW) -> Symbols:
    """The symbols of words with these names, of texts numbered by text_of."""
    n = len(names)
    none = np.empty(0, dtype=np.int64)
    if n == 0:
        return Symbols(names, none, none, none, none, (names, none, none))
    # runs: RUN equal words from the run's start, and its rest, are symbols that stay
    new = np.append(True, (names[1:] != names[:-1]) | (text_of[1:] != text_of[:-1]))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    run_of = np.cumsum(new) - 1
    place = np.arange(n) - first[run_of]
    at = np.flatnonzero(place % RUN == 0)
    size = np.diff(np.append(at, n))
    fixed = (length > 1)[run_of[at]]
    # a run that crosses an end can be longer elsewhere
    lead = np.searchsorted(at, np.append(first[1:], n))[run_of]
    tail = np.searchsorted(at, first)[run_of]
    names, text_of = names[at], text_of[at]
    names = np.where(fixed, W.mix(names + size.astype(_U) * W._STEP[40]), names)
    low = None
    high: list[tuple] = []
    for r in range(max(height, ROUNDS)):
        if r == ROUNDS:
            low = names, at, size
            fixed = np.zeros(len(names), dtype=bool)
            whole = size >= window
            high.append((names[whole], at[whole], at[whole] + size[whole]))
        right = (W.mix(names + _COIN[r]) >> _U(63)).astype(bool)
        free = ~fixed
        pair = np.flatnonzero(~right[:-1] & right[1:] & free[:-1] & free[1:] & (text_of[:-1] == text_of[1:]))
        keep = np.ones(len(names), dtype=bool)
        keep[pair + 1] = False
        if low is None:
            before = np.append(0, np.cumsum(keep))
            lead = before[lead + np.append(right & free, False)[lead]]
            tail = before[tail - np.append(False, ~right & free)[tail]]
        names, size = names.copy(), size.copy()
        names[pair] = W.mix(names[pair] * W._STEP[60] + names[pair + 1] * W._STEP[61] + _U(r))
        size[pair] += size[pair + 1]
        if low is not None:
            whole = pair[size[pair] >= window]
            high.append((names[whole], at[whole], at[whole] + size[whole]))
        names, size, text_of, at, fixed = names[keep], size[keep], text_of[keep], at[keep], fixed[keep]
        fixed = fixed | (size >= CAP) if low is None else fixed
    if low is None:
        low = names, at, size
    tops = tuple(np.concatenate(x) for x in zip(*high, strict=True)) if high else (names[:0], none, none)
    return Symbols(*low, lead, tail, tops)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words."""
    return W.mix(hashes ^ W._STEP[45])


def _high(hashes: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each high symbol; the second half is odd."""
    names, at, end = symbols.high
    return names, W.rolling(_second(hashes), at, end) | _U(1)


def _window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows that start there; the second half is even and not 0."""
    check = W.rolling(_second(hashes), starts, starts + window) & ~_U(1)
    return W.mix(W.rolling(hashes, starts, starts + window)), np.where(check == 0, _U(2), check)


def _texts(chunk: W.Chunk) -> np.ndarray:
    return np.repeat(np.arange(len(chunk.rows)), np.diff(chunk.bounds))


def _chunks(table: pa.Table) -> Iterator[tuple[W.Chunk, np.ndarray]]:
    """The texts of a bucket, in chunks, with the doc_id of each; rows without doc_id or text are left out."""
    for batch in table.to_batches(max_chunksize=1024):
        batch = batch.filter(batch.column("doc_id").is_valid())
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for chunk in W.chunks(range(len(batch)), W.column(batch, "text")):
            yield chunk, ids[chunk.rows]


def _least(keys: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct 128-bit keys with the least and the largest id of each."""
    a, b = (np.concatenate(k) if k else np.empty(0, _U) for k in keys)
    i = np.concatenate(ids) if ids else np.empty(0, np.int64)
    order = np.lexsort((b, a))
    a, b, i = a[order], b[order], i[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    if not len(first):
        return [a, b, i, i]
    return [a[first], b[first], np.minimum.reduceat(i, first), np.maximum.reduceat(i, first)]


POSTS = "symbol long, mark long, bucket long, low long, high long"


class _Posts:
    """The distinct keys of a bucket; those at hand are merged whenever they have doubled."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = [[], [], [], []]
        self.size, self.limit = 0, 1 << 20

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> None:
        for k, x in enumerate(_least([[a], [b]], [ids])):
            self.held[k].append(x)
        self.size += len(self.held[0][-1])
        if self.size > self.limit:
            self._merge()
            self.limit = max(1 << 20, 2 * self.size)

    def _merge(self) -> None:
        a, b, low, high = (np.concatenate(x) if x else np.empty(0, np.int64) for x in self.held)
        order = np.lexsort((b, a))
        a, b, low, high = a[order], b[order], low[order], high[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
        if len(first):
            a, b, low, high = a[first], b[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        self.held, self.size = [[a], [b], [low], [high]], len(a)

    def table(self, bucket: int) -> pa.Table:
        self._merge()
        a, b, low, high = (x[0].view(np.int64) for x in self.held)
        return pa.table([pa.array(x, pa.int64()) for x in (a, b, np.full(len(a), bucket, np.int64), low, high)], names=["symbol", "mark", "bucket", "low", "high"])


def _bucket(table: pa.Table) -> int:
    return table.column("bucket")[0].as_py()


def _post(window: int):
    """A bucket's (doc_id, text) -> POSTS: its high symbols, and its low ones of LEAST words or
    more (mark 0), of texts of ``window`` words or more."""

    def run(table: pa.Table) -> pa.Table:
        posts = _Posts()
        for chunk, ids in _chunks(table):
            text_of = _texts(chunk)
            symbols = recompress(chunk.hashes, text_of, window=window)
            known = (np.diff(chunk.bounds)[text_of[symbols.at]] >= window) & (symbols.size >= LEAST)
            owner = ids[text_of[symbols.at[known]]]
            names, marks = _high(chunk.hashes, symbols)
            posts.add(np.append(symbols.names[known], names), np.append(np.zeros(len(owner), _U), marks), np.append(owner, ids[text_of[symbols.high[1]]]))
        return posts.table(_bucket(table))

    return base.released(run)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTS, sorted by symbol, mark and low -> (bucket, symbol, mark, least): with mark 0 all
    rows whose symbol several documents have, else those of buckets that hold a larger
    doc_id than the least."""
    wait: list[np.ndarray] | None = None  # undecided rows of the open group: all of one doc_id
    last = None  # the open group's symbol, mark, least, and whether it is shared
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(5)]
        if not len(rows[0]):
            continue
        if wait is not None:
            rows = [np.append(w, x) for w, x in zip(wait, rows, strict=True)]
        symbol, mark, bucket, low, high = rows
        start = np.append(True, (symbol[1:] != symbol[:-1]) | (mark[1:] != mark[:-1]))
        first = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        least, most = low[first], np.maximum.reduceat(high, first)
        several = most > least
        if last is not None and (symbol[0], mark[0]) == last[:2]:
            least[0] = last[2]
            several[0] = last[3] or most[0] > least[0]
        take = several[group] & ((mark == 0) | (high > least[group]))
        last = (symbol[-1], mark[-1], least[-1], bool(several[-1]))
        wait = None if several[-1] else [x[first[-1] :] for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[take], symbol[take], mark[take], least[group][take])], names=["bucket", "symbol", "mark", "least"])


class _Known:
    """Rows of _shared() for one bucket: its shared low symbols, its cut high symbols and windows."""

    def __init__(self, table: pa.Table):
        symbol, mark, least = (table.column(c).to_numpy().astype(np.int64) for c in ("symbol", "mark", "least"))
        symbol, mark = symbol.view(_U), mark.view(_U)
        self.low = np.sort(symbol[mark == 0])
        self.high = self._sorted(symbol, mark, least, mark & _U(1) == 1)
        self.windows = self._sorted(symbol, mark, least, (mark != 0) & (mark & _U(1) == 0))
        self.flags = {}
        for name, keys in (("low", self.low), ("high", self.high[0]), ("windows", self.windows[0])):
            self.flags[name] = np.zeros(_FLAGS, dtype=bool)
            self.flags[name][(keys & _U(_FLAGS - 1)).astype(np.int64)] = True

    @staticmethod
    def _sorted(symbol, mark, least, take):
        symbol, mark, least = symbol[take], mark[take], least[take]
        order = np.lexsort((mark, symbol))
        return symbol[order], mark[order], least[order]

    def has_low(self, names: np.ndarray) -> np.ndarray:
        out = self.flags["low"][(names & _U(_FLAGS - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = np.isin(names[at], self.low)
        return out

    def cuts(self, kind: str, names: np.ndarray, marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the keys that a document with a smaller doc_id than ids has."""
        keys, checks, least = getattr(self, kind)
        at = np.flatnonzero(self.flags[kind][(names & _U(_FLAGS - 1)).astype(np.int64)])
        place = np.searchsorted(keys, names[at])
        out = []
        while len(at):  # keys that agree in the first half lie next to each other
            on = place < len(keys)
            at, place = at[on], place[on]
            on = keys[place] == names[at]
            at, place = at[on], place[on]
            hit = (checks[place] == marks[at]) & (least[place] < ids[at])
            out.append(at[hit])
            at, place = at[~hit], place[~hit] + 1
        return np.sort(np.concatenate(out)) if out else at


def _covered(known: _Known, hashes: np.ndarray, symbols: Symbols, ids: np.ndarray) -> np.ndarray:
    """For each word, where the last cut high symbol that has started by then ends."""
    out = np.zeros(len(hashes), dtype=np.int64)
    names, marks = _high(hashes, symbols)
    at = known.cuts("high", names, marks, ids[symbols.high[1]])
    if len(at):
        np.maximum.at(out, symbols.high[1][at], symbols.high[2][at])
        out = np.maximum.accumulate(out)
    return out


def _windows(window: int):
    """A bucket's texts and its rows of _shared() -> POSTS of the windows whose inner symbols
    are all shared, but for those within high symbols that a smaller doc_id has."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        posts = _Posts()
        if not len(table):
            return posts.table(0)
        known = _Known(shared)
        for chunk, ids in _chunks(table):
            if not len(chunk.hashes):
                continue
            text_of = _texts(chunk)
            n = len(text_of)
            owner = ids[text_of]
            symbols = recompress(chunk.hashes, text_of, window=window)
            alone = np.append(0, np.cumsum((symbols.size >= LEAST) & ~known.has_low(symbols.names)))
            end = chunk.bounds[1:][text_of]
            start = np.flatnonzero(np.arange(n) + window <= end)
            here, there = symbols.lead[start], symbols.tail[start + window - 1]
            start = start[(here >= there) | (alone[here] == alone[np.maximum(there, here)])]
            start = start[_covered(known, chunk.hashes, symbols, owner)[start] < start + window]
            posts.add(*_window_hashes(chunk.hashes, start, window), owner[start])
        return posts.table(_bucket(table))

    return base.released(run)


def _spans(at: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of [at, end), sorted by at."""
    if not len(at):
        return []
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, at[1:] > reach[:-1]))
    return list(zip(at[first].tolist(), reach[np.append(first[1:], len(at)) - 1].tolist(), strict=True))


def _cut(window: int, layout: bool, kinds: pa.Schema):
    """A bucket's texts and its cut symbols and windows -> what is kept, and the spans of words that go."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        known = _Known(shared) if len(shared) else None
        out = []
        for batch in table.to_batches(max_chunksize=1024):
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = W.column(batch, "text")
            rows: list[list] = [[None] * len(batch) for _ in range(4)]
            for chunk in W.chunks(range(len(batch)), texts):
                text_of, n = _texts(chunk), len(chunk.hashes)
                owner = ids[chunk.rows][text_of]
                at = end = np.empty(0, dtype=np.int64)
                if known is not None and n:
                    start = np.flatnonzero(np.arange(n) + window <= chunk.bounds[1:][text_of])
                    at = start[known.cuts("windows", *_window_hashes(chunk.hashes, start, window), owner[start])]
                    end = at + window
                    if len(known.high[0]):
                        symbols = recompress(chunk.hashes, text_of, window=window)
                        cut = known.cuts("high", *_high(chunk.hashes, symbols), owner[symbols.high[1]])
                        at, end = np.append(at, symbols.high[1][cut]), np.append(end, symbols.high[2][cut])
                        order = np.argsort(at, kind="stable")
                        at, end = at[order], end[order]
                bound = np.searchsorted(at, chunk.bounds)
                for i, row in enumerate(chunk.rows.tolist()):
                    a, e = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
                    spans = _spans(at[bound[i] : bound[i + 1]] - a, end[bound[i] : bound[i + 1]] - a)
                    if spans or not layout:
                        left, pieces = a, []
                        for s, f in [*spans, (e - a, e - a)]:
                            pieces += [chunk.data[x:y] for x, y in zip(chunk.starts[left : a + s].tolist(), chunk.ends[left : a + s].tolist(), strict=True)]
                            left = a + f
                        kept = b" ".join(pieces)
                    else:
                        kept = texts[row] or b""
                    rows[0][row] = kept.decode()
                    rows[1][row] = e - a
                    rows[2][row] = sum(f - s for s, f in spans)
                    rows[3][row] = [{"start": s, "end": f} for s, f in spans]
            fixed = [pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(rows)]
            more = [batch.column("carried")] if "carried" in batch.schema.names else []
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), *fixed, *more], names=kinds.names[: 5 + len(more)]))
        if not out:
            more = [pa.array([], table.schema.field("carried").type)] if "carried" in table.schema.names else []
            out.append(pa.RecordBatch.from_arrays([pa.array([], kinds.field(k).type) for k in range(5)] + more, names=kinds.names[: 5 + len(more)]))
        return pa.Table.from_batches(out)

    return base.released(run)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
CUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN)), ("carried", pa.null())])


def cut_repeats(docs: DataFrame, window: int = LEAST_WINDOW, carry: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, kept string, n_words, n_removed,
    spans array<struct<start, end>>), a row per input row. A word goes if a window of
    ``window`` consecutive words (50 or more) covers it whose words also stand, in this
    order, in a document with a smaller doc_id; all windows are judged on the input.
    kept: the other words, joined by one space (with ``layout``, a text of which nothing
    goes as it is); spans: the places of what went.

    Null and empty texts have no words. A row with a null doc_id keeps all its words and
    takes none from others. Rows with one doc_id, of equal or of different texts, are
    judged each for itself and don't cut each other. Of other columns, those named in
    ``carry`` come along in a struct, carried. No rows give no rows.
    """
    if window < LEAST_WINDOW:
        raise ValueError(f"windows of fewer than {LEAST_WINDOW} words can slip through the symbols")
    spark = docs.sparkSession
    base.tune(spark)
    n = base.parts(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8 * n, -(-size // BUCKET))  # several a task, so that tasks are alike
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    # equal rows part by the place they come from, too
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).alias("bucket")
    texts = docs.select(bucket, "doc_id", "text", *rest).repartition(n, "bucket")  # one exchange, read three times
    grouped = texts.groupBy("bucket")

    posts = grouped.applyInArrow(_post(window), POSTS).repartition(n, "symbol").sortWithinPartitions("symbol", "mark", "low")
    kinds = "bucket long, symbol long, mark long, least long"
    shared = base.mapped(posts, _shared, kinds)
    found = grouped.cogroup(shared.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_windows(window), POSTS)
    found = found.repartition(n, "symbol").sortWithinPartitions("symbol", "mark", "low")
    gone = base.mapped(found, _shared, kinds).union(shared.where("mark <> 0")).repartition(n, "bucket")
    out = T.StructType.fromDDL("doc_id long, kept string, n_words long, n_removed long, spans array<struct<start: bigint, end: bigint>>")
    out = T.StructType([*out.fields, *(f for f in texts.schema.fields if f.name == "carried")])
    return grouped.cogroup(gone.groupBy("bucket")).applyInArrow(_cut(window, layout, CUT), out)


#: The registered query over DuckDB's ``documents``.
SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {LEAST_WINDOW - 1}], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {LEAST_WINDOW - 2})) AS i FROM texts WHERE doc_id IS NOT NULL)),
least AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, unnest(range({LEAST_WINDOW})) AS k FROM windows JOIN least USING (h) WHERE least < doc_id)),
places AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
