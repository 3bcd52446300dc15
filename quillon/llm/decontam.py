"""Benchmark decontamination by SimHash and multi-index Hamming search.

Windows of a document that are as long as an item get a 128-bit SimHash of their word
shingles, each weighing as often as it occurs. The items' fingerprints are indexed in
BLOCKS tables, one for each block of BITS bits: a table posts an item under all values
that differ from its block in at most RADIUS // BLOCKS bits. Of BLOCKS blocks that differ in
at most RADIUS bits in all, one differs in at most RADIUS // BLOCKS, so a look-up of the
window's own blocks returns every item within the radius, and none else is compared but
those that share a near block. What is within the radius is verified by the exact
similarity of the two weighted shingle sets (sum of least over sum of largest weights). A
window can only reach a similarity above 0 if it has a shingle of some item, so others
get no fingerprint.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import base
from quillon.llm import words as W

#: Bits of 128 in which fingerprints of window and item differ at most. At a similarity of
#: 0.8 they differ in 19, with a deviation of 4.
RADIUS = 31
BLOCKS, BITS = 8, 16
#: Items that are searched in one pass over the documents, and sent to all tasks.
ITEMS = 4096
#: Windows that get their fingerprints at once.
WINDOWS = 1 << 14
_OTHER = W._splitmix(23, 1)


def _ball() -> np.ndarray:
    """All block values of at most RADIUS // BLOCKS bits."""
    values = np.arange(1 << BITS, dtype=np.uint16)
    return values[np.bitwise_count(values) <= RADIUS // BLOCKS]


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each ``size`` consecutive shingles, as rows of BLOCKS 16-bit blocks."""
    both = np.stack([hashes, W.mix(hashes ^ _OTHER)], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), -1), axis=1)
    sums = np.zeros((len(hashes) + 1, bits.shape[1]), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1).view(np.uint16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


class Index:
    """Fingerprints by group, posted in each of BLOCKS tables under all near values of that block."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        self.prints = prints
        self.values, self.items = [], []
        ball = _ball()
        for b in range(BLOCKS):
            value = ((groups.astype(np.uint32) << BITS)[:, None] | (prints[:, b][:, None] ^ ball[None])).ravel()
            order = np.argsort(value, kind="stable")
            self.values.append(value[order])
            self.items.append((order // len(ball)).astype(np.int32))

    def candidates(self, windows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) numbers of one group that share a near block, each pair once."""
        found = []
        for b in range(BLOCKS):
            key = groups.astype(np.uint32) << BITS | windows[:, b]
            low, high = (np.searchsorted(self.values[b], key, side=side) for side in ("left", "right"))
            n = high - low
            row = np.repeat(np.arange(len(windows)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found.append(row * len(self.prints) + self.items[b][at])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def near(self, windows: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) numbers of one group within the radius."""
        step = max(1, (1 << 21) // len(self.prints))
        for a in range(0, len(windows), step):
            row, item = self.candidates(windows[a : a + step], groups[a : a + step])
            on = distance(windows[a + row], self.prints[item]) <= RADIUS
            yield from zip((a + row[on]).tolist(), item[on].tolist(), strict=True)


class Items:
    """Benchmark items in groups of one shingle width and number of shingles."""

    def __init__(self, rows: list[tuple[int | None, str | None]], width: int):
        self.groups: dict[tuple[int, int], int] = {}
        self.items: list[tuple[int | None, Counter]] = []
        known, prints, group = defaultdict(list), [], []
        for item, text in rows:
            words = W.Chunk(np.zeros(1), [(text or "").encode()], True).hashes
            if not len(words):
                continue
            h = W.shingles(words, width)
            key = (min(width, len(words)), len(h))
            group.append(self.groups.setdefault(key, len(self.groups)))
            self.items.append((item, Counter(h.tolist())))
            prints.append(fingerprints(h, len(h))[0])
            known[key[0]].append(h)
        self.prints, self.group = np.array(prints, dtype=np.uint16).reshape(-1, BLOCKS), np.array(group, dtype=np.uint32)
        self.known = {w: np.unique(np.concatenate(h)) for w, h in known.items()}

    def index(self) -> Index:
        """Built by each task, as it is far larger than what it is built from."""
        return Index(self.prints, self.group)


def leaks(words: np.ndarray, items: Items, index: Index, hits: dict[int, np.ndarray], at_least: float) -> list[tuple[float, int, int, int | None]]:
    """Best (similarity, first word, words, item id) for each item that a text holds; hits:
    places of the items' shingles in it, by shingle width."""
    best: dict[int, tuple] = {}
    shingled = {width: W.shingles(words, width) for width in hits if len(words) >= width}
    held: list[tuple] = []  # fingerprints, group, first starts, width and shingles of some windows

    def search() -> None:
        prints = np.concatenate([x[0] for x in held])
        sizes = [len(x[0]) for x in held]
        first = np.cumsum([0, *sizes])
        for i, k in index.near(prints, np.repeat(np.array([x[1] for x in held], dtype=np.uint32), sizes)):
            at = int(np.searchsorted(first, i, side="right")) - 1
            _, _, start, width, n = held[at]
            start += i - int(first[at])
            item, known = items.items[k]
            s = similarity(Counter(shingled[width][start : start + n].tolist()), known)
            if s >= at_least and (k not in best or (-s, start) < (-best[k][0], best[k][1])):
                best[k] = (s, start, n + width - 1, item)
        held.clear()

    waiting = 0
    for (width, size), group in items.groups.items():
        h, at = shingled.get(width), hits.get(width)
        if h is None or at is None or not len(at):
            continue
        n = min(size, len(h))
        if n < at_least * size:
            continue
        # runs of starts of windows that hold one of the shingles
        low, high = np.maximum(at - n + 1, 0), np.minimum(at, len(h) - n)
        new = np.flatnonzero(np.append(True, low[1:] > np.maximum.accumulate(high)[:-1] + 1))
        for a, e in zip(low[new].tolist(), (np.maximum.accumulate(high)[np.append(new[1:], len(at)) - 1] + 1).tolist(), strict=True):
            for start in range(a, e, WINDOWS):
                stop = min(start + WINDOWS, e)
                held.append((fingerprints(h[start : stop + n - 1], n), group, start, width, n))
                waiting += stop - start
                if waiting >= WINDOWS:
                    search()
                    waiting = 0
    if held:
        search()
    return list(best.values())


def _search(items: Items, at_least: float):
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    flags = {}
    for width, known in items.known.items():
        flags[width] = np.zeros(1 << 20, dtype=bool)
        flags[width][(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.index()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text"), lower=True):
                places = {}
                for width, known in items.known.items():
                    if len(chunk.hashes) < width:
                        continue
                    h = W.shingles(chunk.hashes, width)
                    at = np.flatnonzero(flags[width][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    places[width] = at[np.isin(h[at], known)]
                for i, row in enumerate(chunk.rows):
                    a, e = chunk.bounds[i], chunk.bounds[i + 1]
                    hits = {w: at[np.searchsorted(at, a) : np.searchsorted(at, e - w + 1)] - a for w, at in places.items()}
                    if any(map(len, hits.values())):
                        out += [(ids[row], item, start, n, s) for s, start, n, item in leaks(chunk.hashes[a:e], items, index, hits, at_least)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, at_least: float = 0.8, items: int = ITEMS) -> DataFrame:
    """docs(doc_id long, text string, ...), benchmark(item_id long, text string, ...) ->
    (doc_id, item_id, start, n_words, similarity): a row per document row and item of
    which it holds a window, as long as the item (or all of a shorter text), whose
    similarity over ``width``-word shingles in lower case is ``at_least`` or more; the
    most similar window, of equal ones the first.

    Items of fewer words are one shingle; items without words or text are in nothing.
    Null and empty documents hold nothing; null ids stay null. Repeated rows are repeated in
    the result. Other columns are ignored. An empty benchmark or no documents: no rows.
    A benchmark of more than ``items`` items is searched in as many passes as it takes,
    so what goes to the tasks is bounded.
    """
    spark = docs.sparkSession
    base.tune(spark)
    docs = base.lean(docs, "doc_id", "text").where("text is not null")
    benchmark = base.lean(benchmark, "item_id", "text").where("text is not null")
    passes = -(-benchmark.count() // items)
    kinds = "doc_id long, item_id long, start long, n_words long, similarity double"
    out = spark.createDataFrame([], T.StructType.fromDDL(kinds))
    for k in range(passes):
        rows = [(r.item_id, r.text) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()]
        found = base.mapped(docs, _search(Items(rows, width), at_least), kinds)
        out = found if passes == 1 else out.union(found)
    return out
