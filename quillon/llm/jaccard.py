"""N-gram Jaccard join: T-occurrence search with DivideSkip.

1.  Every text becomes its set of shingle hashes. Documents with equal sets are one
    class; from here on its smallest id stands for it.
2.  A set that links with another has most of its elements in common with others. How
    many of its elements occur in another set is counted exactly enough (by 40 or 48 bits
    of their hashes, which can only make it more): sets with too few go no further. What
    stays is counted once more, among itself.
    Routing of the rest, so that any two sets that can link meet: a size band has m parts
    of the hash range, where m is more than the elements in which two linked sets of that
    band can differ, so that linked sets agree on a whole part. A set is routed by the
    hashes of its parts; those that share one are tied to the least of them, and what
    these ties connect is a block. No pairs are made.
3.  In a block, each set is searched in an inverted index: the lists of its elements are
    divided into long and short ones, the short ones heap-merged with skips, what occurs
    often enough there is probed for in the long ones by bisection, and sets with the
    required overlap link. What is in one component already is not compared again.
    Blocks beyond a bound of elements are cut into pieces and searched piece against
    piece, in as many tasks.
4.  Links become components.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import base, graph
from quillon.llm import words as W

#: Elements of a block, and of a piece of a larger block, that one task holds.
PIECE = 1 << 21
#: Ids that are broadcast at most (8 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 1 << 20


def overlap(a: int, b: int, at_least: Fraction) -> int:
    """Least intersection of sets of a and b elements with Jaccard >= at_least."""
    p, q = at_least.numerator, at_least.denominator
    return -(-p * (a + b) // (p + q))


def smallest(n: int, at_least: Fraction) -> int:
    """Size of the smallest set that can link with one of n elements."""
    return -(-at_least.numerator * n // at_least.denominator)


def bands(at_least: Fraction, top: int) -> list[tuple[int, int]]:
    """(largest size, parts) of the size bands up to one that holds ``top``.

    Sets that can link lie in one band or in neighbours, as each band's sizes span more
    than the ratio at which they can.
    """
    p, q = at_least.numerator, at_least.denominator
    out, low = [], 1
    while True:
        high = low * q**3 // p**3
        # linked sets of s = |A| + |B| elements in all differ in at most s (q - p) / (q + p)
        differ = 2 * high * (q - p) // (q + p)
        out.append((high, differ + 1 + spare(differ)))
        if high >= top:
            return out
        low = high + 1


def covering(n: int, at_least: Fraction, table: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The table, extended so that it holds the bands of all sets that a set of n elements can link with."""
    reach = n * at_least.denominator // at_least.numerator
    return table if reach <= table[-1][0] else bands(at_least, 2 * reach)


def weak(at_least: Fraction) -> int:
    """A part of fewer elements says little: unrelated sets can agree on it."""
    p, q = at_least.numerator, at_least.denominator
    return max(1, round(0.15 * (p + q) / max(1, q - p)))


def spare(differ: int) -> int:
    """Further parts, so that sets with at most as many weak parts agree on another one."""
    return differ // 8 + (differ >= 3)


def signatures(elements: np.ndarray, at_least: Fraction, table: list[tuple[int, int]]) -> np.ndarray:
    """Routing hashes of a sorted set: those of all parts of its band, and of the next
    band where a set that links with it can lie there. Weak parts are left out unless
    there are more than spare parts: if two sets that link agree on weak parts only,
    these are more than the spare ones, so both name theirs."""
    n = len(elements)
    k = next(i for i, (high, _) in enumerate(table) if n <= high)
    reach = n * at_least.denominator // at_least.numerator
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(W.mix(elements ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    out = []
    for band in [k, k + 1] if reach > table[k][0] else [k]:
        m = table[band][1]
        edges = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)
        cut = np.concatenate([[0], np.searchsorted(elements, edges), [n]])
        names = np.arange(m, dtype=np.uint64) + np.uint64(band << 40)
        named = W.mix(sums[cut[1:]] - sums[cut[:-1]] + W.mix(names))
        strong = np.diff(cut) >= weak(at_least)
        differ = 2 * table[band][0] * (at_least.denominator - at_least.numerator) // (at_least.denominator + at_least.numerator)
        out.append(named[strong] if m - strong.sum() <= spare(differ) else named)
    return np.concatenate(out)


def shingle_sets(chunk: W.Chunk, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, row in enumerate(chunk.rows):
        yield int(row), np.unique(W.shingles(chunk.hashes[chunk.bounds[i] : chunk.bounds[i + 1]], width))


class Index:
    """Inverted lists of some sets: that of an element holds the sets' numbers in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, firsts = np.unique(flat[order], return_index=True)
        self.firsts = np.append(firsts, len(flat))
        self.owner = owner[order]
        # all lists in one order, so that one bisection finds a set in any of them
        self.places = np.repeat(np.arange(len(self.keys)), np.diff(self.firsts)) * max(1, len(sets)) + self.owner

    def search(self, elements: np.ndarray, needed: int, wanted: Callable[[int], bool] = lambda _: True) -> list[tuple[int, int]]:
        """(set, occurrences) of the wanted sets on at least ``needed`` of the elements' lists.

        Of the lists, the longest are left out of the merge: needed - 1 of them could be,
        as a set on these alone is on too few; with a twentieth less, what the merge
        finds is on several of the others. The long lists are probed for it by bisection.
        """
        at = np.searchsorted(self.keys, elements)
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == elements[inside]
        at = at[inside]
        if needed < 1 or len(at) < needed:
            return []
        at = at[np.argsort(self.firsts[at + 1] - self.firsts[at], kind="stable")]
        n_long = max(0, needed - 1 - needed // 20)
        short, long = at[: len(at) - n_long], np.sort(at[len(at) - n_long :]) * len(self.sets)

        def probe(number: int) -> int:
            goal = long + number
            k = np.searchsorted(self.places, goal)
            return int(np.count_nonzero(self.places[np.minimum(k, len(self.places) - 1)] == goal))

        lists = [self.owner[self.firsts[i] : self.firsts[i + 1]].tolist() for i in short]
        return divide_skip(lists, needed, n_long, probe, wanted)


def divide_skip(short: list[list[int]], needed: int, n_long: int, probe: Callable[[int], int], wanted: Callable[[int], bool]) -> list[tuple[int, int]]:
    """All wanted ids that occur on at least ``needed`` of the sorted short lists and of
    n_long others, with their counts; probe(id) tells how many of the others have it.

    The short lists are heap-merged. Whenever the least id occurs on too few of them to
    reach ``needed``, the merge skips to the next that can.
    """
    least = needed - n_long
    heap = [(ids[0], k) for k, ids in enumerate(short) if ids]
    at = [0] * len(short)
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            if wanted(top) and (count := len(popped) + probe(top)) >= needed:
                found.append((top, count))
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        goal = heap[0][0]
        for k in popped:
            at[k] = bisect_left(short[k], goal, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    return found


#: Searches after which the component that others are compared with is chosen.
TRIALS = 8


def block_links(index_ids: list[int], index_sets: list[np.ndarray], query_ids: list[int] | None, query_sets: list[np.ndarray] | None, at_least: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links between the queries and the index (or within the
    index, where there are no queries).

    Sets of one component aren't compared. Within an index, those of one chosen component
    aren't searched for either: links between two of them add nothing, and links to others
    are found by the others' searches.
    """
    index = Index(index_sets)
    within = query_ids is None
    ids = index_ids if within else index_ids + query_ids
    forest, links, chosen = graph.Forest(len(ids)), [], None
    for q, elements in enumerate(index_sets if within else query_sets):
        if forest.trees == 1:
            break
        if within and q == TRIALS:
            roots = [forest.find(i) for i in range(len(ids))]
            chosen = int(np.bincount(roots).argmax())
        here = q if within else len(index_ids) + q
        if chosen is not None and forest.find(here) == forest.find(chosen):
            continue
        n = len(elements)
        low, high = smallest(n, at_least), n * at_least.denominator // at_least.numerator

        def wanted(other: int, here=here, low=low, high=high) -> bool:
            return low <= index.sizes[other] <= high and forest.find(other) != forest.find(here)

        for other, count in index.search(elements, low, wanted):
            if count >= overlap(n, index.sizes[other], at_least) and forest.join(here, other):
                links.append((ids[here], ids[other]))
    return links


def _describe(width: int):
    """(doc_id, text) -> (doc_id, n, key: 16 bytes that name the set, null for empty ones,
    short: 8 others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text"), lower=True):
                found = list(shingle_sets(chunk, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found])), pa.array([len(s) for _, s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for _, s in found], pa.binary()), pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for _, s in found], dtype=np.uint64).view(np.int64))], names=["doc_id", "n", "key", "short"])

    return run


#: Elements that a task collects before it packs them, and of a range that a task counts at
#: once (some 50 bytes each).
PACK, RANGE = 1 << 20, 1 << 22


def _starts(ranges: int, bits: int) -> np.ndarray:
    return np.array([-((-i << bits) // ranges) for i in range(ranges)], dtype=np.uint64)


def pack(elements: np.ndarray, owner: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, owners, differences) of elements by equal ranges of their upper bits, sorted;
    differences to the one before, or to the range's start, in the fewest bytes that hold all."""
    order = np.argsort(elements, kind="stable")
    top, owner = elements[order] >> np.uint64(64 - bits), owner[order]
    starts = _starts(ranges, bits)
    number = np.searchsorted(starts, top, side="right") - 1
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(top)])
    for a, e in zip(first.tolist(), [*first[1:].tolist(), len(top)], strict=True):
        i = int(number[a])
        step = np.diff(top[a:e], prepend=starts[i])
        size = max(1, -(-int(step.max()).bit_length() // 8))
        yield i, owner[a:e].tobytes(), step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(number: int, ranges: int, bits: int, owners: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    owner = np.frombuffer(owners, dtype=np.uint16)
    step = np.zeros((len(owner), 8), dtype=np.uint8)
    step[:, : len(steps) // len(owner)] = np.frombuffer(steps, dtype=np.uint8).reshape(len(owner), -1)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + _starts(ranges, bits)[number], owner


def _ranges(width: int, ranges: int, bits: int):
    """(text) -> (range, pack, keys, owners, steps). A pack is some sets; one of its rows has
    the 8-byte keys of all of them, the others 16-bit numbers of sets beside their elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.array(list(sets), dtype=np.uint64).tobytes()
            name = xxhash.xxh3_64_intdigest(keys) >> 1
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets.values()])
            rows = [(name % ranges, keys, None, None)]
            rows += [(i, None, owners, steps) for i, owners, steps in pack(np.concatenate(list(sets.values())), owner, ranges, bits)]
            for k in range(0, len(rows), 64):
                number, *blobs = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([name] * len(number), pa.int64()), *(pa.array(c, pa.binary()) for c in blobs)], names=["range", "pack", "keys", "owners", "steps"])
            sets.clear()

        for batch in batches:
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text"), lower=True):
                for _, s in shingle_sets(chunk, width):
                    key = xxhash.xxh3_64_intdigest(s.tobytes())
                    if len(s) and key not in sets:
                        sets[key] = s
                        held += len(s)
                        if held >= max(PACK, 4 * ranges) or len(sets) == 1 << 16:
                            yield from flush()
                            held = 0
        if sets:
            yield from flush()

    return run


def _common(ranges: int, bits: int):
    """Rows of _ranges(), sorted by range -> (pack, keys, owners, counts): of each row the sets
    with elements that other sets have too, and how many; rows of keys as they are. Equal sets
    of two packs count as others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row(name: int, keys: bytes | None, owners: bytes | None, counts: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys, owners, counts))], names=["pack", "keys", "owners", "counts"])

        def done() -> Iterator[pa.RecordBatch]:
            top = np.concatenate([t for _, t, _ in held])
            source = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
            owner = np.concatenate([o for *_, o in held])
            order = np.argsort(top, kind="stable")
            new = top[order][1:] != top[order][:-1]
            first = np.append(True, new)
            alone = first & np.append(new, True)  # a set has an element once
            common = np.zeros(len(top), dtype=bool)
            common[order] = ~alone
            bound = np.searchsorted(source, np.arange(len(held) + 1))
            for k, (name, *_) in enumerate(held):
                here = slice(bound[k], bound[k + 1])
                owners, counts = np.unique(owner[here][common[here]], return_counts=True)
                if len(owners):
                    yield row(name, None, owners.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes())
            held.clear()

        for batch in batches:
            for number, name, keys, owners, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now and held:
                    yield from done()
                now = number
                if keys is not None:
                    yield row(name, keys, None, None)
                else:
                    held.append((name, *unpack(number, ranges, bits, owners, steps)))
        if held:
            yield from done()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _common(), sorted by pack -> (key, n): over all ranges, how many of a set's
    elements other sets have. A pack that a table holds twice is summed twice over."""
    now, keys, total = None, None, np.zeros(1 << 16, dtype=np.int64)

    def done() -> pa.RecordBatch:
        k = np.frombuffer(keys or b"", dtype=np.uint64)
        out = pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(total[: len(k)].copy())], names=["key", "n"])
        total[:] = 0
        return out

    for batch in batches:
        for name, names, owners, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != now:
                if now is not None:
                    yield done()
                now, keys = name, None
            if names is not None:
                keys = names
            else:
                total[np.frombuffer(owners, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
    if now is not None:
        yield done()


def _route(width: int, at_least: Fraction):
    """(doc_id, text) -> (part, doc_id): a set's routing hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bands(at_least, 1 << 20)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text"), lower=True):
                parts, owner = [], []
                for row, s in shingle_sets(chunk, width):
                    table = covering(len(s), at_least, table)
                    if len(s):
                        parts.append(signatures(s, at_least, table).view(np.int64))
                        owner.append(np.full(len(parts[-1]), ids[row]))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(owner))], names=["part", "doc_id"])

    return run


def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id), sorted -> (u, v): every id of a key but the least, with the least."""
    last_key = last_id = None
    for batch in batches:
        key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        first = np.append(True, key[1:] != key[:-1])
        first[0] = key[0] != last_key
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        least = np.where(start >= 0, ids[start], last_id if last_id is not None else 0)
        last_key, last_id = key[-1], least[-1]
        pairs = np.unique(np.stack([ids, least], axis=1)[least != ids], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _members(width: int):
    """(block, own, pieces, doc_id, text) -> the same with the set's elements as bytes for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text"), lower=True):
                found = list(shingle_sets(chunk, width))
                rows = pa.array([r for r, _ in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["block", "own", "pieces", "doc_id", "elements"])

    return run


def _search(at_least: Fraction):
    """Rows sorted by (block, a, b, side, doc_id), elements last -> (u, v): links of each
    (block, a, b), where side 0 is the index and side 1 the queries (none: a = b)."""

    def done(held: dict[int, tuple[list, list]]) -> list[tuple[int, int]]:
        (ids, sets), (query_ids, query_sets) = held[0], held[1]
        return block_links(ids, sets, query_ids or None, query_sets or None, at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {0: ([], []), 1: ([], [])}, []

        def flush() -> pa.RecordBatch:
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            block, a, b, side, ids = (batch.column(i).to_pylist() for i in range(5))
            for i, elements in enumerate(batch.column(5).to_pylist()):
                if (block[i], a[i], b[i]) != now:
                    out += done(held)
                    now, held = (block[i], a[i], b[i]), {0: ([], []), 1: ([], [])}
                held[side[i]][0].append(ids[i])
                held[side[i]][1].append(np.frombuffer(elements, dtype=np.uint64))
            yield flush()
        out += done(held)
        yield flush()

    return run


def jaccard_classes(docs: DataFrame, width: int = 5, at_least: float = 0.8, piece: int = PIECE) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, n_shingles, component_id), a row
    per input row: the size of its set of distinct ``width``-word shingles, and the
    smallest doc_id that links reach. Two documents link when the Jaccard similarity of
    their sets is at least ``at_least``; exactly, whatever the groups' sizes.

    A text of fewer words is one shingle. Without words or text the set is empty and
    links with nothing: component_id = doc_id. A null doc_id links with nothing and
    keeps component_id null. Repeated rows with one doc_id count as one document each
    and share their component. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    base.tune(spark)
    ratio = Fraction(at_least).limit_denominator(10_000)
    docs = base.lean(docs, "doc_id", "text")
    seen = base.written(base.mapped(docs, _describe(width), "doc_id long, n long, key binary, short long"), "sets")
    classes = seen.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("short").alias("short"), F.count("*").alias("size"))

    # 40 bits tell 2**33 elements apart but for one in 128
    elements = seen.agg(F.sum("n")).first()[0] or 0
    ranges, bits = max(2 * base.parts(spark), -(-elements // RANGE)), 40 if elements < 1 << 33 else 48

    def enough(texts: DataFrame) -> DataFrame:
        """(doc_id, n) of class heads with enough elements that other texts' sets have."""
        packed = base.mapped(texts.select("text"), _ranges(width, ranges, bits), "range int, pack long, keys binary, owners binary, steps binary")
        packed = packed.repartition(base.parts(spark), "range").sortWithinPartitions("range")
        counted = base.mapped(packed, _common(ranges, bits), "pack long, keys binary, owners binary, counts binary")
        counted = counted.repartition(base.parts(spark), "pack").sortWithinPartitions("pack")
        common = base.mapped(counted, _sums, "key long, n long").groupBy("key").agg(F.max("n").alias("common"))
        heads = classes.select("head", "n", "short").join(common.withColumnRenamed("key", "short"), "short")
        return base.written(heads.where(F.col("common") >= F.ceil(F.col("n") * ratio.numerator / ratio.denominator)).select(F.col("head").alias("doc_id"), "n"), "heads")

    def chosen(ids: DataFrame) -> DataFrame:
        return docs.where("doc_id is not null").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")

    first = enough(chosen(enough(docs.where("doc_id is not null"))))

    # whole sets that agree on a part are tied to the least of them
    posts = base.mapped(chosen(first).select("doc_id", "text"), _route(width, ratio), "part long, doc_id long").repartition(base.parts(spark), "part").sortWithinPartitions("part", "doc_id")
    blocks = base.written(graph.components(base.mapped(posts, tie, "u long, v long")).select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "blocks")

    # a large block: pieces against pieces, in as many tasks
    sized = blocks.join(first.select("doc_id", "n"), "doc_id").groupBy("block").agg(F.ceil(F.sum("n") / piece).alias("pieces"))
    blocks = base.written(blocks.join(sized, "block"), "blocks")
    texts = chosen(blocks)
    own, other = F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    sets = base.mapped(texts.select("block", own.alias("own"), "pieces", "doc_id", "text"), _members(width), "block long, own long, pieces long, doc_id long, elements binary")
    a, b = F.least("own", "other"), F.greatest("own", "other")
    cells = sets.withColumn("other", other).select("block", a.alias("a"), b.alias("b"), (F.col("own") > a).cast("int").alias("side"), "doc_id", "elements")
    cells = cells.repartition(base.parts(spark), "block", "a", "b").sortWithinPartitions("block", "a", "b", "side", "doc_id")
    links = base.mapped(cells, _search(ratio), "u long, v long")
    roots = graph.components(links)

    heads = classes.join(roots.select(F.col("node").alias("head"), "component"), "head", "left").select("key", "size", F.coalesce("component", "head").alias("component"))
    found = base.spread(seen, base.written(heads, "heads"), ["key"], "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
