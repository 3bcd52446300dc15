"""Embedding near-dedup by product quantisation.

Equal vectors are one class from the start; classes are compared and count with their size.
The coarse inverted lists are those of a product of two quantisers, one for each half of the
dimensions, so their number grows with the input while few centroids are fitted and
looked at. The centroids and, per subspace, the codes of the residuals are fitted on a
bounded sample; every vector is indexed: in its nearest centroids' list, by its residual's
codes and the length of what they miss.

How far a vector probes is measured: all links of QUERIES vectors against all rows, in
blocks, tell how far links reach across the borders of lists, and every list whose
border is as near is probed (all links of small inputs are measured, so none is lost there;
without links to measure, the whole link distance is probed). A vector goes to each group
of lists once, with the numbers of those that it probes. In a list, asymmetric distances
(the query's residual against the codes, by table lookup) less what the codes miss bound
the true distance from below, so none is lost there; what stays within the link distance is
reranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import base, graph

#: Vectors that the quantisers are fitted on at most, centroids of a half at most, and vectors of a list.
SAMPLE, CENTRES, LIST = 32768, 2048, 256
#: Bytes of the sample at most.
SAMPLE_BYTES = 128 << 20
#: Vectors whose links tell how far to probe, and steps of the link distance that are told apart.
QUERIES, STEPS = 1024, 128
#: Vectors of a piece of a list, and of a group of pieces, that one task holds, and queries at once.
PIECE, AT_ONCE = 4096, 512
CODES, SUBSPACE, ROUNDS, SEED = 256, 8, 8, 3
#: Rows that leave a task at once, and numbers in a block of distances.
ROWS, BLOCK = 1 << 14, 1 << 21
SLACK = 1e-4


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres; for as many x as a block holds."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the nearest centres."""
    return np.concatenate([distances(x[s], centres).argmin(axis=1) for s in _blocks(len(x), len(centres))] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=c, minlength=k) for c in x.T], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


@dataclass
class Quantiser:
    halves: list[np.ndarray]  # centres of each half of the dimensions
    books: list[np.ndarray]  # codes of each subspace
    cuts: list[tuple[int, int]]

    @property
    def dim(self) -> int:
        return sum(h.shape[1] for h in self.halves)

    @property
    def lists(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        d = self.halves[0].shape[1]
        return [x[:, :d], x[:, d:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the lists of unit vectors."""
        a, b = (nearest(p, h) for p, h in zip(self.parts(x), self.halves, strict=True))
        return a * len(self.halves[1]) + b

    def centre(self, cell: np.ndarray) -> np.ndarray:
        a, b = np.divmod(cell, len(self.halves[1]))
        return np.concatenate([self.halves[0][a], self.halves[1][b]], axis=1)

    def margins(self, x: np.ndarray, cell: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far it is from each x in its list to the border of another list."""
        out = np.zeros(len(x))
        n = len(self.halves[1])
        for p, h, i, j in zip(self.parts(x), self.halves, np.divmod(cell, n), np.divmod(other, n), strict=True):
            gap = np.sqrt(((h[i] - h[j]) ** 2).sum(axis=1))
            gain = ((p - h[j]) ** 2).sum(axis=1) - ((p - h[i]) ** 2).sum(axis=1)
            out += np.divide(gain, 2 * gap, out=np.zeros(len(x)), where=gap > 0) ** 2
        return np.sqrt(out)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what they miss) of unit vectors."""
        cell = self.cells(x)
        rest = x - self.centre(cell)
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        missed = rest - np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return cell, codes, np.sqrt((missed * missed).sum(axis=1))

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per subspace, products of each query with each code, for the lists of all centres."""
        return [(queries[:, a:b] @ book.T).astype(np.float32) for (a, b), book in zip(self.cuts, self.books, strict=True)]

    def offsets(self, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What of the squared distance to a code depends on the code and the list's centre alone."""
        return sum((((book * book).sum(axis=1) + 2 * book @ centre[a:b])[codes[:, m]] for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True))), np.zeros(len(codes)))


def fit(sample: np.ndarray, centres: int) -> Quantiser:
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    cuts = [(a, min(a + SUBSPACE, dim)) for a in range(0, dim, SUBSPACE)]
    q = Quantiser([kmeans(p, min(centres, len(p)) if p.shape[1] else 1, rng) for p in (sample[:, : (dim + 1) // 2], sample[:, (dim + 1) // 2 :])], [], cuts)
    rest = sample - q.centre(q.cells(sample))
    q.books = [kmeans(rest[:, a:b], min(CODES, len(rest)), rng) for a, b in cuts]
    return q


def units(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their unit vectors in double) of the vectors that can link: of dim (or, for
    None, the commonest) components, all finite, not all zero."""
    lists = column.cast(pa.large_list(pa.float64()))
    flat = lists.flatten()
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.array([x or 0 for x in lists.value_lengths().to_pylist()], dtype=np.int64), 0)
    if dim is None:
        dim = int(np.bincount(size).argmax()) if len(size) else 0
    rows = np.flatnonzero((size == dim) & (dim > 0))
    first = np.append(0, np.cumsum(size))[rows]
    values = flat.to_numpy(zero_copy_only=False)
    x = values[first[:, None] + np.arange(dim)[None]] if len(rows) else np.empty((0, dim))
    top = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(x).all(axis=1) & (top > 0)
    rows, x = rows[good], x[good] / top[good][:, None]
    return rows, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _vectors(column: pa.Array, single: bool) -> np.ndarray:
    """Unit vectors in double from the bytes that _encode() made."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32 if single else np.float64).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


#: Columns of an encoded class, and of one that is dealt to a group.
CODED = ["vec_id", "k1", "size", "list", "missed", "codes", "vector"]
DEALT = ["group", "side", "home", "probes", *CODED]
KINDS = dict(k2="long", group="long", side="int", home="long", probes="binary", vec_id="long", k1="long", size="long", list="long", missed="double", codes="binary", vector="binary")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{c} {KINDS[c]}" for c in names)


def _encode(q: Quantiser, single: bool):
    """(k2, embedding, vec_id, k1, size) -> (k2, vec_id, k1, size, list, missed, codes, vector):
    the vector as bytes, in single precision, scaled by a power of two, where it came so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 4096):
                piece = batch.slice(part, 4096)
                rows, x = units(piece.column(1), q.dim)
                cell, codes, missed = q.encode(x)
                if single and len(rows):
                    raw = piece.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    _, power = np.frexp(np.abs(raw).max(axis=1, initial=0))
                    x = np.ldexp(raw, -power[:, None])
                own = piece.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], pa.array(cell, pa.int64()), pa.array(missed), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["k2", *CODED])

    return run


def probes(cell: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a vector of the first list probes the second (else one of the second the first)."""
    return (other > cell) == ((other + cell) % 2 == 0)


def _measure(q: Quantiser, queries: np.ndarray, at_least: float, reach: float, single: bool):
    """Encoded vectors -> (step, n): how many links of the queries need a probe so many
    STEPS of the link distance across a border."""
    theirs = q.cells(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in batches:
            for s in _blocks(len(batch), len(queries)):
                piece = batch.slice(s.start, s.stop - s.start)
                x, cell = _vectors(piece.column(6), single), piece.column(3).to_numpy()
                row, k = np.nonzero(x @ queries.T >= at_least)
                for a in range(0, len(row), ROWS):
                    i, j = row[a : a + ROWS], k[a : a + ROWS]
                    first = probes(cell[i], theirs[j])[:, None]
                    u, v = np.where(first, x[i], queries[j]), (np.where(first[:, 0], *pair) for pair in ((cell[i], theirs[j]), (theirs[j], cell[i])))
                    need = q.margins(u, *v)
                    step = np.ceil(need / reach * STEPS).astype(np.int64)
                    # nor does a query tell anything of itself
                    count += np.bincount(np.minimum(step, STEPS)[(x[i] != queries[j]).any(axis=1)], minlength=STEPS + 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], names=["step", "n"])

    return run


def _deal(q: Quantiser, pieces: np.ndarray, group: np.ndarray, across: float, single: bool):
    """Encoded vectors -> (group, side, home, probes, ...): each to its own piece's group
    as side 0, and as side 1 to all groups with pieces that it probes. Pieces are numbered
    through all lists. A pair meets once: where the lists differ, in that of the larger
    number if the sum of both is even, else in the other; in one list, in the larger piece."""
    last = np.cumsum(pieces, dtype=np.int64)
    width = len(q.halves[1])

    def near(x: np.ndarray, own: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs whose border is within ``across``."""
        found = []
        for p, h, i in zip(q.parts(x), q.halves, own, strict=True):
            d = distances(p, h)
            gap = np.sqrt(distances(h[i], h))
            gain = d - d[np.arange(len(x)), i][:, None]
            margin = np.divide(gain, 2 * gap, out=np.zeros_like(gain), where=gap > 0)
            margin[np.arange(len(x)), i] = 0
            row, cell = np.nonzero(margin <= across + SLACK)
            found.append((row, cell, margin[row, cell]))
        (row, a, m), (row_b, b, m_b) = found
        first = np.searchsorted(row_b, np.arange(len(x) + 1))
        n = (first[1:] - first[:-1])[row]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[row], n)
        row, a, m = np.repeat(row, n), np.repeat(a, n), np.repeat(m, n)
        on = m**2 + m_b[at] ** 2 <= (across + SLACK) ** 2
        return row[on], a[on] * width + b[at[on]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _blocks(len(batch), 4 * max(map(len, q.halves)) + 512):
                piece = batch.slice(s.start, s.stop - s.start)
                ids, cell = piece.column(0).to_numpy(), piece.column(3).to_numpy()
                if not len(ids):
                    continue
                row, goal = near(_vectors(piece.column(6), single), np.divmod(cell, width))
                keep = (pieces[goal] > 0) & ((goal == cell[row]) | probes(cell[row], goal))
                row, goal = row[keep], goal[keep]
                first = last - pieces
                own = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % pieces[cell]
                home = first[cell] + own
                n = pieces[goal]
                row, goal, at = np.repeat(row, n), np.repeat(goal, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keep = (goal != cell[row]) | (at >= own[row])
                row, number = row[keep], (first[goal] + at)[keep]
                order = np.lexsort((number, row))
                row, number = row[order], number[order]
                at = group[number]
                edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
                raw = number.astype("<i4").tobytes()
                sent = [b""] * len(ids) + [raw[4 * a : 4 * e] for a, e in zip(edge.tolist(), [*edge[1:].tolist(), len(row)], strict=True)]
                row, at = np.append(np.arange(len(ids)), row[edge]), np.append(group[home], at[edge])
                side = np.append(np.zeros(len(ids), np.int32), np.ones(len(edge), np.int32))
                for k in range(0, len(row), ROWS):
                    r = slice(k, k + ROWS)
                    take = pa.array(row[r])
                    yield pa.RecordBatch.from_arrays([pa.array(at[r], pa.int64()), pa.array(side[r]), pa.array(home[row[r]], pa.int64()), pa.array(sent[r], pa.binary()), *(c.take(take) for c in piece.columns)], names=DEALT)

    return run


class _Piece:
    """A piece of a list: ids, sizes, codes, vectors, and what was found so far."""

    def __init__(self, q: Quantiser, ids, key, size, cell, missed, codes, x):
        self.ids, self.key, self.size, self.missed, self.codes, self.x = ids, key, size, missed, codes, x
        self.centre = q.centre(np.array([cell]))[0]
        self.offsets = q.offsets(self.centre, codes).astype(np.float32)
        self.counts = np.zeros(len(ids), dtype=np.int64)
        self.label = np.arange(len(ids))

    def match(self, tables: list[np.ndarray], queries: np.ndarray, at_least: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, indexed) numbers of the links between queries and the piece."""
        rest = queries - self.centre
        d = ((rest * rest).sum(axis=1).astype(np.float32)[:, None] + self.offsets[None]) / 2
        for m, t in enumerate(tables):
            d -= t[:, self.codes[:, m]]
        a, b = np.nonzero(np.sqrt(np.maximum(2 * d, 0)) - self.missed[None] <= reach + SLACK)
        on = [np.einsum("ij,ij->i", queries[a[k : k + ROWS]], self.x[b[k : k + ROWS]]) >= at_least for k in range(0, len(a), ROWS)]
        keep = np.concatenate(on) if on else np.empty(0, dtype=bool)
        return a[keep], b[keep]


def _match(q: Quantiser, at_least: float, reach: float, single: bool):
    """Dealt rows, sorted by (group, side) -> (u, k1, v, n): the sizes of the classes that the
    class of u and k1 links with here (v null), and a spanning set of the links u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: list[tuple] = []
        index: dict[int, _Piece] | None = None

        def emit(*columns) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array([None] * n if c is None else c, pa.int64()) for c in columns], names=["u", "k1", "v", "n"])

        def built() -> dict[int, _Piece]:
            if not held:
                return {}
            home, ids, key, size, cell, missed, codes, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return {int(h): _Piece(q, ids[on], key[on], size[on], cell[on][0], missed[on], codes[on], x[on]) for h in np.unique(home) for on in [home == h]}

        def finish():
            for piece in (index or {}).values():
                if piece.counts.any():
                    at = np.flatnonzero(piece.counts)
                    yield emit(piece.ids[at], piece.key[at], None, piece.counts[at])

        def search(piece: _Piece, tables, ids, key, size, same, x):
            a, b = piece.match(tables, x, at_least, reach)
            # within a piece each pair meets twice, and each class itself
            keep = ~same[a] | (ids[a] < piece.ids[b]) | ((ids[a] == piece.ids[b]) & (key[a] < piece.key[b]))
            a, b = a[keep], b[keep]
            np.add.at(piece.counts, b, size[a])
            own = np.bincount(a, weights=piece.size[b], minlength=len(ids)).astype(np.int64)
            at = np.flatnonzero(own)
            if len(at):
                yield emit(ids[at], key[at], None, own[at])
            u, v = [], []
            bound = np.searchsorted(a, np.arange(len(ids) + 1))
            for i in at:
                mine = b[bound[i] : bound[i + 1]]
                trees, top = np.unique(piece.label[mine], return_index=True)
                if len(trees) > 1:
                    piece.label[np.isin(piece.label, trees)] = trees[0]
                u += [ids[i]] * len(trees)
                v += piece.ids[mine[top]].tolist()
            if u:
                yield emit(u, None, v, None)

        for batch in batches:
            group, side = (batch.column(k).to_numpy() for k in range(2))
            if not len(group):
                continue
            edge = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
            for a, e in zip(edge, np.append(edge[1:], len(group)), strict=True):
                if group[a] != now:
                    yield from finish()
                    now, held, index = group[a], [], None
                part = batch.slice(a, e - a)
                home, ids, key, size, cell, missed = (part.column(k).to_numpy() for k in (2, *range(4, 9)))
                x = _vectors(part.column(10), single)
                if side[a] == 0:
                    codes = np.frombuffer(b"".join(part.column(9).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                    held.append((home, ids, key, size, cell, missed, codes, x))
                    continue
                if index is None:
                    index = built()
                sent = part.column(3).to_pylist()
                for i in range(0, len(ids), AT_ONCE):
                    some = sent[i : i + AT_ONCE]
                    tables = q.tables(x[i : i + AT_ONCE])
                    number = np.frombuffer(b"".join(some), dtype="<i4")
                    row = np.repeat(np.arange(len(some)), [len(p) // 4 for p in some])
                    for k in np.unique(number).tolist():
                        if k in index:
                            r = row[number == k]
                            yield from search(index[k], [t[r] for t in tables], ids[i + r], key[i + r], size[i + r], home[i + r] == k, x[i + r])
        yield from finish()

    return run


def link_vectors(vectors: DataFrame, at_least: float = 0.9, sample: int = SAMPLE, queries: int = QUERIES) -> DataFrame:
    """vectors(vec_id long, embedding array of numbers, ...) -> (vec_id, n_links,
    component_id, kept), a row per input row. Two vectors link if their cosine, in double
    precision, is at least ``at_least`` (above 0); n_links: to how many others a vector
    links; component_id: the smallest vec_id that links reach; kept: vec_id = component_id.

    Vectors that are null, zero, hold null or non-finite components, or have another
    length than most of the sample link with nothing, and neither does a null vec_id
    (component_id and kept are null). Equal rows (vec_id and vector) count once; rows that
    share a vec_id but not the vector are counted as vectors of their own, each with its
    n_links, but share their component. Other columns are ignored; no rows give no rows.
    The quantisers are fitted on at most ``sample`` vectors, taken by a hash of the vector;
    all are indexed. How far is probed is measured on all links of ``queries`` of them.
    """
    spark = vectors.sparkSession
    base.tune(spark)
    n = base.parts(spark)
    reach = float(np.sqrt(2 - 2 * at_least))
    keys = ["k1", "k2"]
    # equal components give equal hashes; -0.0 is a vector of its own, at no distance
    vectors = base.lean(vectors, "vec_id", "embedding").withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    usable = vectors.where("vec_id is not null and embedding is not null")
    members = base.written(usable.select("vec_id", *keys).distinct(), "members")
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size"), F.min("vec_id").alias("vec_id"))
    classes = usable.groupBy(*keys).agg(F.first("embedding").alias("embedding")).join(sizes, keys)
    classes = base.written(classes.select(*keys, "vec_id", "embedding", "size"), "classes")

    n_classes, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    some = classes.orderBy(*keys).limit(min(sample, max(1, SAMPLE_BYTES // (8 * (dim or 1))))).select("embedding").toArrow()
    x = units(some.column(0).combine_chunks(), None)[1] if some.num_rows else np.empty((0, 0))
    if not len(x):
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    q = fit(x, int(min(CENTRES, max(1, np.sqrt(n_classes / LIST)), max(1, len(x) // 8))))
    single = "float" in vectors.schema["embedding"].dataType.simpleString()
    encoded = base.written(base.mapped(classes.select("k2", "embedding", "vec_id", "k1", "size"), _encode(q, single), _ddl(["k2", *CODED])), "codes")
    coded = encoded.select(*CODED)

    # a bounded number of steps comes to the driver, then of each list how many vectors it has
    steps = base.mapped(coded, _measure(q, x[:queries], at_least, reach, single), "step long, n long").groupBy("step").agg(F.sum("n")).collect()
    links = sum(r[1] for r in steps)
    every = n_classes <= min(queries, len(x))
    across = reach * min(1.0, max((r[0] for r in steps), default=0 if every else STEPS) / STEPS * (1 if every or not links else 1 + 3 / links**0.5))
    have = coded.groupBy("list").agg(F.count("*").alias("n")).toArrow()
    count = np.zeros(q.lists, dtype=np.int64)
    count[have.column(0).to_numpy()] = have.column(1).to_numpy()
    pieces = (-(-count // PIECE)).astype(np.int32)
    group = (np.cumsum(np.repeat(count / np.maximum(pieces, 1), pieces)) // PIECE).astype(np.int32)
    dealt = base.mapped(coded, _deal(q, pieces, group, across, single), _ddl(DEALT)).repartition(n, "group").sortWithinPartitions("group", "side")
    found = base.written(base.mapped(dealt, _match(q, at_least, reach, single), "u long, k1 long, v long, n long"), "found")

    counts = found.where("v is null").groupBy(F.col("u").alias("vec_id"), "k1").agg(F.sum("n").alias("n"))
    info = encoded.select(*keys, "vec_id", "size").join(counts, ["vec_id", "k1"], "left")
    info = base.written(info.select(*keys, F.col("vec_id").alias("head"), "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "info")
    several = base.written(members.join(members.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1"), "vec_id").select("vec_id", *keys), "several")
    links = found.where("v is not null").select("u", "v").union(base.spread(several, info, keys, "vec_id").where("head is not null").select("vec_id", "head"))
    roots = graph.components(links).withColumnRenamed("node", "head")
    info = base.written(info.join(roots, "head", "left").select(*keys, "size", "n_links", F.coalesce("component", "head").alias("root")), "roots")
    out = base.spread(usable.select("vec_id", *keys), info, keys, "vec_id").select("vec_id", "n_links", "root")
    out = out.union(vectors.where("vec_id is null or embedding is null").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
