"""Functions over sorted batches, cut at every place."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quillon.llm import jaccard, substring


def batches(rng, rows, names):
    """The rows in batches of random sizes, empty ones among them."""
    at = 0
    while at < len(rows) or rng.random() < 0.3:
        n = rng.randrange(4)
        part = rows[at : at + n]
        at += n
        columns = list(zip(*part, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def collected(out):
    return [tuple(r.values()) for b in out for r in b.to_pylist()]


def test_streams_over_cut_runs():
    rng = random.Random(1)
    for _ in range(300):
        rows = sorted((rng.randrange(5), rng.randrange(4)) for _ in range(rng.randrange(25)))
        ids = defaultdict(list)
        for k, i in rows:
            ids[k].append(i)
        got = set(collected(jaccard.tie(batches(rng, rows, ["part", "doc_id"]))))
        assert got == {(i, min(v)) for v in ids.values() for i in v if i != min(v)}


def test_shared_symbols_over_cut_runs():
    rng = random.Random(1)
    for _ in range(500):
        rows = []
        for bucket in range(rng.randrange(6)):
            for key in rng.sample([(s, m) for s in range(3) for m in range(3)], rng.randrange(9)):
                low = rng.randrange(3)
                rows.append((*key, bucket, low, max(low, rng.randrange(4))))
        rows.sort(key=lambda r: (r[0], r[1], r[3]))
        ids = defaultdict(list)
        for s, m, _, low, high in rows:
            ids[s, m] += [low, high]
        got = sorted(collected(substring._shared(batches(rng, rows, ["symbol", "mark", "bucket", "low", "high"]))))
        least = {k: min(v) for k, v in ids.items()}
        assert got == sorted((b, s, m, least[s, m]) for s, m, b, _, high in rows if max(ids[s, m]) > least[s, m] and (m == 0 or high > least[s, m]))


def test_packed_elements_come_back():
    rng = np.random.default_rng(2)
    for bits in (40, 48):
        for n in (1, 7, 5000):
            elements = rng.integers(0, 2**64, n, dtype=np.uint64)
            owner = rng.integers(0, 2**16, n).astype(np.uint16)
            found = []
            for number, owners, steps in jaccard.pack(elements, owner, 13, bits):
                top, who = jaccard.unpack(number, 13, bits, owners, steps)
                assert ((top * np.uint64(13)) >> np.uint64(bits) == number).all() if bits < 60 else True
                found += zip(top.tolist(), who.tolist(), strict=True)
            assert sorted(found) == sorted(zip((elements >> np.uint64(64 - bits)).tolist(), owner.tolist(), strict=True))


def test_common_elements_are_counted_per_set():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"d", b"e"], rng.integers(0, 30))) for _ in range(40)]
    sets = {}
    (chunk,) = jaccard.W.chunks(range(40), texts)
    for _, s in jaccard.shingle_sets(chunk, 3):
        if len(s):
            sets[jaccard.xxhash.xxh3_64_intdigest(s.tobytes())] = set(s.tolist())
    def table(rows):
        kinds = {"range": pa.int32(), "pack": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.binary())) for k in rows[0]], names=list(rows[0]))

    rows = [r for b in jaccard._ranges(3, 5, 40)([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])]) for r in b.to_pylist()]
    packed = table(sorted(rows, key=lambda r: r["range"]))
    counted = [r for b in jaccard._common(5, 40)([packed.slice(i, 2) for i in range(0, len(rows), 2)]) for r in b.to_pylist()]
    counted = table(sorted(counted, key=lambda r: r["pack"]))
    got = {key % 2**64: n for key, n in collected(jaccard._sums([counted.slice(i, 3) for i in range(0, len(counted), 3)]))}
    assert set(got) == set(sets)
    for key, s in sets.items():
        others = set().union(*(o for k, o in sets.items() if k != key))
        assert got[key] == len(s & others)
