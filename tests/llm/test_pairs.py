"""Similarity joins, near duplicates, substring dedup and decontamination against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import decontam, graph, jaccard, nearvec, substring
from quillon.llm import words as W

DOCS = "doc_id long, text string, lang string, n long, key string, block long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def corpus(seed, n=120):
    """Texts with copies, near copies, shared passages, runs of one word and odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "a", "x\x00y", " ", "Ａ"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            w = words(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.6:
            a = rng.randrange(10)
            texts.append("  ".join([*rng.choices(vocabulary, k=rng.randrange(30)), *passage[a : a + rng.randrange(45, 61)], *rng.choices(vocabulary, k=rng.randrange(30))]))
        elif kind < 0.7:
            texts.append("\n".join(["run"] * rng.randrange(40, 130) + rng.choices(vocabulary, k=5)))
        else:
            texts.append("\t".join(rng.choices(vocabulary, k=rng.randrange(200))).upper())
    return [*texts, "", " \n", None, "one", "ONE", "one two", "z " * 5000]


def frame(spark, texts, order=lambda i: i * 7 % 1009):
    return spark.createDataFrame([(order(i), t, "l", 1, "k", 2) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize(("width", "at_least", "piece"), [(3, 0.9, 1 << 20), (5, 0.8, 1 << 20), (2, 0.5, 400)])
def test_jaccard_matches_brute_force(spark, width, at_least, piece):
    texts = corpus(width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, texts), width, at_least, piece).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = words(lower(t))
        sets[i * 7 % 1009] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    union = Union(sets)
    share = Fraction(at_least).limit_denominator(1000)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                union.join(a, b)
    assert got == {i: (len(s), union.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("at_least, n", [(0.8, 1_200_000), (0.9, 1_300_000)])
def test_large_sets_are_routed(at_least, n):
    texts = [" ".join(map(str, range(n))), " ".join(map(str, range(100, n)))]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["doc_id", "text"])
    parts = {1: set(), 2: set()}
    for out in jaccard._route(3, Fraction(at_least).limit_denominator(10_000))(iter([batch])):
        for part, i in zip(*(c.to_pylist() for c in out.columns), strict=True):
            parts[i].add(part)
    assert parts[1] & parts[2]


def test_jaccard_edge_cases(spark):
    assert jaccard.jaccard_classes(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "l", 1, "k", 2), (3, "a b c d e f", "l", 1, "k", 2), (3, "a b c d e f", "l", 1, "k", 2), (2, "A B C D E F", "l", 1, "k", 2), (5, None, None, None, None, None), (5, "q r s", "l", 1, "k", 2)]
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2), (5, 0, 5), (5, 1, 5)], key=repr)


def test_divide_skip_counts_occurrences():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 20))) for _ in range(rng.randrange(1, 12))]
        counts = Counter(x for ids in lists for x in ids)
        needed = rng.randrange(1, len(lists) + 1)
        n_long = rng.randrange(needed)
        lists.sort(key=len)
        short, long = lists[: len(lists) - n_long], [set(x) for x in lists[len(lists) - n_long :]]
        found = jaccard.divide_skip(short, needed, n_long, lambda i, long=long: sum(i in x for x in long), lambda _: True)
        assert sorted(found) == sorted((i, c) for i, c in counts.items() if c >= needed)


def test_block_links_span_the_brute_force_components():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))
    sets = []
    for _ in range(80):
        s = base.copy()
        k = rng.integers(0, 9)
        s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s))
    plain = [set(s.tolist()) for s in sets]
    for parts in (None, 40):
        links = jaccard.block_links(list(range(80)), sets, None, None, Fraction(9, 10)) if parts is None else [
            *jaccard.block_links(list(range(40)), sets[:40], None, None, Fraction(9, 10)), *jaccard.block_links(list(range(40, 80)), sets[40:], None, None, Fraction(9, 10)),
            *jaccard.block_links(list(range(40)), sets[:40], list(range(40, 80)), sets[40:], Fraction(9, 10)),
        ]
        got, want = Union(range(80)), Union(range(80))
        for a, b in links:
            got.join(a, b)
        for a in range(80):
            for b in range(a):
                if 10 * len(plain[a] & plain[b]) >= 9 * len(plain[a] | plain[b]):
                    want.join(a, b)
        assert [got.find(i) for i in range(80)] == [want.find(i) for i in range(80)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    union = Union(range(600))
    for a, b in links:
        union.join(a, b)
    df = spark.createDataFrame([*links, (7, None), (None, None), (599, 599)], "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: union.find(i) for i in linked}
    assert graph.components(df.where("u < 0")).count() == 0


def removed(rows, window=50):
    first, out = {}, []
    for i, w in sorted(rows, key=lambda r: r[0]):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, w in rows:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def test_substring_matches_brute_force(spark):
    texts = corpus(11, 150) + [" ".join(["run"] * k) for k in (50, 60, 51)] + ["run " * 49]
    got = substring.cut_repeats(frame(spark, texts, lambda i: i * 31 % 499), carry=("lang", "key")).collect()
    want = removed([(i * 31 % 499, words(t)) for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and r.carried.lang == "l" for r in got)


def test_substring_edge_cases(spark):
    assert substring.cut_repeats(frame(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long, "l", 1, "k", 2), (4, long, "l", 1, "k", 2), (4, long, "l", 1, "k", 2), (9, long, None, None, None, None), (1, None, "l", 1, "k", 2)]
    got = substring.cut_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=repr) == sorted([(None, 60, 0), (4, 60, 0), (4, 60, 0), (9, 60, 60), (1, 0, 0)], key=repr)
    with pytest.raises(ValueError, match="50"):
        substring.cut_repeats(frame(spark, []), window=49)


def test_substring_rows_that_share_ids(spark):
    a, c, d, p = (" ".join(f"{x}{i}" for i in range(60)) for x in "acdp")
    long = " ".join(f"l{i}" for i in range(300))
    for rows in (
        [(1, a), (4, a), (4, c)],
        [(1, a), (2, c), (4, a), (4, c)],
        [(1, p + " x"), (4, long + " " + p), (4, d)],
        [(4, a), (4, a + " x"), (4, c + " " + a), (4, a), (9, long), (9, long), (9, c)],
    ):
        got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == sorted(removed([(i, words(t)) for i, t in rows]))


def test_long_repeats_are_found_by_high_symbols(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    chunk = W.Chunk(np.arange(2), [" ".join(long).encode(), " ".join(["x"] * 7 + long + ["y"] * 9).encode()], False)
    text_of = substring._texts(chunk)
    x = substring.recompress(chunk.hashes, text_of)
    sets = [dict(zip((substring._high(chunk.hashes, x)[0][own]).tolist(), (x.high[2] - x.high[1])[own].tolist(), strict=True)) for own in (text_of[x.high[1]] == k for k in range(2))]
    both = set(sets[0]) & set(sets[1])
    assert max(sets[0][k] for k in both) > 300
    rows = [(1, " ".join(long)), (2, " ".join(["x"] * 7 + long + ["y"] * 9)), (3, " ".join(long[100:2500])), (4, " ".join(long[:1000] + ["z"] + long[1001:]))]
    got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == sorted(removed([(i, words(t)) for i, t in rows]))


def test_equal_substrings_get_equal_inner_symbols():
    rng = np.random.default_rng(0)
    for _ in range(200):
        alphabet = rng.integers(1, 2**63, rng.integers(1, 12), dtype=np.uint64)
        inner = rng.choice(alphabet, 50)
        seen = []
        for _ in range(2):
            left, right = rng.choice(alphabet, rng.integers(0, 60)), rng.choice(alphabet, rng.integers(0, 60))
            w = np.concatenate([left, inner, right])
            x = substring.recompress(w, np.zeros(len(w), dtype=np.int64))
            names, at, lead, tail = x.names, x.at, x.lead, x.tail
            a = len(left)
            seen.append([(int(names[k]), int(at[k]) - a) for k in range(lead[a], tail[a + 49])])
            ends = np.append(at[1:], len(w))
            whole = {int(n) for n, s, e in zip(names, at, ends, strict=True) if s >= a and e <= a + 50}
            seen[-1] = (seen[-1], whole)
        assert seen[0][0] == seen[1][0]
        assert seen[0][1] & seen[1][1], "a window without a common symbol"


def brute_leaks(docs, items, width=5, at_least=0.8):
    shingles = lambda w: [tuple(w[j : j + width]) for j in range(len(w) - width + 1)] or ([tuple(w)] if w else [])
    out = {}
    for d, text in docs:
        w = words(lower(text))
        for i, item in items:
            v = words(lower(item))
            if not v or len(w) < min(width, len(v)):
                continue
            k = min(width, len(v))
            s, c = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)], Counter(shingles(v))
            n = sum(c.values())
            m = min(n, len(s))
            for a in range(len(s) - m + 1):
                x = Counter(s[a : a + m])
                least = sum((x & c).values())
                if least / (m + n - least) >= at_least and (d, i) not in out:
                    out[d, i] = a
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([15, 20, 20, 31, 45, 59, 5, 3, 60])] + [(20, ""), (21, None)]
    docs = []
    for d in range(80):
        w = rng.choices(vocabulary, k=rng.randrange(150))
        if d % 2:
            v = words(rng.choice(items[:9])[1])
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in v] if d % 3 == 0 else v
        docs.append((d, " ".join(w)))
    docs += [(90, items[5][1].rsplit(" ", 4)[0]), (91, ""), (92, None), (93, "w1 " * 3000 + items[3][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")
    df = spark.createDataFrame([(d, t, "l", 1, "k", 2) for d, t in docs], DOCS)
    want = brute_leaks(docs, items)
    for at_once in (4096, 3):
        got = decontam.find_leaks(df, bench, items=at_once).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(want)
        assert all(r.similarity >= 0.8 for r in got)
    assert decontam.find_leaks(df, bench.where("item_id < 0")).count() == 0 and decontam.find_leaks(df.where("doc_id < 0"), bench).count() == 0


@pytest.mark.parametrize("n", [10, 200, 4096])
def test_multi_index_finds_all_within_the_radius_and_little_else(n):
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 16, (n, decontam.BLOCKS), dtype=np.uint16)
    groups = rng.integers(0, 1 << 10, n) * (n == 4096)
    index = decontam.Index(own, groups)
    windows = rng.integers(0, 1 << 16, (400, decontam.BLOCKS), dtype=np.uint16)
    of = rng.integers(0, n, 200)
    for k in range(200):
        bits = np.zeros(128, dtype=np.uint8)
        bits[rng.choice(128, decontam.RADIUS, replace=False)] = 1
        windows[k] = own[of[k]] ^ np.packbits(bits).view(np.uint16)
    theirs = np.concatenate([groups[of], groups[of]])
    near = set(index.near(windows, theirs))
    assert {(k, int(of[k])) for k in range(200)} <= near
    assert near == {(i, k) for i in range(400) for k in np.flatnonzero((groups == theirs[i]) & (decontam.distance(windows[i][None], own) <= decontam.RADIUS)).tolist()}
    row, _ = index.candidates(windows[200:], theirs[200:])
    assert len(row) < 0.11 * 200 * n


def test_fingerprints_recall_at_the_threshold():
    """Pairs of a similarity from 0.8 that the radius holds, against all of them."""
    rng = np.random.default_rng(2)
    found = total = 0
    for size in (9, 20, 40, 56):
        for _ in range(250):
            item = rng.integers(0, 2**63, size, dtype=np.uint64)
            window = item.copy()
            changed = int(size * rng.uniform(0, 1 / 9))
            window[rng.choice(size, changed, replace=False)] = rng.integers(0, 2**63, changed, dtype=np.uint64)
            assert decontam.similarity(Counter(item.tolist()), Counter(window.tolist())) >= 0.8
            a, b = (decontam.fingerprints(x, size) for x in (item, window))
            total += 1
            found += decontam.distance(a[0], b[0]) <= decontam.RADIUS
    assert found >= 0.995 * total


def near_vectors(seed, n=600, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:150] = rng.normal(size=dim) + rng.normal(size=(150, dim)) * 0.2
    x[200:300] = x[300:400] + rng.normal(size=(100, dim)) * 0.25
    x[400:410] = x[0]
    return np.float32(x)


def brute_links(ids, x, at_least=0.9):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= at_least
    np.fill_diagonal(s, False)
    union = Union(ids)
    for a, b in zip(*np.nonzero(s), strict=True):
        union.join(ids[a], ids[b])
    return {i: (int(s[k].sum()), union.find(i), union.find(i) == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(nearvec, "PIECE", 64)
    x = near_vectors(3)
    ids = [i * 13 % 1009 for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>, label int")
    want = brute_links(ids, x)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nearvec.link_vectors(df).collect()}
    assert got == want
    fast = {r.vec_id: r.n_links for r in nearvec.link_vectors(df, queries=100).collect()}
    assert sum(fast.values()) >= 0.99 * sum(n for n, _, _ in want.values()) and all(fast[i] <= want[i][0] for i in ids)


@pytest.mark.parametrize("dim, rank", [(64, 3), (384, 6)])
def test_vectors_of_low_rank_keep_all_links(spark, dim, rank):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(2048, rank)) @ rng.normal(size=(rank, dim))
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in nearvec.link_vectors(df).collect()}
    assert [got[i] for i in ids] == want.tolist()
    got = {r.vec_id: r.n_links for r in nearvec.link_vectors(df, queries=300).collect()}
    assert sum(got.values()) >= 0.99 * want.sum()


def test_many_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 16))
    x[1] = x[0] * 1.01 + rng.normal(size=16) * 0.01
    df = spark.createDataFrame([(i, x[0 if i % 3 else 1 + i // 3 % 2].tolist()) for i in range(30000)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in nearvec.link_vectors(df).collect()}
    assert all(got[i] == (24999 if i % 3 or i // 3 % 2 == 0 else 4999) for i in range(30000))


def test_vectors_edge_cases(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 0.0], 1), (8, [], 1), (9, [float("inf"), 0.0], None), (2, [2.0, 0.0], 2)]
    got = sorted((tuple(r) for r in nearvec.link_vectors(spark.createDataFrame(rows, kinds)).collect()), key=repr)
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (None, 0, None, None)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=repr)
    assert nearvec.link_vectors(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (7, [0.0, 1.0], 2), (8, [0.0, 2.0], 1), (9, [-1.0, 0.0], 1), (10, [0.0, 0.0], 1), (11, [0.0, 0.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in nearvec.link_vectors(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(1, 1, 1), (5, 1, 1), (5, 2, 1), (7, 2, 1), (7, 2, 1), (8, 2, 1), (9, 0, 9), (10, 0, 10), (11, 0, 11)]
    assert [r.n_links for r in nearvec.link_vectors(spark.createDataFrame([(1, None, 1)], kinds)).collect()] == [0]


def test_word_hashes_part_words_as_the_pattern_does():
    texts = ["a b", "", "  x\ty\x0bz\x1cq ", "É é ", "one"]
    (chunk,) = W.chunks(range(5), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        a, e = chunk.bounds[i], chunk.bounds[i + 1]
        assert [chunk.data[s:f].decode() for s, f in zip(chunk.starts[a:e], chunk.ends[a:e], strict=True)] == words(t)
    assert chunk.hashes[0] != chunk.hashes[1] and len(set(chunk.hashes.tolist())) == len({w for t in texts for w in words(t)})
