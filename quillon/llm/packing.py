"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

Documents become token ids. What fills whole windows is cut off first; the rest of each
document goes to an inverted index, sharded by runs of documents, with the corpus's
document frequencies. Shard by shard, the next unused rest is a seed; all its terms
query the index, whose unused neighbours fill the seed's window in the order of their
scores, the last one cut to fit. What is left at a shard's end is cut to powers of two,
which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import base

WINDOW, END = 2048, 1
#: Documents of a shard of the index.
SHARD = 2048
K1, B = 1.2, 0.75
#: Words, and words without punctuation, that a worker remembers.
CACHE = 1_000_000
#: Neighbours that are put in order at first, and the rest only if these don't fill a window.
FIRST = 16
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(spec: dict):
    """The tokenizer ``spec`` for words that it neither normalises nor parts, in its letters for
    bytes; None if it does more than lower, compose and part letters from others."""
    from tokenizers import Tokenizer

    kinds = [[x["type"] for x in (spec[outer] or {}).get(inner, [])] for outer, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or spec["model"]["end_of_word_suffix"] != "</w>":
        return None
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))


def _letter_of_byte() -> dict[int, int]:
    """Byte-level BPE's letter of each byte but the line end, which parts words."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 256 + k for k, b in enumerate(rest)} | {10: 10}


class Encoder:
    """Token ids of texts as little-endian 16-bit bytes, by way of a cache of words.

    White space parts words for the tokenizer too, so a text's ids are its words' ids, and
    as it ignores case, ASCII letters are lowered first (but in texts that could hold a
    special token). The words of many texts are numbered, and each is looked up once. New
    words of letters alone are encoded many at once and told apart by the tokens that end a
    word. Lower-case letters up to U+00FF need no normalising: these the model encodes by
    itself, and only behind them ASCII punctuation is surely a token sequence of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        if self.size > 1 << 16:
            raise ValueError("more ids than 16 bits hold")
        self.plain, self.letter_of = _plain(json.loads(self.tokenizer.to_str())), _letter_of_byte()
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _each(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2").tobytes() for x in coded]

    def _letters(self, words: list[bytes], plain: bool) -> Iterator[bytes]:
        tokenizer = self.plain if plain else self.tokenizer
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            joined = b"\n".join(part)
            text = joined.decode("latin-1").translate(self.letter_of) if plain else joined.decode()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                yield from self._each(part)
                continue
            raw, at = ids.tobytes(), [0, *(2 * stops).tolist()]
            yield from (raw[a:e] for a, e in pairwise(at))

    def learn(self, words: list[bytes]) -> None:
        known, cores, tails = self.words, self.cores, self.tails
        trimmed = [w.rstrip(_TAIL) for w in words] if self.plain else words
        plain, letters, others = [], [], []
        for core in set(trimmed).difference(cores) if self.plain else ():
            s = core.decode()
            # of letters beyond ASCII, UTF-8 begins those from U+00C0 to U+00FF with 0xC3
            if s.islower() and s.isalpha() and len(core) - len(s) == core.count(b"\xc3"):
                plain.append(core)
        cores.update(zip(plain, self._letters(plain, True), strict=True))
        new = list({w[len(c) :] for w, c in zip(words, trimmed, strict=True) if c in cores}.difference(tails))
        tails.update(zip(new, self._each(new), strict=True))
        for w, core in zip(words, trimmed, strict=True):
            ids = cores.get(core)
            if ids is None:
                (letters if w.decode().isalpha() else others).append(w)
            else:
                known[w] = ids if len(core) == len(w) else ids + tails[w[len(core) :]]
        known.update(zip(letters, self._letters(letters, False), strict=True))
        known.update(zip(others, self._each(others), strict=True))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """texts: large strings, none null."""
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        for cache in (self.words, self.cores, self.tails):
            if len(cache) > CACHE:
                cache.clear()
        self.tails[b""] = b""
        ids = list(map(self.words.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        self.learn([words[k] for k in new])
        for k in new:
            ids[k] = self.words[words[k]]
        ids = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.append(0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False)))
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[ids.offset :][ends].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:e]) for a, e in pairwise(at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens(path: str):
    """(doc_id, text) -> (doc_id, n, ids as 16-bit bytes), END at the end."""
    end = np.array([END], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            for k in range(0, len(texts), 1024):
                ids = [x + end for x in encode(texts.slice(k, 1024))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1024), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids) -> (id, df): documents of this task that have the id."""
    df, place = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            ids = np.frombuffer(raw, dtype="<u2")
            here = np.arange(len(ids))
            place[ids] = here
            df[ids[place[ids] == here]] += 1  # each id where it stands last
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["id", "df"])


class Index:
    """BM25 over token sequences: a list of (sequence, impact) for each term."""

    def __init__(self, sequences: list[np.ndarray], idf: np.ndarray, average: float):
        sizes = np.array([len(s) for s in sequences])
        key = np.concatenate(sequences).astype(np.int64) * len(sequences) + np.repeat(np.arange(len(sequences)), sizes)
        key, tf = np.unique(key, return_counts=True)
        term, self.owner = np.divmod(key, len(sequences))
        self.impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.owner] / average))
        self.firsts = np.searchsorted(term, np.arange(len(idf) + 1))
        # each sequence's terms are its query
        order = np.argsort(self.owner.astype(np.uint16 if len(sequences) < 1 << 16 else np.int64), kind="stable")
        self.queries = np.split(term[order], np.searchsorted(self.owner[order], np.arange(1, len(sequences))))

    def shrink(self, unused: np.ndarray) -> None:
        """Leaves used sequences out of the lists; the queries stay."""
        keep = unused[self.owner]
        self.firsts = np.append(0, np.cumsum(keep))[self.firsts]
        self.owner, self.impact = self.owner[keep], self.impact[keep]

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Of each sequence by the seed's query, of used ones 0."""
        query = self.queries[seed]
        lists = [slice(a, e) for a, e in zip(self.firsts[query].tolist(), self.firsts[query + 1].tolist(), strict=True)]
        score = np.bincount(np.concatenate([self.owner[x] for x in lists]), np.concatenate([self.impact[x] for x in lists]), len(unused))
        score[~unused] = 0
        return score

    def best(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused sequences with a term of the seed's query, best first."""
        score = self.scores(seed, unused)
        at = np.flatnonzero(score)
        if len(at) > 2 * FIRST:
            least = np.partition(score[at], -FIRST)[-FIRST]
            top = at[score[at] >= least]
            yield from top[np.argsort(-score[top], kind="stable")].tolist()
            at = at[score[at] < least]
        yield from at[np.argsort(-score[at], kind="stable")].tolist()

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All of best()."""
        return np.fromiter(self.best(seed, unused), dtype=np.int64)


def pack(sequences: list[np.ndarray], idf: np.ndarray, average: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of a shard's documents."""
    pieces, number = [], 0
    at = []  # where each document's rest begins
    for d, s in enumerate(sequences):
        whole = len(s) // window
        for k in range(whole):
            pieces.append((d, k * window, window, number, 0))
            number += 1
        at.append(whole * window)
    left = np.array([len(s) - a for s, a in zip(sequences, at, strict=True)])
    unused = left > 0
    if not unused.any():
        return pieces
    index = Index([s[a:] for s, a in zip(sequences, at, strict=True)], idf, average)
    following, listed = 0, np.count_nonzero(unused)
    open_: list[tuple[int, int, int]] = []
    while True:
        while following < len(left) and not unused[following]:
            following += 1
        if following == len(left):
            break
        room, open_ = window, []

        def put(d: int) -> None:
            nonlocal room
            n = min(room, int(left[d]))
            open_.append((d, at[d], n))
            at[d] += n
            left[d] -= n
            room -= n
            unused[d] = left[d] > 0

        put(following)
        if room:
            if 4 * np.count_nonzero(unused) < 3 * listed:
                index.shrink(unused)
                listed = np.count_nonzero(unused)
            for d in index.best(following, unused):
                put(d)
                if not room:
                    break
        rest = following
        while room:  # nothing lexical left
            while rest < len(left) and not unused[rest]:
                rest += 1
            if rest == len(left):
                break
            put(rest)
        if room:
            break
        offset = 0
        for d, start, n in open_:
            pieces.append((d, start, n, number, offset))
            offset += n
        number += 1
        open_ = []
    total = sum(n for _, _, n in open_)
    queue = list(open_)
    while total:
        size = offset = 1 << (total.bit_length() - 1)
        total -= size
        offset = 0
        while offset < size:
            d, start, n = queue.pop(0)
            take = min(n, size - offset)
            pieces.append((d, start, take, number, offset))
            offset += take
            if take < n:
                queue.insert(0, (d, start + take, n - take))
        number += 1
    return pieces


def _pack(idf: np.ndarray, average: float, window: int, shard: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sequences = [np.frombuffer(ids, dtype="<u2") for _, ids in held]
            pieces = pack(sequences, idf, average, window)
            for k in range(0, len(pieces), 256):
                rows = [(held[d][0], start, n, sequences[d][start : start + n].astype("<u4").tobytes(), len(sequences[d]), number + q, offset) for d, start, n, q, offset in pieces[k : k + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            number += 1 + max(p[3] for p in pieces)
            held.clear()

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(row)
                if len(held) == shard:
                    yield from flush()
        if held:
            yield from flush()

    return run


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, start, length, ids binary,
    doc_tokens, sequence_id, offset), a row per piece. A document is its token ids by the
    tokenizer at ``path``, and id 1; null texts are empty. Pieces of a sequence lie there
    without gaps from 0, at most ``window`` ids in all; other sequences than full ones have
    a power of two. ids: the piece's, little-endian 32-bit; start: the document's ids before it.

    Every row is packed, repeated ones again, null ids as null. Other columns are ignored.
    No rows give no rows. Shards are runs of ``shard`` documents as the tasks read them, so
    one task holds one shard; document frequencies and lengths are those of all documents.
    """
    spark = docs.sparkSession
    base.tune(spark)
    tokens = base.written(base.mapped(base.lean(docs, "doc_id", "text"), _tokens(path or vocabulary()), "doc_id long, n long, ids binary"), "tokens")
    n, total = tokens.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(1 << 16)
    for r in base.mapped(tokens.select("ids"), _frequencies, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r["id"]] = r["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return base.mapped(tokens.select("doc_id", "ids"), _pack(idf, (total or 1) / max(1, n), window, shard), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
