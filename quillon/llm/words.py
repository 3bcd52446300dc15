"""Words of whole texts as flat numpy arrays, and 64-bit content hashes of them.

A text is UTF-8 bytes; words are the maximal runs of bytes that are not one of
space, \\t, \\n, \\v, \\f, \\r.  All of them are ASCII, so this equals matching
``[^\\x20\\x09-\\x0D]+`` on code points.  Hashes depend on content alone, so every
task of every run gives a word the same name without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Bytes of text that are turned into arrays at once (a single longer text is one chunk).
CHUNK = 1 << 20


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U64)


_BYTE = _splitmix(7, 256)
_STEP = _splitmix(11, 64) | U64(1)
_BASE_BYTE, _BASE_WORD = int(_splitmix(13, 1)[0]) | 1, int(_splitmix(17, 1)[0]) | 1
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit (a bijection on 64 bits)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        size = max(n, 1 << 16)
        pair = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = (pair[0], pair[1])
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE_WORD) -> np.ndarray:
    """Hash of each values[start:end], from one prefix sum; order matters, place doesn't."""
    power, inverse = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


class Chunk:
    """Some whole texts: word hashes in order, and where each text's words lie.

    starts/ends: byte places of the words in ``data``; bounds: text i has the words
    bounds[i] to bounds[i + 1].
    """

    def __init__(self, rows: np.ndarray, texts: list[bytes], lower: bool):
        self.rows = rows
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = _LOWER[raw]
        gap = _SEP[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        self.bounds = np.searchsorted(self.starts, firsts)
        self.hashes = mix(rolling(_BYTE[raw], self.starts, self.ends, _BASE_BYTE))


def chunks(rows: Iterable[int], texts: Iterable[bytes | None], lower: bool = False) -> Iterator[Chunk]:
    """Chunks of about CHUNK bytes; a null text is like an empty one."""
    held: list[bytes] = []
    at: list[int] = []
    size = 0
    for row, text in zip(rows, texts, strict=True):
        text = text or b""
        if held and size + len(text) > CHUNK:
            yield Chunk(np.array(at), held, lower)
            held, at, size = [], [], 0
        held.append(text)
        at.append(row)
        size += len(text) + 1
    if held:
        yield Chunk(np.array(at), held, lower)


def column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column's UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary()).to_pylist()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; shorter texts are one shingle, empty ones none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=U64)
    k = min(width, n)
    total = np.zeros(n - k + 1, dtype=U64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _STEP[j]
    return mix(total + U64(k))
