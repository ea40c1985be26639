"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes of words: all but ASCII white space; letters, digits and all beyond ASCII
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    step = np.uint64(base)
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        k = min(done, n - done)
        out[done : done + k] = out[:k] * step
        step = step * step
        done += k
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        with np.errstate(over="ignore"):
            _cache["p"], _cache["i"] = _powers(BASE, size), _powers(BASE_INV, size)
    return _cache["p"][:n], _cache["i"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(keys: np.ndarray) -> np.ndarray:
    """c with c[i] the polynomial sum of keys[:i]; (c[b] - c[a]) * inverse[a] is the hash of keys[a:b]."""
    p, _ = powers(len(keys) + 1)
    c = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(keys * p[:-1], out=c[1:])
    return c


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """`sums` of bytes."""
    return sums(BYTE_KEY[data])


def span_hash(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of data[a:b] for arrays of a and b; the length is mixed in."""
    _, inv = powers(len(c))
    return mixed((c[b] - c[a]) * inv[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of at most `size` bytes, or of one longer text. Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        to = min(to, len(col), at + 4096)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_counts(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The number of words of each text of a slice, without their hashes."""
    is_word = kind[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    begins[inner] = is_word[inner]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offs[1:]] - total[offs[:-1]]


class Words:
    """Words of a slice, in order: start and end offsets, hash, document (row in the slice); `first` has where a document's words begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> None:
        data = _LOWER[data]
        n = len(data)
        is_word = kind[data]
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
        cut = np.zeros(n + 1, dtype=bool)
        cut[inner] = True
        begins, ends = is_word.copy(), is_word.copy()
        if n:
            begins[1:] &= ~is_word[:-1] | cut[1:n]
            ends[:-1] &= ~is_word[1:] | cut[1:n]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = span_hash(prefix_sums(data), self.start, self.end) | np.uint64(1)
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; places too near the end are left out."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k]
    return mixed(out)
