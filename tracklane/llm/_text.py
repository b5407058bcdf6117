"""Vectorised helpers on Arrow text columns, used inside tasks only.

A text is a run of UTF-8 bytes. Words are maximal runs of bytes that are not
separators and never cross documents. A word's fingerprint mixes its length and
its bytes, eight at a time, through a bijection that is not linear; words longer
than `LONG` bytes take a keyed BLAKE2b digest. Windows of bytes are fingerprinted by prefix doubling: the mix
of the fingerprints of two shorter windows, which overlap where the length is no
power of two times eight.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes handled at a time: bounds the 8-byte temporaries of one step, also within one long text.
STEP = 1 << 20
LONG = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_U = np.uint64
_KEY = b"words of a corpus"
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**63, LONG // 8 + 1, dtype=np.uint64) * _U(2) + _U(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _U(0xD6E8FEB86659FD93)) ^ (b * _U(0xA0761D6478BD642F)))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches, size: int = STEP, column: str = "text"):
    """Parts of Arrow batches with about `size` bytes of text each; a longer text stands alone."""
    for batch in batches:
        _, off = buffers(batch[column])
        i, n = 0, len(batch)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = j


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of each span of bytes."""
    size = end - start
    h = mix(size.astype(np.uint64) * _ODD[0] + _ODD[1])
    lanes = _lanes(data)
    active = np.flatnonzero(size <= LONG)
    for k in range(LONG // 8):
        active = active[size[active] > 8 * k]
        if not len(active):
            break
        lane = lanes[start[active] + 8 * k] & _MASKS[np.minimum(size[active] - 8 * k, 8)]
        h[active] = mix((h[active] ^ lane) * _ODD[k + 1])
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return h


def window_hash(data: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Fingerprint of the `size` bytes from every position where they fit, by doubling windows of eight bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have = min(size, 8)
    h = mix((_lanes(data)[: len(data) - have + 1] & _MASKS[have]) ^ _U(mix(np.array([salt + 1], np.uint64))[0]))
    while have < size:
        step = min(have, size - have)
        h = combine(h[:-step], h[step:])
        have += step
    return h


def _pieces(data: np.ndarray, off: np.ndarray, separator: np.ndarray):
    """Spans of about STEP bytes that end at a text's end or behind a separator."""
    lo, total = 0, len(data)
    while lo < total:
        hi = lo + STEP
        if hi < total:
            stop = int(off[np.searchsorted(off, hi)])
            while hi < stop:
                part = separator[data[hi - 1 : min(hi - 1 + STEP, stop)]]
                k = int(part.argmax())
                if part[k]:
                    hi += k
                    break
                hi = min(hi + STEP, stop)
        hi = min(hi, total)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE, lower: bool = False):
    """(start, end, document, fingerprint) of every word, in order."""
    parts = []
    for lo, hi in _pieces(data, off, separator):
        piece = data[lo:hi]
        inner = ~separator[piece]
        i, j = np.searchsorted(off, (lo, hi))
        cuts = off[i:j] - lo  # texts that begin here
        first = np.zeros(hi - lo, bool)
        first[cuts] = True
        begins = inner.copy()
        begins[1:] &= ~inner[:-1] | first[1:]
        ends = inner.copy()
        ends[:-1] &= ~inner[1:] | first[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        h = hashed(LOWERED[piece] if lower else piece, s, e)
        d = np.searchsorted(off, s + lo, "right") - 1
        parts.append((s + lo, e + lo, d.astype(np.int32), h))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grams(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of `size` words in a row, from every word where they fit (documents may be crossed)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(salt), np.uint64)
    for k in range(size):
        out += h[k : k + n] * _U(pow(0xC2B2AE3D27D4EB4F + 2 * salt, k + 1, 1 << 64))
    return mix(out)


def starts_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Index of each document's first word, and the end, from the words' sorted documents."""
    return np.searchsorted(doc, np.arange(n + 1))
