"""Words of whole text columns as NumPy arrays, a bounded number of bytes at a time.

A text is read as UTF-8 bytes. Both word classes in use are classes of single bytes, so word borders
are found on the byte buffer of an Arrow column without making a Python string per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; one text that is longer is worked on alone.
CHUNK_BYTES = 2 << 20

BYTES = np.arange(256)
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 0x20, BYTES).astype(np.uint8)
#: [^\x20\x09-\x0D]+
NOT_SPACE = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = (
    ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
)

_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 20


@dataclass
class Words:
    """Words of some rows. buf: the (lower-cased) bytes; start, end: of each word in buf;
    first: index of each row's first word, with the total appended; offsets: of each row in buf, with
    its length appended; row: of the first row."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    row: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def last_of(self) -> np.ndarray:
        """For each word the index after its row's last word."""
        return np.repeat(self.first[1:], self.counts)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(texts: pa.Array, table: np.ndarray, lower: bool) -> Iterator[Words]:
    for row, buf, offsets in text_chunks(texts):
        if lower:
            buf = LOWER[buf]
        inside = table[buf]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(buf):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[offsets[:-1][offsets[:-1] < len(buf)]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Words(buf, start, end, np.searchsorted(start, offsets), offsets, row)


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words (of `keep`, or all) joined by one space, with the start and end of each."""
    at, to = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    length = to - at
    end = np.cumsum(length + 1) - 1
    start = end - length
    owner = np.repeat(np.arange(len(length)), length)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    out[start[owner] + step] = w.buf[at[owner] + step]
    return out.tobytes(), start, end


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial modulo 2^64, mixed."""
    out = np.empty(len(w.start), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(w.end, w.start[at] + _STEP, "right")))
        low, high = int(w.start[at]), int(w.end[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        powers = _powers(_BASE, high - low + 1)
        np.cumsum((w.buf[low:high].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
        s, e = w.start[at:to] - low, w.end[at:to] - low
        back = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), high - low + 1)
        out[at:to] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)
        at = to
    return mixed(out + np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on. Only the caller knows where a row ends: entry i
    means something if words i to i + k - 1 are of one row. Shorter by k - 1 than h."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    power, width, block = _GRAM, 1, h
    need = k
    # Binary expansion of k: blocks of 1, 2, 4, ... words are joined as needed.
    while need:
        if need & 1:
            part = block[have : have + len(h) - k + 1]
            if out is None:
                out = part.copy()
            else:
                out = out * power + part
            have += width
        need >>= 1
        if need:
            block = block[:-width] * power + block[width:]
            with np.errstate(over="ignore"):
                power, width = power * power, width * 2
    return mixed(out + np.uint64(k))


def least(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of g[i], ..., g[i + w - 1], the last of equals; shorter by w - 1."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int8 if w < 128 else np.int32)
    for j in range(1, w):
        better = g[j : j + n] <= best
        np.copyto(best, g[j : j + n], where=better)
        at[better] = j
    return at + np.arange(n)
