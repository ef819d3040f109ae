"""SimHash fingerprints: bit counts over hashed features, and links within a Hamming radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The lowest bit of each byte: a word masked with it is eight 8-bit counters.
_LOWEST = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit word per row: a bit is 1 if it is set in over half the row's hashes.

    first: index of each row's first hash, with the total appended. A row without hashes gives 0.
    """
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # 8-bit counters hold 255, so rows are counted in pieces of that size.
    pieces = (n[full] + 254) // 255
    of_row = np.concatenate([[0], np.cumsum(pieces)])
    step = np.arange(of_row[-1]) - np.repeat(of_row[:-1], pieces)
    at = np.repeat(first[:-1][full], pieces) + 255 * step
    bits = np.empty((len(full), 64), bool)
    # A row in one piece is judged by its counters as they are.
    one, more = np.flatnonzero(pieces == 1), np.flatnonzero(pieces > 1)
    half = (n[full][one] // 2).astype(np.uint8)[:, None]
    of_more = np.repeat(pieces > 1, pieces)
    start = np.cumsum(pieces[more]) - pieces[more]
    for bit in range(8):
        # Counters of this bit of each of the eight bytes.
        counts = np.add.reduceat((h >> np.uint64(bit)) & _LOWEST, at).view(np.uint8).reshape(-1, 8)
        bits[one, bit::8] = counts[of_row[:-1][one]] > half
        if len(more):
            bits[more, bit::8] = 2 * np.add.reduceat(counts[of_more].astype(np.int64), start, axis=0) > n[full][more][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def forest(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code the index of the first code that is reachable by steps of at most `radius` bits."""
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    label = np.arange(len(codes))
    while True:
        lower = np.where(near, label[None, :], len(codes)).min(axis=1)
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the length appended."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def by_group(batches, key: str):
    """Record batches sorted by `key`, cut so that each holds its keys whole."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
