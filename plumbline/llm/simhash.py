"""SimHash of many groups of 64-bit hashes at once."""

from __future__ import annotations

import numpy as np

#: For each byte its eight bits, spread over the eight bytes of a word.
SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)
#: Rows that byte counters can add up.
ROWS = 255
HASHES_AT_ONCE = 1 << 20


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each group; groups begin at ``starts``, none is empty.

    A hash becomes eight words of byte counters, so that a group is added up eight bits at a time, up to
    ``ROWS`` hashes before the counters are widened.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // ROWS)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(starts, pieces) + ROWS * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    counts = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int32)
    return counts if len(begin) == len(starts) else np.add.reduceat(counts, first, axis=0)


def simhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group the bits that are set in more than half of its hashes."""
    sizes = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * bit_counts(hashes, starts) > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
