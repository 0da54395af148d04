"""Word and shingle hashes of whole Arrow text columns in numpy: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_output import span_hashes, text_slices

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array):
    """Slices of a column in lower case: first row, word hashes, and each row's bounds in them.

    A word is a run of ASCII letters, digits, underscores and characters beyond ASCII.
    """
    column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    for row, data, bounds in text_slices(column):
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = _WORD[data]
        # Texts lie side by side: a word must not run from one into the next.
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        inner = bounds[1:-1]
        if len(inner) and len(starts):
            at = np.searchsorted(starts, inner, "right") - 1
            cut = np.unique(inner[(at >= 0) & (starts[at] < inner) & (ends[at] > inner)])
            if len(cut):
                starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        hashes = mix64(span_hashes(data, starts, ends)[0]) if len(starts) else np.zeros(0, np.uint64)
        yield row, hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int):
    """Hashes of all runs of `size` words, and each row's bounds in them.

    A row of fewer words, but at least one, has a single shingle of all its words.
    """
    n = np.diff(bounds)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], many)
    end = np.repeat(bounds[1:], many)
    out = np.full(len(start), 0x51ED270B, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        at = start + k
        out = mix64(out * np.uint64(3) + np.where(at < end, padded[at], np.uint64(k + 1)))
    return out, out_bounds
