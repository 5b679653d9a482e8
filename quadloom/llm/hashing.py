"""Vectorised hashes of words and of word windows; used inside Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: dict[int, np.ndarray] = {}

#: ASCII white space splits words; everything else, bytes above 127 included, belongs to them.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 4096) * 2, base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _segments(raw: np.ndarray, rows: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of raw; a word also ends where a row starts."""
    space = SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    start[rows] = ~space[rows]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.diff(starts, append=len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    values = raw[starts[0] :].astype(np.uint64) + np.uint64(1)
    values *= powers(_BASES[family], int(lengths.max()))[place]
    values[space[starts[0] :]] = 0
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def word_hashes(raw: np.ndarray, family: int = 0, piece: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the words of one text (UTF-8 bytes), read in pieces cut at white space."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + piece, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[at:end]])
            while not len(gaps) and end < len(raw):
                end = min(end + piece, len(raw))
                gaps = np.flatnonzero(SPACE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) and end < len(raw) else end
        out.append(_segments(raw[at:end], np.zeros(1, np.int64), family)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed_rows(column: pa.Array, lower: bool = False, family: int = 0, piece: int = 1 << 18) -> Iterator[np.ndarray]:
    """The word hashes of each text of an Arrow column, in order; none for null. Many short texts are hashed at once."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece, "right")) - 1)
        raw = data[offsets[row] : offsets[last]]
        raw = LOWER[raw] if lower else raw
        if last == row + 1:
            yield word_hashes(raw, family, piece)
        else:
            edges = offsets[row : last + 1] - offsets[row]
            starts, hashes = _segments(raw, edges[:-1][np.diff(edges) > 0], family)
            cuts = np.searchsorted(starts, edges)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield hashes[a:b]
        row = last


def prefix_sums(hashes: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Karp-Rabin prefix sums: entry i covers the first i words."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=out[1:])
    return out


_INVERSE = pow(_BASES[0], -1, 1 << 64)


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hash of the words [start, end) of each span, equal for equal word sequences."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every window of `width` words."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:-width]) * powers(_INVERSE, n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
