"""Arrow batches as byte arrays, word and line bounds, and vectorised hashes.

A batch of texts is cut into chunks of at most ``CHUNK`` bytes (one text may be
longer and is then a chunk of its own), so working memory follows the chunk and
not the batch. All hashes are 64 bit with wrap-around arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def chunks(texts: pa.Array, limit: int = CHUNK):
    """Yield (first row, end row, bytes, offsets) for consecutive rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    col = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = {"n": 0}


def powers(n: int):
    """Powers of ROOT and of its inverse modulo 2**64, up to n."""
    if "up" not in _powers or _powers["n"] < n:
        size = max(n, CHUNK) + 1
        inverse = np.uint64(pow(int(ROOT), -1, 2**64))
        for name, base in (("up", ROOT), ("down", inverse)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
        _powers["n"] = size - 1
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray):
    """Function (starts, ends) -> hash of each byte span, independent of its place."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])

    def of(starts, ends):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return of


def word_bounds(data: np.ndarray, off: np.ndarray):
    """Starts, ends and row of every maximal run of bytes other than blanks; runs end with their row."""
    blank = SPACE[data]
    edges = off[(off > 0) & (off < len(data))]
    first, last = ~blank, ~blank
    opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
    opens[1:] = blank[:-1]
    closes[:-1] = blank[1:]
    opens[edges] = True
    closes[edges - 1] = True
    starts, ends = np.flatnonzero(first & opens), np.flatnonzero(last & closes) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def line_bounds(data: np.ndarray, off: np.ndarray):
    """Starts, ends and row of the newline-separated lines of every non-empty row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(off[:-1][off[1:] > off[:-1]], breaks + 1)
    starts = starts[starts < len(data)]
    row = np.searchsorted(off, starts, "right") - 1
    # A line ends at the next break, or with its row.
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts, "left")]
    stop = np.minimum(next_break, off[row + 1])
    return starts, stop, row


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of per-byte values over each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
