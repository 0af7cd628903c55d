"""Vectorised word scanning over Arrow string batches.

A batch of texts is turned into one byte buffer with a newline after every document, so that words never
run across documents; words, word hashes and window hashes of all documents then come from a few numpy
passes. Texts are always whole; batches are only cut between documents to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a longer single document is handled alone, and hashed in parts.
CHUNK_BYTES = 1 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WINDOW_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def inverse(odd: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(odd), -1, 1 << 64))


def whitespace_table() -> np.ndarray:
    """True for the bytes that separate words: space and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = np.uint64(base)
    while done < n:
        take = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + take] = out[:take] * step
            step = step * step
        done += take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that all bits of a polynomial hash depend on all of its input."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or a single document."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + limit, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


class Text:
    """The documents of a slice as one buffer.

    ``data``: bytes, each document followed by a newline. ``offsets``: where documents start (one more
    than documents). ``starts``, ``ends``: where words start and end. ``first``: for each document its
    first word's number (one more than documents).
    """

    def __init__(self, column: pa.Array, separators: np.ndarray | None = None):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        _, offs, body = column.buffers()
        raw = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(body, np.uint8)[raw[0] : raw[-1]] if body is not None and n else np.zeros(0, np.uint8)
        raw = raw - raw[0]
        self.n = n
        self.offsets = raw + np.arange(n + 1)
        self.data = np.full(len(data) + n, 10, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.offsets[1:] - 1] = False
        self.data[inside] = data
        self.split(whitespace_table() if separators is None else separators)

    def split(self, separators: np.ndarray) -> None:
        word = np.zeros(len(self.data) + 2, np.int8)
        word[1:-1] = ~separators[self.data]
        edge = np.diff(word)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)

    def document(self) -> np.ndarray:
        """For each word the number of its document."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def word_hashes(self, data: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``longest`` ones."""
        data = self.data if data is None else data
        return range_hashes(data, self.starts, self.ends if longest is None else np.minimum(self.ends, self.starts + longest))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, which ascend and do not overlap, by blocks of ``limit`` bytes.

    What a range hashes to depends on its bytes alone; one longer than a block is summed in parts."""
    out = np.zeros(len(starts), np.uint64)
    block = min(limit, len(data))
    up, down = powers(MULTIPLIER, block), powers(inverse(MULTIPLIER), block)
    sums = np.zeros(block + 1, np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = int(starts[lo])
            hi = int(np.searchsorted(ends, base + block, "right"))
            if hi > lo:
                n = int(ends[hi - 1]) - base
                np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1 : n + 1])
                out[lo:hi] = (sums[ends[lo:hi] - base] - sums[starts[lo:hi] - base]) * down[np.minimum(starts[lo:hi] - base, block - 1)]
                lo = hi
                continue
            total, shift = np.uint64(0), np.uint64(1)
            for at in range(base, int(ends[lo]), block):
                part = data[at : min(at + block, int(ends[lo]))].astype(np.uint64) + np.uint64(1)
                total += (part * up[: len(part)]).sum(dtype=np.uint64) * shift
                shift *= up[-1] * MULTIPLIER
            out[lo] = total
            lo += 1
    return mix(out)


def window_hashes(words: np.ndarray, k: int, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Hashes of all windows of k consecutive words, over document borders too (callers leave those out), by blocks
    of ``limit`` windows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    block = min(limit, n)
    up, down = powers(WINDOW_MULTIPLIER, block + k - 1), powers(inverse(WINDOW_MULTIPLIER), block)
    sums = np.zeros(block + k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, n, block):
            m = min(block, n - i)
            np.cumsum(words[i : i + m + k - 1] * up[: m + k - 1], out=sums[1 : m + k])
            out[i : i + m] = mix((sums[k : m + k] - sums[:m]) * down[:m])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if width <= 1:
        return x
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
