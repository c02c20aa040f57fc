"""Array views of Arrow text columns for the operators that work on batches inside tasks.

A batch of texts is one byte array with offsets; words, word hashes and shingles are computed for the whole
batch at once, so the cost of Python does not grow with the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd 64-bit multipliers for polynomial hashes, and the constants of the splitmix64 finaliser.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Texts are handled in pieces of about so many bytes; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``most`` bytes (PIECE_BYTES if not given), with the bytes and offsets of their texts."""
    for batch in batches:
        raw, off = flat(batch.column(batch.schema.names.index(text)))
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (most or PIECE_BYTES), "right")) - 1)
            yield batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


class Words:
    """The words of a piece: ``data`` holds their bytes end to end, ``off`` their offsets, ``per_doc`` how many each text has."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        keep = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        start = keep & (first[:-1] | np.r_[True, ~keep[:-1]][: len(keep)])
        at = np.flatnonzero(start)
        before = np.r_[0, np.cumsum(keep, dtype=np.int64)]
        self.data = raw[keep]
        self.off = np.r_[before[at], len(self.data)].astype(np.int64)
        self.doc_off = np.searchsorted(at, off)  # the first word of each text
        self.per_doc = np.diff(self.doc_off)

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.off)

    def arrow(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.off), pa.py_buffer(np.ascontiguousarray(self.data))])

    def doc(self) -> np.ndarray:
        """The number of the text that each word is from."""
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.lengths
        place = np.arange(len(self.data)) - np.repeat(self.off[:-1], lengths)
        terms = mix(self.data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, self.off[:-1]))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(hashes: np.ndarray, size: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """A hash for each ``size`` consecutive words; there are size - 1 fewer than words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(base, size)):
        out += hashes[j : j + n] * p
    return mix(out)
