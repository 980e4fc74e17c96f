"""Patched frame-of-reference blocks for token ids.

A segment holds the ids of some whole documents in blocks of ``BLOCK`` ids. Each block
stores its minimum and, packed at one width, the ids less that minimum. The width is
that of the value at a chosen percentile, so a few large values don't widen a block;
what doesn't fit is kept in the block's exception list. The index has every block's
start, so one block can be read alone.

Layout, little-endian: magic ``PFR1``; ids, blocks, exceptions, packed bytes (uint32);
for each block: start of its packed bytes (uint32), minimum (uint32), width (uint8),
first exception (uint32, and one more at the end); for each exception: place in its
block (uint8), value less the minimum (uint32); the packed bytes.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
MAGIC = b"PFR1"


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.uint32)
    full[:n] = ids
    if blocks:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = full - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bits(np.partition(delta, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    row, col = np.nonzero(_bits(delta) > width[:, None])
    values = delta[row, col]
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            bits = np.unpackbits(delta[own].reshape(len(own), BLOCK, 1).view(np.uint8), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            data[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    first = np.searchsorted(row, np.arange(blocks + 1)).astype("<u4")
    return b"".join(
        (
            MAGIC, struct.pack("<4I", n, blocks, len(values), len(data)), starts.astype("<u4").tobytes(), least.astype("<u4").tobytes(),
            width.tobytes(), first.tobytes(), col.astype(np.uint8).tobytes(), values.astype("<u4").tobytes(), data.tobytes(),
        )
    )


class Segment:
    """Reads a packed segment, whole or block by block."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a packed segment")
        self.n, blocks, k, size = struct.unpack_from("<4I", raw, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            if at + count * np.dtype(kind).itemsize > len(raw):
                raise ValueError("a packed segment is cut short or too long")
            out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.starts, self.least, self.width, self.first = take("<u4", blocks), take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1)
        self.place, self.values, self.data = take("u1", k), take("<u4", k), take("u1", size)
        if at != len(raw):
            raise ValueError("a packed segment is cut short or too long")

    def _rows(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), BLOCK), dtype=np.uint32)
        for w in np.unique(self.width[own]):
            if w:
                some = np.flatnonzero(self.width[own] == w)
                packed = self.data[self.starts[own[some]].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                bits = np.zeros((len(some), BLOCK, 32), dtype=np.uint8)
                bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
                out[some] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        return out

    def block(self, i: int) -> np.ndarray:
        """The ids of one block."""
        ids = self._rows(np.array([i]))[0]
        own = slice(self.first[i], self.first[i + 1])
        ids[self.place[own]] = self.values[own]
        return (ids + self.least[i])[: min(BLOCK, self.n - i * BLOCK)]

    def ids(self) -> np.ndarray:
        """All ids."""
        out = self._rows(np.arange(len(self.width)))
        out[np.repeat(np.arange(len(self.width)), np.diff(self.first.astype(np.int64))), self.place] = self.values
        return (out + self.least[:, None]).reshape(-1)[: self.n]
