"""Vectorised word handling over the UTF-8 bytes of an Arrow text column.

The operators of this subpackage that look at every word of every document work
on the raw Arrow buffers with numpy instead of on Python strings: a batch of texts
becomes one byte array in which each document is followed by one separator, words
are runs of "word bytes", and a word's 64-bit hash comes from prefix sums.

Nothing here holds more than one chunk (about ``CHUNK_BYTES`` of text, or one
longer document) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
#: Of chunks that decide something by themselves (shards of a suffix array, rows settled before a shuffle).
SHARD_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_CODES = {0: _byte_codes(20240101), 1: _byte_codes(20240202)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or have.size < n:
        grown = np.full(max(n, SHARD_BYTES + (1 << 17)), base, dtype=np.uint64)
        grown[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: Iterator[int] | set[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_table({0x20, *range(0x09, 0x0E)})
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_WORDS = byte_table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Lower-cases A-Z byte by byte (other bytes of UTF-8 are never in that range).
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Chunk:
    """Some consecutive rows of a batch: ``first`` is the first row's index in the batch."""

    first: int
    buf: np.ndarray  # bytes, a separator after each document
    offsets: np.ndarray  # start of each document in buf, and the end

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1] - 1].tobytes()


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a text column into chunks of whole documents; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        own = offsets[at : to + 1] - offsets[at]
        buf = np.insert(raw[offsets[at] : offsets[to]], own[1:], np.uint8(0x20))
        yield Chunk(at, buf, own + np.arange(to - at + 1))
        at = to


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of each document, and the number of words


def words(chunk: Chunk, table: np.ndarray) -> Words:
    mask = table[chunk.buf]
    mask[chunk.offsets[1:] - 1] = False
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Unsigned 64-bit hash of each span of bytes; equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODES[family][buf] * _powers("up", _R, n), out=total[1:])
    return mix64((total[ends] - total[starts]) * _powers("down", _R_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def exact_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 for each span of bytes, equal for equal bytes only."""
    if not len(starts):
        return np.zeros(0, np.int64)
    sizes = ends - starts
    to = np.cumsum(sizes)
    data = buf[np.arange(to[-1]) + np.repeat(starts - (to - sizes), sizes)]
    offsets = np.concatenate([[0], to]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return spans.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (shorter by k - 1 than the input)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : j + n]
    return mix64(out)


def runs_within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over starts 0..n-1 (n = words - k + 1) of the runs that stay in one document."""
    ok = np.ones(max(n, 0), dtype=bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def sliding(op, x: np.ndarray, k: int) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each window of ``k`` values."""
    width, out = 1, x
    while width * 2 <= k:
        out = op(out[: len(out) - width], out[width:])
        width *= 2
    rest = k - width
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def per_document(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each document's words the mask holds."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
