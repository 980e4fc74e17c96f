"""Token ids of whole texts, by the ``tokenizers`` library.

The library's time goes into its normaliser and merges, and running text repeats its
words. So a text is split where the tokenizer can't join across (white space, and
between ASCII letters, digits and punctuation), each distinct piece is encoded once by
the library, and a text's ids are put together from its pieces with numpy. Apostrophes,
control characters and everything outside ASCII stay with their neighbours, because
contractions, combining marks and other symbols can join there.

Texts that hold one of the tokenizer's special strings are encoded by the library whole.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

import numpy as np

from .textbytes import LOWER, Chunk, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Text that is encoded at a time; the arrays of one step take some hundred times as much memory.
ENCODE_BYTES = 1 << 18

_SPACE, _LETTER, _DIGIT, _PUNCT, _JOINS = range(5)
_CLASS = np.full(256, _JOINS, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[range(0x30, 0x3A)] = _DIGIT
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = _PUNCT

#: How byte-level tokenizers write each byte; those without a character of their own come after 255.
_BYTE_LEVEL = [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else "" for b in range(256)]
_BYTE_LEVEL = [c or chr(256 + _BYTE_LEVEL[:b].count("")) for b, c in enumerate(_BYTE_LEVEL)]


def byte_level(piece: str) -> str:
    return piece if piece.isascii() else "".join([_BYTE_LEVEL[b] for b in piece.encode()])


def default_path() -> str:
    """The public vocabulary file that the operators use unless told otherwise."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Rows:
    """Rows of numbers of any length, one after the other in one array that grows."""

    def __init__(self, kind: type) -> None:
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.start, self.count, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        k, n = self.rows, len(counts)
        while k + n > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[k : k + n], self.count[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        self.rows += n


class PieceEncoder:
    """Encodes chunks of texts; keeps some distinct pieces and starts anew once there are more than ``most``.

    Pieces are looked up by a hash and then compared byte by byte, so a piece that shares the hash of
    another gets its own ids. What is kept stays at a few tens of megabytes for each worker.
    """

    def __init__(self, path: str, most: int = 1 << 19, most_bytes: int = 16 << 20, hasher: Callable[..., np.ndarray] = word_hashes) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._zero = self.whole("0")
        # A tokenizer whose normaliser lower-cases takes "The" and "the" for one piece.
        self._lowers = bool((self.whole("AZ") == self.whole("az")).all())
        self._plain = re.compile("[a-zß-öø-ÿ]{1,100}" if self._lowers and (self.whole("é") == self._raw("é")).all() else "(?!)")
        self._most, self._most_bytes, self._hasher = most, most_bytes, hasher
        self._clear()

    def _clear(self) -> None:
        self._slots = 1 << (2 * self._most - 1).bit_length()
        self._keys, self._entry = np.zeros(self._slots, np.uint64), np.zeros(self._slots, np.int32)  # open addressing
        self._ids, self._pieces = _Rows(np.uint32), _Rows(np.uint8)  # each entry's ids and bytes

    def _raw(self, piece: str) -> np.ndarray:
        """Ids of one run of letters, without the normaliser and the splitter."""
        return np.array([t.id for t in self._model.tokenize(byte_level(piece))], np.uint32)

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and which of the keys have none."""
        slot = (keys & np.uint64(self._slots - 1)).astype(np.int64)
        entry, unknown = self._entry[slot], np.zeros(len(keys), dtype=bool)
        left = np.flatnonzero(self._keys[slot] != keys)
        while len(left):
            empty = self._keys[slot[left]] == 0
            unknown[left[empty]] = True
            left = left[~empty]
            slot[left] = (slot[left] + 1) & (self._slots - 1)
            hit = self._keys[slot[left]] == keys[left]
            entry[left[hit]] = self._entry[slot[left[hit]]]
            left = left[~hit]
        return entry, unknown

    def _differ(self, entry: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces (their numbers) whose bytes are not their entry's: another piece has their hash."""
        size = ends - starts
        wrong = self._pieces.count[entry] != size
        same = np.flatnonzero(~wrong)
        size = size[same]
        before = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        unlike = self._pieces.flat[np.repeat(self._pieces.start[entry[same]] - before, size) + step] != buf[np.repeat(starts[same] - before, size) + step]
        wrong[np.repeat(same, size)[unlike]] = True
        return np.flatnonzero(wrong)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        while 2 * (len(keys) + np.count_nonzero(self._keys)) > self._slots:  # one chunk with more pieces than usual
            old = np.flatnonzero(self._keys)
            known, entries, self._slots = self._keys[old], self._entry[old], 2 * self._slots
            self._keys, self._entry = np.zeros(self._slots, np.uint64), np.zeros(self._slots, np.int32)
            self._insert(known, entries)
        slot = (keys & np.uint64(self._slots - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] == 0]
            self._keys[slot[free]] = keys[free]  # of several keys for one slot the last stays
            self._entry[slot[free]] = numbers[free]
            left = left[self._keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (self._slots - 1)

    def _learn(self, raw: list[bytes]) -> np.ndarray:
        """New entries for some pieces, in order."""
        pieces = [x.decode("utf-8", "replace") for x in raw]
        ids: list = [None] * len(pieces)
        joined = []
        for i, piece in enumerate(pieces):
            if self._plain.fullmatch(piece):  # nothing to normalise or to split: straight to the merges
                ids[i] = [t.id for t in self._model.tokenize(byte_level(piece))]
            elif "0" in piece or len(piece) > 200:
                ids[i] = self.whole(piece)
            else:
                joined.append(i)
        for at in range(0, len(joined), 256):
            part = joined[at : at + 256]
            found = self.whole(" 0 ".join(pieces[i] for i in part))
            ends = np.flatnonzero(found == self._zero[0]) if len(self._zero) == 1 else []
            if len(ends) != len(part) - 1:
                for i in part:
                    ids[i] = self.whole(pieces[i])
                continue
            for i, a, b in zip(part, [0, *(ends + 1)], [*ends, len(found)], strict=True):
                ids[i] = found[a:b]
        first = self._ids.rows
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self._ids.add(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)
        self._pieces.add(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
        return np.arange(first, self._ids.rows, dtype=np.int32)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents, and where each document starts (and the end)."""
        if self._ids.rows > self._most or max(self._pieces.used, 4 * self._ids.used) > self._most_bytes:
            self._clear()
        buf = LOWER[chunk.buf] if self._lowers else chunk.buf
        kind = _CLASS[buf]
        kind[chunk.offsets[1:] - 1] = _SPACE
        a, b = kind[:-1], kind[1:]
        inside = (a != _SPACE) & (b != _SPACE)
        cut = inside & (a != _JOINS) & (b != _JOINS) & ((a != b) | (a == _DIGIT))
        starts = np.flatnonzero(cut | ((a == _SPACE) & (b != _SPACE))) + 1
        if kind[0] != _SPACE:
            starts = np.concatenate([[0], starts])
        ends = np.flatnonzero(cut | ((a != _SPACE) & (b == _SPACE))) + 1
        keys = self._hasher(buf, starts, ends) | np.uint64(1)  # never 0, which marks a free slot
        piece = lambda i: buf[starts[i] : ends[i]].tobytes()
        entry, unknown = self._look_up(keys)
        if unknown.any():
            new, where = np.unique(keys[unknown], return_index=True)
            self._insert(new, self._learn([piece(i) for i in np.flatnonzero(unknown)[where].tolist()]))
            entry[unknown] = self._look_up(keys[unknown])[0]
        if len(wrong := self._differ(entry, buf, starts, ends)):
            own = {x: k for k, x in enumerate(dict.fromkeys(piece(i) for i in wrong.tolist()))}
            entry[wrong] = self._learn(list(own))[[own[piece(i)] for i in wrong.tolist()]]
        counts = self._ids.count[entry].astype(np.int64)
        place = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=place[1:])
        ids = self._ids.flat[np.repeat(self._ids.start[entry] - place[:-1], counts) + np.arange(place[-1])]
        bounds = place[np.searchsorted(starts, chunk.offsets)]
        raw = chunk.buf.tobytes()
        if any(s in raw for s in self._special):
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in range(chunk.rows):
                text = chunk.text(i)
                if any(s in text for s in self._special):
                    parts[i] = self.whole(text.decode("utf-8", "replace"))
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, so that tasks share its pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
