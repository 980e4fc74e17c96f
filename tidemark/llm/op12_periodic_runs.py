"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q and length of at least
max(6, 4 * q) that no neighbouring word extends (the query's two bounds are parameters).

Positions are kept in classes of equal factors of length L. From L to L + 1 a class is split
by the classes of its members' right neighbours, and of the parts of a class that was split
all but a largest one take part in the next step, so a position takes part at most log n
times. Members of a class are linked in order of position; the gap between two neighbours
can only grow. Two neighbours at a distance of L in a class of factors of length L are a
square with a primitive root, and consecutive squares of one period merge into a run. So
periods are the smallest by themselves, and the work doesn't grow with the number of all
squares of a text that says one word over and over.

All documents of a chunk are refined at once with numpy; a position after each document
that equals no other keeps factors within their document. A run of four periods has three
members or more in each of its classes, so smaller classes are not split any further, and
no class is refined beyond the longest period that its document has room for.

Defined results: a null or blank text has no words, no runs and the digests of the empty
string; a null ``doc_id`` is no number, so its words are not replaced; repeated rows are
each judged by themselves; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textbytes import SPACE_WORDS, Chunk, chunks, words

#: Texts are refined together up to this size, since each length is a step of all of them.
TOGETHER_BYTES = 4 << 20


@dataclass
class Runs:
    """Runs by document, start and period; ``start`` counts from the document's first word."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class _Gaps:
    """(gap, position) events, taken out by gap in rising order."""

    def __init__(self) -> None:
        self.gap, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted by gap
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.greatest = 0

    def add(self, gap: np.ndarray, at: np.ndarray) -> None:
        if len(gap):
            self.new.append((gap, at))
            self.waiting += len(gap)
            self.greatest = max(self.greatest, int(gap.max()))

    def take(self, level: int) -> np.ndarray:
        """Positions of the events of this gap; those of smaller gaps are let go."""
        if self.waiting > 64 + len(self.gap) // 64:
            gap, at = (np.concatenate([old, *parts]) for old, parts in zip((self.gap, self.at), zip(*self.new, strict=True), strict=True))
            order = np.argsort(gap, kind="stable")
            self.gap, self.at, self.new, self.waiting = gap[order], at[order], [], 0
        low, high = np.searchsorted(self.gap, [level, level + 1])
        found = [self.at[low:high], *(at[gap == level] for gap, at in self.new)]
        self.gap, self.at = self.gap[high:], self.at[high:]
        return np.concatenate(found)


def _aranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _begins(x: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _ends(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[:-1])
    return out


class Partition:
    """Classes of positions with equal factors of length ``level``.

    ``members`` has each class's positions together (``first``, ``size``), ``place`` is its inverse;
    ``next`` and ``previous`` link them by position, -1 at the ends. ``room`` is the greatest length
    that a position's document needs.
    """

    def __init__(self, symbols: np.ndarray, room: np.ndarray, least_members: int) -> None:
        n = len(symbols)
        self.least, self.level, self.room, self.gaps = least_members, 1, room, _Gaps()
        self.members = np.argsort(symbols, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        begins = np.flatnonzero(_begins(symbols[self.members]))
        self.classes = len(begins)
        self.first, self.size = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        self.first[: self.classes], self.size[: self.classes] = begins, np.diff(begins, append=n)
        self.cls = np.empty(n, np.int64)
        self.cls[self.members] = np.repeat(np.arange(self.classes), self.size[: self.classes])
        self.next, self.previous = np.full(n, -1), np.full(n, -1)
        self._linked(self.members)
        self.splitters = np.arange(n)
        self.moving = np.zeros(n, bool)

    def _linked(self, positions: np.ndarray) -> None:
        """Links positions that are sorted by class and then by position."""
        a, b = positions[:-1], positions[1:]
        same = self.cls[a] == self.cls[b]
        self.next[positions] = self.previous[positions] = -1
        a, b = a[same], b[same]
        self.next[a], self.previous[b] = b, a
        self._met(a, b)

    def _met(self, a: np.ndarray, b: np.ndarray) -> None:
        gap = b - a
        use = (gap >= self.level) & (gap <= self.room[a]) & (self.size[self.cls[a]] >= self.least)
        self.gaps.add(gap[use], a[use])

    def squares(self) -> np.ndarray:
        """Sorted starts of the squares of period ``level`` with a primitive root."""
        at = self.gaps.take(self.level)
        return np.unique(at[self.next[at] - at == self.level])

    def refine(self) -> None:
        """From factors of length ``level`` to those one longer."""
        right = self.splitters[self.splitters > 0]
        left = right - 1
        own = self.cls[left]
        use = (self.size[own] >= self.least) & (self.room[left] > self.level)
        left, own, by = left[use], own[use], self.cls[right[use]]
        self.level += 1
        if not len(left):
            self.splitters = left
            return
        order = np.lexsort((left, by, own))
        left, own, by = left[order], own[order], by[order]
        new_class = _begins(own)
        new_group = new_class | _begins(by)
        group = np.cumsum(new_group) - 1
        counts = np.bincount(group)
        of = own[new_group]  # class of each group
        klass = np.cumsum(new_class) - 1
        parent = klass[new_group]  # its number among the classes met
        met = own[new_class]
        rest = self.size[met] - np.bincount(klass)
        # A class without a rest keeps its largest group in place of one.
        by_size = np.lexsort((np.arange(len(counts)), counts, parent))
        largest = by_size[np.flatnonzero(_ends(parent[by_size]))]  # one group for each class met
        stays = np.zeros(len(counts), bool)
        stays[largest[rest == 0]] = True
        moved = ~stays[group]
        split = np.bincount(parent[~stays], minlength=len(met)) > 0
        kept = np.where(rest > 0, rest, counts[largest])
        others = np.maximum.reduceat(np.where(stays, 0, counts), np.flatnonzero(_begins(parent)))
        if not split.any():
            self.splitters = left[:0]
            return
        left, group = left[moved], group[moved]
        sizes, of, parent = counts[~stays], of[~stays], parent[~stays]
        self._take_out(left)
        self._deal(left, met[split], np.bincount(parent, minlength=len(met))[split], np.bincount(parent, weights=sizes, minlength=len(met))[split].astype(np.int64))
        self.size[met[split]] = kept[split]
        names = self.classes + np.arange(len(sizes))
        self.classes += len(sizes)
        if self.classes > len(self.first) - len(self.cls):
            grow = np.zeros(len(self.first), np.int64)
            self.first, self.size = np.concatenate([self.first, grow]), np.concatenate([self.size, grow])
        self.first[names], self.size[names] = self.place[left[np.cumsum(sizes) - sizes]], sizes
        self.cls[left] = np.repeat(names, sizes)
        self._linked(left)
        self._met(*self.bridged)
        # All parts but a largest one of each class split.
        rest_is_largest = kept >= others
        skip = np.zeros(len(sizes), bool)
        best = np.lexsort((np.arange(len(sizes)), sizes, parent))
        best = best[np.flatnonzero(_ends(parent[best]))]
        skip[best[~rest_is_largest[parent[best]]]] = True
        small_rests = met[split & ~rest_is_largest]
        rests = self.members[_aranges(self.first[small_rests], self.size[small_rests])]
        self.splitters = np.concatenate([left[np.repeat(~skip, sizes)], rests])

    def _take_out(self, moved: np.ndarray) -> None:
        """Closes the links of the classes that positions leave; ``bridged`` has the new neighbours."""
        order = np.lexsort((moved, self.cls[moved]))
        out = moved[order]
        follows = self.next[out[:-1]] == out[1:]
        before = self.previous[out[np.concatenate([[True], ~follows])]]
        after = self.next[out[np.concatenate([~follows, [True]])]]
        self.next[before[before >= 0]] = after[before >= 0]
        self.previous[after[after >= 0]] = before[after >= 0]
        both = (before >= 0) & (after >= 0)
        self.bridged = before[both], after[both]

    def _deal(self, moved: np.ndarray, classes: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        """Puts positions that leave (sorted by class and group) at the end of their class's places."""
        ends = self.first[classes] + self.size[classes]
        slots = _aranges(ends - counts, counts)
        self.moving[moved] = True
        there = self.members[slots]
        pushed = there[~self.moving[there]]
        was = self.place[moved]
        free = was[was < np.repeat(ends - counts, counts)]
        self.members[free], self.place[pushed] = pushed, free
        self.members[slots], self.place[moved] = moved, slots
        self.moving[moved] = False


def find_runs(symbols: np.ndarray, first: np.ndarray, *, periods: int = 4, least: int = 6) -> Runs:
    """Runs of at least max(least, periods * q) words of documents whose word numbers are ``symbols``;
    document d has those from ``first[d]`` to ``first[d + 1]``. ``periods`` is 2 or more."""
    counts = np.diff(first)
    docs = len(counts)
    if not len(symbols):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    # One more position after each document, and classes that never cross documents.
    doc = np.repeat(np.arange(docs), counts)
    at = np.arange(len(symbols)) + doc
    n = len(symbols) + docs
    flat = np.empty(n, np.int64)
    ends = first[1:] + np.arange(docs)
    width = int(symbols.max()) + 1
    flat[at] = doc * width + symbols
    flat[ends] = docs * width + np.arange(docs)
    room = np.zeros(n, np.int64)
    room[at] = (counts // periods)[doc]
    partition = Partition(flat, room, max(2, periods - 1))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    while len(partition.splitters) or partition.level <= partition.gaps.greatest:
        squares = partition.squares()
        if len(squares):
            breaks = np.flatnonzero(np.diff(squares) != 1)
            starts = squares[np.concatenate([[0], breaks + 1])]
            lengths = squares[np.concatenate([breaks, [len(squares) - 1]])] - starts + 2 * partition.level
            long = lengths >= max(least, periods * partition.level)
            if long.any():
                found.append((starts[long], lengths[long], partition.level))
        partition.refine()
    start = np.concatenate([s for s, _, _ in found] or [np.zeros(0, np.int64)])
    length = np.concatenate([x for _, x, _ in found] or [np.zeros(0, np.int64)])
    period = np.concatenate([np.full(len(s), q) for s, _, q in found] or [np.zeros(0, np.int64)])
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    which = np.searchsorted(ends, start)
    return Runs(which, start - which - first[which], length, period)


def word_numbers(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, equal for equal words; first word of each document; starts and ends of the words)."""
    found = words(chunk, SPACE_WORDS)
    sizes = found.ends - found.starts
    data = chunk.buf[_aranges(found.starts, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    arrow = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    numbers = arrow.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    return numbers, found.first, found.starts, found.ends


def planted(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """For each word the number of the word that stands in its place: a tenth of the documents repeat a stretch."""
    source = np.arange(first[-1])
    for d, i in enumerate(ids):
        n = int(first[d + 1] - first[d])
        if i is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(i).encode()), 10)
        if not rest:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return source


def _results(ids: list[int | None], chunk: Chunk, plant: bool, periods: int, least: int) -> pa.RecordBatch:
    numbers, first, starts, ends = word_numbers(chunk)
    if plant:
        source = planted(ids, first)
        numbers, starts, ends = numbers[source], starts[source], ends[source]
    runs = find_runs(numbers, first, periods=periods, least=least)
    change = np.zeros(len(numbers) + 1, np.int64)
    at = first[runs.doc] + runs.start
    np.add.at(change, at + runs.period, 1)
    np.add.at(change, at + runs.length, -1)
    kept = np.cumsum(change[:-1]) == 0
    # The words that stay, each with a space after it, as one buffer.
    sizes = np.where(kept, ends - starts + 1, 0)
    text = chunk.buf[_aranges(starts[kept], sizes[kept])]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text[bounds[1:][kept] - 1] = 0x20
    limits = bounds[first]
    raw, cut = text.tobytes(), np.searchsorted(runs.doc, np.arange(len(ids) + 1))
    rows: list[tuple] = []
    nothing = hashlib.sha256().hexdigest()
    for d, i in enumerate(ids):
        lo, hi = int(cut[d]), int(cut[d + 1])
        low, high = int(limits[d]), int(limits[d + 1])
        collapsed = hashlib.sha256(raw[low : max(low, high - 1)]).hexdigest()
        if lo == hi:
            rows.append((i, 0, None, None, None, None, nothing, collapsed, int(first[d + 1] - first[d])))
            continue
        listed = list(zip(runs.start[lo:hi].tolist(), runs.length[lo:hi].tolist(), runs.period[lo:hi].tolist(), strict=True))
        start, length, period = max(listed, key=lambda r: (r[1], -r[0], -r[2]))
        digest = hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in listed).encode()).hexdigest()
        rows.append((i, hi - lo, start, length, period, 1000 * length // period, digest, collapsed, int(first[d + 1] - first[d])))
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_ARROW = [pa.string() if part.endswith("string") else pa.int64() for part in SCHEMA.split(", ")]


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = True, periods: int = 4, least: int = 6) -> DataFrame:
    """One row for each document: its longest run (ties: smallest start, then period), digests of all runs and of the kept words.

    ``plant`` replaces words of a tenth of the documents as the query's contract says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), TOGETHER_BYTES):
                yield _results(ids[chunk.first : chunk.first + chunk.rows], chunk, plant, periods, least)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, SCHEMA)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", periods: int = 4, least: int = 6) -> DataFrame:
    """doc_id and every run's start, length and period (in words), and its root (the first period's words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), TOGETHER_BYTES):
                numbers, first, starts, ends = word_numbers(chunk)
                runs = find_runs(numbers, first, periods=periods, least=least)
                at = first[runs.doc] + runs.start
                roots = [b" ".join(chunk.buf[s:e].tobytes() for s, e in zip(starts[a : a + q], ends[a : a + q], strict=True)).decode() for a, q in zip(at, runs.period, strict=True)]
                own = [ids[chunk.first + d] for d in runs.doc.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(runs.start), pa.array(runs.length), pa.array(runs.period), pa.array(roots, pa.string())],
                    names=["doc_id", "start", "length", "period", "root"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, start long, length long, period long, root string")


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", periods: int = 4, least: int = 6) -> DataFrame:
    """The documents with each run cut to its first period; texts without runs stay as they are, others are joined by single spaces."""
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = batch.column(fields.index(text_col)).to_pylist()
            for chunk in chunks(batch.column(fields.index(text_col)), TOGETHER_BYTES):
                numbers, first, starts, ends = word_numbers(chunk)
                runs = find_runs(numbers, first, periods=periods, least=least)
                gone = np.zeros(len(numbers) + 1, np.int64)
                at = first[runs.doc] + runs.start
                np.add.at(gone, at + runs.period, 1)
                np.add.at(gone, at + runs.length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                for d in np.unique(runs.doc).tolist():
                    own = np.flatnonzero(kept[first[d] : first[d + 1]]) + first[d]
                    texts[chunk.first + d] = b" ".join(chunk.buf[starts[w] : ends[w]].tobytes() for w in own).decode()
            columns = [pa.array(texts, f.type) if f.name == text_col else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))
