"""Benchmark decontamination (operator 4): training suffix arrays.

Each chunk of the training documents is a shard with its own suffix array over words: all its
suffixes in order, by prefix doubling. Every suffix of every benchmark item is looked up in every
shard by binary search, word after word and all suffixes side by side; the range that is left
has all places where its words stand. So each document gets its longest verbatim match, however
short, and from a window on each place is followed to the match's end, which gives all locations.
Documents with a hit word are contaminated and removed in the pipeline.

The benchmark is taken in blocks of at most ``block_bytes`` of text. There is one pass over the
documents for each block, and what a pass has found is written for the next, so driver and
executors hold one block at a time (some 30 times its text, as words), however large the
benchmark is. Words are numbered by their bytes, never by a hash alone, so what is equal in
numbers is equal in words. Windows with one range of the array are handled once, however
often items say them and documents have them.

Null text has no words: such documents are not contaminated and such items never occur.
Items with fewer words than a window are one window of their own length. Equal windows
of several items (ties) count for each item. Items with one id are one item, also where they
stand in several rows; without an id their id is the empty text. Repeated documents are judged
each on its own, and empty tables give no hits. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .textbytes import ALNUM_WORDS, LOWER, SHARD_BYTES, Chunk, chunks, exact_numbers, per_document, word_hashes, words

WINDOW = 10


@dataclass
class Items:
    """A block of the benchmark: its words in a row, each a suffix's start."""

    names: list[bytes]  # the different words
    hashes: np.ndarray  # of the different words
    number: np.ndarray  # of all words of all items, which of the different words it is
    item: np.ndarray  # the item of each word
    first: np.ndarray  # first word of each item, and the end
    ids: list[str]

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Items:
        known: dict[bytes, int] = {}
        number: list[int] = []
        first = [0]
        for chunk in chunks(pa.array(texts, pa.large_string())):
            buf = LOWER[chunk.buf]
            w = words(Chunk(0, buf, chunk.offsets), ALNUM_WORDS)
            number += [known.setdefault(buf[s:e].tobytes(), len(known)) for s, e in zip(w.starts, w.ends, strict=True)]
            first += (w.first[1:] + first[-1] - w.first[0]).tolist()
        names = list(known)
        joined = np.frombuffer(b" ".join(names) + b" ", dtype=np.uint8)
        lengths = np.array([len(x) for x in names], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        named = ["" if i is None else str(i) for i in ids]
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        return Items(names, word_hashes(joined, starts, starts + lengths), np.array(number, np.int64), item, np.array(first), named)


class Shard:
    """The suffix array of a chunk's words, given by number: every suffix, to the end of its document, in order."""

    def __init__(self, number: np.ndarray, first: np.ndarray) -> None:
        n = len(number)
        self.words = number + 1  # 0 stands for the end of a document
        self.end = np.repeat(first[1:], np.diff(first))
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(number))])
        rank, open_, k = self.words, np.arange(n), 1
        self.array = np.arange(n)
        slots = np.arange(n)
        while len(open_):
            after = np.where(open_ + k < self.end[open_], rank[np.minimum(open_ + k, n - 1)], 0)
            order = np.argsort(rank[open_] * (n + 2) + after, kind="stable")
            own, after = open_[order], after[order]
            self.array[slots] = own
            fresh = np.ones(len(own), bool)
            fresh[1:] = (rank[own[1:]] != rank[own[:-1]]) | (after[1:] != after[:-1])
            rank = rank.copy()
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, len(own)))
            rank[own] = np.repeat(slots[start], size) + 1
            left = np.repeat(size > 1, size) & (after > 0)  # suffixes that end together are equal for good
            open_, slots, k = own[left], slots[left], 2 * k

    def at(self, place: np.ndarray, word: int) -> np.ndarray:
        """The number of the word so many words into the suffixes at some places of the array."""
        own = self.array[place] + word
        return np.where(own < self.end[self.array[place]], self.words[np.minimum(own, len(self.words) - 1)], 0)

    def bound(self, low: np.ndarray, high: np.ndarray, word: int, key: np.ndarray, after: bool) -> np.ndarray:
        """Binary search within ranges whose suffixes are equal up to ``word``."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            there = self.at(mid, word)
            right = (there <= key[open_]) if after else (there < key[open_])
            low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
        return low


@dataclass
class Found:
    first: np.ndarray  # first word of each document, and the end
    hit: np.ndarray  # which words are hit
    items: list[list[int]]  # items with an occurring window, of each document
    longest: np.ndarray  # words of the longest verbatim match, of each document
    locations: np.ndarray  # rows of document, item, first word in the document and words, of each longest match


def _own_numbers(items: Items, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The shard's number of each different word of the items, -1 where it has none."""
    some = np.full(int(number.max()) + 1, -1)
    some[number] = np.arange(len(number))  # a place where each word stands
    hashes = word_hashes(buf, starts[some], ends[some])
    order = np.argsort(hashes)
    hashes = hashes[order]
    out = np.full(len(items.names), -1)
    at = np.searchsorted(hashes, items.hashes)
    for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == items.hashes).tolist():
        k = int(at[i])
        while k < len(order) and hashes[k] == items.hashes[i]:
            place = some[order[k]]
            if buf[starts[place] : ends[place]].tobytes() == items.names[i]:
                out[i] = order[k]
            k += 1
    return out


def _aranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _crossed(left: np.ndarray, right: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all rows (group, a) and (group, b) of one group; both are sorted by group."""
    n, m = np.bincount(left[:, 0], minlength=groups), np.bincount(right[:, 0], minlength=groups)
    first = np.cumsum(m) - m
    return np.repeat(left[:, 1], m[left[:, 0]]), right[_aranges(first[left[:, 0]], m[left[:, 0]]), 1]


def _match_lengths(here: np.ndarray, there: np.ndarray, s: np.ndarray, p: np.ndarray, most: np.ndarray, known: int) -> np.ndarray:
    """Equal words from ``here[s]`` and ``there[p]`` on, at least ``known`` and up to ``most``; all pairs side by side."""
    out = np.minimum(most, known)
    open_, step = np.flatnonzero(most > known), 8
    while len(open_):
        at = out[open_][:, None] + np.arange(step)
        inside = at < most[open_][:, None]
        same = inside & (here[np.where(inside, s[open_][:, None] + at, 0)] == there[np.where(inside, p[open_][:, None] + at, 0)])
        run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        out[open_] += run
        open_ = open_[(run == step) & (out[open_] < most[open_])]
        step = max(8, min(2 * step, (1 << 20) // max(len(open_), 1)))
    return out


#: Pairs of an item's and a document's place that are followed at a time.
_PAIRS = 1 << 16


def find(chunk: Chunk, items: Items, window: int) -> Found:
    """Looks every suffix of the items up in the chunk's suffix array."""
    buf = LOWER[chunk.buf]
    w = words(Chunk(chunk.first, buf, chunk.offsets), ALNUM_WORDS)
    number = exact_numbers(buf, w.starts, w.ends)
    n = len(number)
    found = Found(w.first, np.zeros(n, bool), [[] for _ in range(chunk.rows)], np.zeros(chunk.rows, np.int64), np.zeros((0, 4), np.int64))
    if not n or not len(items.number):
        return found
    shard = Shard(number, w.first)
    doc_of = np.repeat(np.arange(chunk.rows), np.diff(w.first))
    doc = doc_of[shard.array]
    wanted = _own_numbers(items, buf, w.starts, w.ends, number)[items.number] + 1  # as in ``shard.words``; 0 where the shard has none
    item_end = items.first[items.item + 1]
    live = np.flatnonzero(wanted > 0)
    low, high = shard.counts[wanted[live] - 1], shard.counts[wanted[live]]
    parts: list[tuple[np.ndarray, ...]] = []  # windows: first word in the items, words, range in the array
    for size in range(1, window + 1):
        if size > 1:
            on = live + size - 1 < item_end[live]
            key = np.where(on, wanted[np.minimum(live + size - 1, len(wanted) - 1)], 0)
            on &= key > 0
            live, low, high, key = live[on], low[on], high[on], key[on]
            low, high = shard.bound(low, high, size - 1, key, False), shard.bound(low, high, size - 1, key, True)
            live, low, high = (x[low < high] for x in (live, low, high))
        if not len(live):
            break
        change = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
        found.longest[doc[np.cumsum(change[:n]) > 0]] = size
        full = np.full(len(live), size == window) | ((live == items.first[items.item[live]]) & (live + size == item_end[live]))
        parts.append((live[full], np.full(int(full.sum()), size), low[full], high[full]))
    s, size, low, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
    if not len(s):
        return found
    # Equal windows have one range, and ranges of one length don't overlap.
    kinds, group = np.unique(np.stack([size, low, high], axis=1), axis=0, return_inverse=True)
    group = group.reshape(-1)
    counts = kinds[:, 2] - kinds[:, 1]
    place, of = shard.array[_aranges(kinds[:, 1], counts)], np.repeat(np.arange(len(kinds)), counts)
    change = np.bincount(place, minlength=n + 1) - np.bincount(place + kinds[of, 0], minlength=n + 1)
    found.hit = np.cumsum(change[:n]) > 0
    named = np.unique(np.stack([group, items.item[s]], axis=1), axis=0)
    held = np.unique(np.stack([of, doc_of[place]], axis=1), axis=0)
    which, where = _crossed(named, held, len(kinds))
    for d, i in np.unique(np.stack([where, which], axis=1), axis=0).tolist():
        found.items[d].append(i)
    # A match is told where it begins: the words before differ, or one of the two has none.
    before = np.where(place > w.first[doc_of[place]], shard.words[np.maximum(place - 1, 0)], 0)
    order = np.lexsort((before, of))
    place, before, of = place[order], before[order], of[order]
    key = of * (n + 2) + before
    begins, ends = np.searchsorted(of, group, "left"), np.searchsorted(of, group, "right")
    inner = s > items.first[items.item[s]]
    left_word = np.where(inner, wanted[np.maximum(s - 1, 0)], 0)
    skip = inner & (left_word > 0)
    skip_low = np.where(skip, np.searchsorted(key, group * (n + 2) + left_word, "left"), ends)
    skip_high = np.where(skip, np.searchsorted(key, group * (n + 2) + left_word, "right"), ends)
    firsts, sizes = np.concatenate([begins, skip_high]), np.concatenate([skip_low - begins, ends - skip_high])
    whose = np.concatenate([np.arange(len(s))] * 2)
    some = sizes > 0
    firsts, sizes, whose = firsts[some], sizes[some], whose[some]
    told = []
    done, all_ = 0, np.cumsum(sizes)
    while done < len(sizes):  # blocks of whole windows
        to = max(done + 1, int(np.searchsorted(all_, (all_[done - 1] if done else 0) + _PAIRS, "right")))
        p, own = place[_aranges(firsts[done:to], sizes[done:to])], np.repeat(whose[done:to], sizes[done:to])
        most = np.minimum(item_end[s[own]] - s[own], shard.end[p] - p)
        length = _match_lengths(wanted, shard.words, s[own], p, most, 1)
        d = doc_of[p]
        np.maximum.at(found.longest, d, length)
        told.append(np.stack([d, items.item[s[own]], p - w.first[d], length], axis=1))
        done = to
    if told:
        found.locations = np.concatenate(told)
    return found


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark, one bounded block after the other (one without items, if it is empty)."""
    ids, texts, size, none = [], [], 0, True
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") + 16
        if size >= block_bytes:
            yield Items.of(ids, texts)
            ids, texts, size, none = [], [], 0, False
    if ids or none:
        yield Items.of(ids, texts)


_STATE = "doc_id long, text string, n_words long, hits array<int>, items array<string>, longest_match long"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    *,
    block_bytes: int = 2 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in chunks(batch.column(1), SHARD_BYTES):
                    part, found = batch.slice(chunk.first, chunk.rows), find(chunk, block.value, window)
                    hits, named = [], []
                    for i, (before, items) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                        own = found.hit[found.first[i] : found.first[i + 1]].copy()
                        own[before or []] = True
                        hits.append(np.flatnonzero(own).astype(np.int32))
                        named.append((items or []) + [block.value.ids[k] for k in found.items[i]])
                    longest = np.maximum(found.longest, part.column(5).to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), part.column(1), pa.array(np.diff(found.first), pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                            pa.array(named, pa.list_(pa.string())), pa.array(longest, pa.int64()),
                        ],
                        names=["doc_id", "text", "n_words", "hits", "items", "longest_match"],
                    )

        return run

    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest_match")]
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *none)
    state = _in_passes(state, benchmark, block_bytes, item_col, item_text_col, search, _STATE)
    return state.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest_match",
    )


def _in_passes(frame: DataFrame, benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str, search, schema) -> DataFrame:
    """One pass over the frame for each block of the benchmark; all but the last are written."""
    blocks = item_blocks(benchmark, block_bytes, item_col, text_col)
    block = next(blocks)
    while block is not None:
        held = frame.sparkSession.sparkContext.broadcast(block)
        frame = map_arrow(frame, search(held), schema)
        if (block := next(blocks, None)) is not None:
            frame = written(frame, "decontamination")
            held.unpersist()
    return frame


def locations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, length) of every verbatim match of a window or more that can't be longer, in words of the document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for chunk in chunks(batch.column(1), SHARD_BYTES):
                    rows = [(ids[chunk.first + d], block.value.ids[i], p, n) for d, i, p, n in find(chunk, block.value, window).locations.tolist()]
                    if rows:
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "start", "length"])

        return run

    found = None
    for block in item_blocks(benchmark, block_bytes, "item_id", "text"):
        held = docs.sparkSession.sparkContext.broadcast(block)
        one = written(map_arrow(own, search(held), "doc_id long, item_id string, start long, length long"), "locations")
        held.unpersist()
        found = one if found is None else found.unionByName(one)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, block_bytes: int = 2 << 20, text_col: str = "text") -> DataFrame:
    """The documents without a hit word (null texts have none), with all their columns; no shuffle."""
    at = docs.columns.index(text_col)

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in chunks(batch.column(at), SHARD_BYTES):
                    found = find(chunk, block.value, window)
                    clean = per_document(found.hit, found.first) == 0
                    yield batch.slice(chunk.first, chunk.rows).filter(pa.array(clean))

        return run

    return _in_passes(docs, benchmark, block_bytes, "item_id", "text", search, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract and the longest match in SQL, for ids that stand once: equal words of a document and an
#: item at one distance from each other form runs; those of a window or more are hits.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
lists AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
words AS (
  SELECT side, id, n, i, list_extract(w, i) AS word FROM (SELECT side, id, w, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM lists)),
same AS (
  SELECT d.id AS doc, b.id AS item, d.i, d.i - b.i AS shift, least(b.n, 10) AS needed
  FROM words d JOIN words b ON d.word = b.word AND d.side = 'd' AND b.side = 'b'),
steps AS (SELECT *, i - row_number() OVER (PARTITION BY doc, item, shift ORDER BY i) AS run FROM same),
runs AS (
  SELECT doc, item, min(i) AS start, count(*) AS length, any_value(needed) AS needed
  FROM steps GROUP BY doc, item, shift, run),
longest AS (SELECT doc, max(length) AS longest_match FROM runs GROUP BY doc),
hits AS (SELECT doc, item, start, length FROM runs WHERE length >= needed),
places AS (SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(generate_series(start, start + length - 1)) AS p FROM hits) GROUP BY doc),
items AS (
  SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc, item FROM hits) GROUP BY doc)
SELECT d.doc_id, (SELECT len(w) FROM lists l WHERE l.side = 'd' AND l.id = CAST(d.doc_id AS VARCHAR)) AS n_words,
       coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0) AS longest_match
FROM documents d
LEFT JOIN places p ON p.doc = CAST(d.doc_id AS VARCHAR)
LEFT JOIN items t ON t.doc = CAST(d.doc_id AS VARCHAR)
LEFT JOIN longest g ON g.doc = CAST(d.doc_id AS VARCHAR)
"""
