"""Spelling variants: words that differ by one inserted, deleted or replaced character, by two-dimensional range reporting.

The words of one length stand in forward order and in the order of their reversals; each is a
point (place in one order, place in the other). For a word and a position p, the words that
begin as it does before p are an interval of the forward order, those that end as it does
after p are one of the reverse order, and a wavelet tree over the points reports what lies in
both: words that differ at p alone (same length), or that lack p's character (one shorter).

No task holds all words. A word that has an edit within the positions [low, high) keeps what is
before and after them, so words are dealt by that rest for two windows, each one half of the word;
a rest that very many words share, or a window over long words, is dealt again with its window
halved. Each part is then searched by itself, and every pair is found in one part only.

Characters are Latin letters of one byte in ISO 8859-1, so a word is a row of bytes.

Defined results: a null text has no words; with a null ``doc_id`` no character is deleted; repeated rows
count each time; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table
from .components import spread_join

#: What a word is made of, and A-Z in lower case as bytes of ISO 8859-1.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
#: Rows of one part, rows that one rest may have, and the widest window that is searched.
PART_ROWS, REST_ROWS, WINDOW = 1 << 17, 1 << 15, 64
#: Bytes of prefixes and suffixes that are looked up at a time.
QUERY_BYTES = 8 << 20

SAME, SHORTER = 0, 1


def counted_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mutate: int = 199) -> DataFrame:
    """(word, n): all runs of letters, A-Z in lower case. Where ``mutate`` divides the crc32 of ``id:run``,
    the character that this number points at is left out (0: nowhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for m in RUN.findall(text.as_py() or ""):
                    own[m] = own.get(m, 0) + 1
                for word, n in own.items():
                    low = word.encode("latin-1").translate(LOWER)
                    if mutate and i is not None:
                        h = zlib.crc32(low.decode("latin-1").encode(), zlib.crc32(b"%d:" % i))
                        if h % mutate == 0:
                            at = h % len(low)
                            low = low[:at] + low[at + 1 :]
                    total[low] = total.get(low, 0) + n
                if len(total) > COUNTED:
                    yield told()
                    total = {}
        if total:
            yield told()

    found = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word") != "")


class WaveletTree:
    """A permutation of 0 .. n - 1 by the bits of its values; reports the values in a rectangle."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.zeros: list[np.ndarray] = []  # zeros before each place of a level
        level = values.astype(np.int64)
        # Every level is sorted by the bits above it, so a node is a range of places that starts at its least value.
        for bit in range(self.bits - 1, -1, -1):
            zero = ((level >> bit) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            level = level[np.argsort(level >> bit, kind="stable")]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at places [left, right)."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, node = left[query], right[query], np.zeros(len(query), np.int64)
        for depth, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - depth)
            # Places of a node's children: its zeros first, then its ones.
            end = np.minimum(node + 2 * width, self.n)
            base = zeros[node]
            split = node + zeros[end] - base
            to_zero = (node + zeros[left] - base, node + zeros[right] - base, node)
            to_one = (split + left - node - (zeros[left] - base), split + right - node - (zeros[right] - base), node + width)
            left, right, node = (np.concatenate(pair) for pair in zip(to_zero, to_one, strict=True))
            query = np.concatenate([query, query])
            use = (left < right) & (node < high[query]) & (node + width > low[query])
            left, right, node, query = left[use], right[use], node[use], query[use]
        return query, node


@dataclass
class PointIndex:
    """Words of one length in both orders; ``forward`` and ``reverse`` are sorted, ``tree`` joins the two."""

    forward: np.ndarray
    reverse: np.ndarray
    row: np.ndarray  # row of each place of the reverse order
    tree: WaveletTree

    @classmethod
    def of(cls, words: np.ndarray) -> PointIndex:
        """``words`` is a matrix of bytes, a row for each word, all different."""
        size = words.shape[1]
        as_rows = lambda m: np.ascontiguousarray(m).view(f"S{size}").ravel()
        forward, reverse = as_rows(words), as_rows(words[:, ::-1])
        order, back = np.argsort(forward, kind="stable"), np.argsort(reverse, kind="stable")
        place = np.empty(len(words), np.int64)
        place[back] = np.arange(len(words))
        return cls(forward[order], reverse[back], back, WaveletTree(place[order]))

    def find(self, queries: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, row of the word) of words with the prefix of query row ``row`` before ``at`` and
        its suffix after it. Queries are as long as the words, which then have any character there, or one longer."""
        size = self.forward.dtype.itemsize
        column = np.arange(size)
        prefix = queries[row][:, :size]
        before = column[None, :] < at[:, None]
        suffix = queries[row][:, ::-1][:, :size]
        after = column[None, :] < (queries.shape[1] - 1 - at)[:, None]
        ranges = []
        for order, part, known in ((self.forward, prefix, before), (self.reverse, suffix, after)):
            least, most = np.where(known, part, 0).astype(np.uint8), np.where(known, part, 255).astype(np.uint8)
            ranges.append(np.searchsorted(order, least.view(f"S{size}").ravel(), "left"))
            ranges.append(np.searchsorted(order, most.view(f"S{size}").ravel(), "right"))
        query, value = self.tree.report(*ranges)
        return query, self.row[value]


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _search(kind: int, asked: list[bytes], asked_windows: np.ndarray, known: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``asked``, row of ``known``) of near words with the edit in the asked word's window; in blocks."""
    queries, index = _matrix(asked), PointIndex.of(_matrix(known))
    low, high = asked_windows[:, 0], asked_windows[:, 1]
    step = max(1, QUERY_BYTES // (queries.shape[1] * WINDOW))
    for at in range(0, len(asked), step):
        rows = np.arange(at, min(at + step, len(asked)))
        counts = (high - low)[rows]
        ends = np.cumsum(counts)
        row = np.repeat(rows, counts)
        position = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + low[row]
        if kind == SHORTER:  # of equal neighbours only the last is left out
            last = position == queries.shape[1] - 1
            use = last | (queries[row, position] != queries[row, np.where(last, position, position + 1)])
            row, position = row[use], position[use]
        query, found = index.find(queries, row, position)
        yield row[query], found


def near_in_part(kinds: np.ndarray, sizes: np.ndarray, lows: np.ndarray, highs: np.ndarray, sides: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of near words among the rows of one part, each pair once in each direction."""
    order = np.lexsort((sides, highs, lows, sizes, kinds))
    groups = np.stack([kinds, sizes, lows, highs])[:, order]
    starts = np.flatnonzero(np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(axis=0)]))
    for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = order[lo:hi]
        kind, window = int(kinds[rows[0]]), [int(lows[rows[0]]), int(highs[rows[0]])]
        if kind == SAME:
            asked = known = rows
        else:  # side 0 is the longer word
            asked, known = rows[sides[rows] == 0], rows[sides[rows] == 1]
        if not len(asked) or not len(known):
            continue
        own = [words[r] for r in asked]
        for a, b in _search(kind, own, np.tile(window, (len(asked), 1)), own if kind == SAME else [words[r] for r in known]):
            a, b = asked[a], known[b]
            if kind == SAME:
                other = a != b
                yield a[other], b[other]
            else:
                yield np.concatenate([a, b]), np.concatenate([b, a])


ROW = "kind int, size int, low int, high int, side int, rest long, word string, n long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in ROW.split(", ")])


def _dealt(kind: int, size: int, low: int, high: int, side: int, word: str, n: int) -> tuple:
    """A row for what a word keeps outside a window of edits; ``size`` is the longer word's length."""
    end = high - side  # the shorter word has lost one character by then
    rest = xxhash.xxh64_intdigest(f"{kind}:{size}:{low}:{high}:{word[:low]}\0{word[end:]}") - (1 << 63)
    return kind, size, low, high, side, rest, word, n


def _first_rows(words: DataFrame) -> DataFrame:
    """Every word for both halves, as one of its length, as the longer and as the shorter of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, size, side in ((SAME, len(word), 0), (SHORTER, len(word), 0), (SHORTER, len(word) + 1, 1)):
                    half = size // 2
                    rows += [_dealt(kind, size, 0, half, side, word, n), _dealt(kind, size, half, size, side, word, n)]
            yield _batch(rows)

    return map_arrow(words.select("word", "n"), run, ROW)


def _halved(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                middle = (row["low"] + row["high"]) // 2
                for low, high in ((row["low"], middle), (middle, row["high"])):
                    out.append(_dealt(row["kind"], row["size"], low, high, row["side"], row["word"], row["n"]))
            yield _batch(out)

    return map_arrow(rows.select("kind", "size", "low", "high", "side", "rest", "word", "n"), run, ROW)


def dealt_rows(words: DataFrame, *, rest_rows: int = REST_ROWS, window: int = WINDOW) -> DataFrame:
    """Rows whose rest some other row shares, with windows halved until no rest has more than ``rest_rows`` rows
    (or its window is one position) and no window is wider than ``window``."""
    done: DataFrame | None = None
    rows = cut(_first_rows(words))
    while True:
        shared = rows.groupBy("rest").agg(F.count("*").alias("_n"), F.count_if(F.col("side") == 0).alias("_long"), F.min("kind").alias("_kind"))
        # Alone, or without the other side, a row finds nothing.
        shared = shared.where((F.col("_n") > 1) & (F.col("_long") > 0) & ((F.col("_kind") == SAME) | (F.col("_n") > F.col("_long"))))
        wide = (F.col("high") - F.col("low") > window) | ((F.col("_n") > rest_rows) & (F.col("high") - F.col("low") > 1))
        met = cut(spread_join(rows, shared.select("rest", "_n"), "rest").withColumn("_wide", wide))
        ready = met.where(~F.col("_wide")).drop("_n", "_wide")
        done = ready if done is None else done.unionByName(ready)
        if met.where("_wide").isEmpty():
            return done
        rows = cut(_halved(met.where("_wide")))


def near_words(words: DataFrame, *, rest_rows: int = REST_ROWS, window: int = WINDOW, part_rows: int = PART_ROWS) -> DataFrame:
    """(word, n_near, near, near_n): the number of words near each that has any, and the one of them with the largest n
    (ties: smallest). ``words`` has each word once, with n."""
    rows = dealt_rows(words, rest_rows=rest_rows, window=window)
    parts = max(1, -(-rows.count() // part_rows))

    def run(batch: pa.Table) -> pa.Table:
        sizes = {name: batch.column(name).to_numpy() for name in ("kind", "size", "low", "high", "side", "n")}
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        n_near = np.zeros(len(words), np.int64)
        # A word's place in an order of choice: largest n, then smallest word.
        place = np.empty(len(words), np.int64)
        place[np.array(sorted(range(len(words)), key=lambda r: (-sizes["n"][r], words[r])), np.int64)] = np.arange(len(words))
        choice = np.full(len(words), len(words), np.int64)
        for a, b in near_in_part(sizes["kind"], sizes["size"], sizes["low"], sizes["high"], sizes["side"], words):
            np.add.at(n_near, a, 1)
            np.minimum.at(choice, a, place[b])
        found = np.flatnonzero(n_near)
        by_place = np.empty(len(words), np.int64)
        by_place[place] = np.arange(len(words))
        best = by_place[choice[found]]
        text = lambda rows: pa.array([words[r].decode("latin-1") for r in rows], pa.string())
        return pa.table({"word": text(found), "n_near": pa.array(n_near[found]), "near": text(best), "near_n": pa.array(sizes["n"][best], pa.int64())})

    dealt = rows.withColumn("part", F.pmod("rest", F.lit(parts)))
    found = dealt.groupBy("part").applyInArrow(run, "word string, n_near long, near string, near_n long")
    first = F.struct((-F.col("near_n")).alias("order"), "near", "near_n")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("b")).select("word", "n_near", "b.near", "b.near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word with a form, and the last word that forms lead to. A form is more frequent than its word, so there is no circle."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(links.join(ahead, "root", "left"))
        if step.where("further IS NOT NULL").isEmpty():
            return links
        links = step.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mutate: int = 0, least_length: int = 6, least_n: int = 5, times: int = 5,
    rest_rows: int = REST_ROWS, window: int = WINDOW, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Every word of ``least_length`` characters (2 or more) and ``least_n`` occurrences, with its form: the near word of largest n if
    that is ``times`` (2 or more) its own or more."""
    counted = counted_words(docs, id_col=id_col, text_col=text_col, mutate=mutate)
    words = cut(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_n)))
    near = near_words(words, rest_rows=rest_rows, window=window, part_rows=part_rows)
    formed = F.col("near_n") >= times * F.col("n")
    rows = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")
        )
    )
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), mutate=199)
