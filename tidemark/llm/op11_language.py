"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts become streams of lower-cased letters with one space between words and ``order - 1``
spaces in front. Spark counts the n-grams of all training rows; a language's model has the
interpolated probability of every n-gram seen, of each order up to ``order``, and of every
context the mass that is left to the next shorter one, in arrays sorted by 64-bit hashes.
Lower orders count the different characters before an n-gram in place of its occurrences.

A text's language is that of the lowest cross-entropy in bits per character. On training
rows that were left out of the counts (one in ``calibrate``) it is learned how high a
language's cross-entropy goes and how often a lead of so many bits is right: the first
gives the bound above which a text is rejected as none of the languages, the second the score.

``most_grams`` bounds what is broadcast, not what is counted. If the corpus has more different n-grams
of the highest order, the same recursion runs as joins of tables with all of them: the scores of the most
frequent n-grams are broadcast, and a text's other n-grams are scored by a join and added to its sum.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
nothing can be learned. Rows without a language, or without an id, are not learned from; a null id is not held out. Equal
cross-entropies go to the language that sorts first. Repeated rows count each time; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, written
from .components import spread_join
from .textbytes import mix64

ORDER, MOST_GRAMS, CALIBRATE = 5, 1 << 21, 8
#: Characters of one text that are looked at together, and distinct n-grams that a task counts before it hands them on.
SLICE, COUNTED = 1 << 20, 1 << 19
#: Share of the calibration rows of a language that rejection may cost.
REJECTED = 0.002
#: Cross-entropy is calibrated in steps of 1 / 64 bit up to 32 bits, a lead by its logarithm in steps of 1 / 8 up to 2 ** 24 bits.
BITS_STEP, BITS_CELLS, LEAD_STEP, LEAD_CELLS = 64, 2048, 8, 208

#: Joined scores are told in steps of 2 ** -20 bit, so that their sums don't depend on the order.
SCORE_STEP = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its letter in lower case plus 1, or 0 for what is no letter."""
    if not _LETTERS:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = 1 + (ord(low) if len(low) == 1 else c)
        _LETTERS.append(out)
    return _LETTERS[0]


def streams(texts: list[str], order: int, carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts, first place of each text and the end). A text has ``order - 1`` zeros in front
    (or ``carry``, the end of its earlier slice), and a zero after each word."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = _letters()[raw]
    starts = np.cumsum(sizes) - sizes
    if carry is None:  # a word that ends the text has its space too
        codes, sizes = np.insert(codes, starts + sizes, 0), sizes + 1
        starts = np.cumsum(sizes) - sizes
    before = np.empty(len(codes), np.uint32)
    before[1:] = codes[:-1]
    before[starts[sizes > 0]] = 0 if carry is None else carry[-1]
    kept = (codes != 0) | (before != 0)
    total = np.concatenate([[0], np.cumsum(kept)])
    counts = total[starts + sizes] - total[starts]
    front = np.zeros(order - 1, np.uint32) if carry is None else carry
    first = np.concatenate([[0], np.cumsum(counts + order - 1)])
    out = np.empty(first[-1], np.uint32)
    inside = np.ones(len(out), bool)
    for k in range(order - 1):
        out[first[:-1] + k] = front[k]
        inside[first[:-1] + k] = False
    out[inside] = codes[kept]
    return out, first


def sliced(text: str, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stream of one long text in slices that overlap by ``order - 1`` letters."""
    carry = np.zeros(order - 1, np.uint32)
    for at in range(0, len(text) + 1, SLICE):
        part = text[at : at + SLICE] + (" " if at + SLICE > len(text) else "")
        out, first = streams([part], order, carry)
        carry = out[len(out) - (order - 1) :]
        yield out, first


def grouped(texts: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, stream, bounds) of neighbouring texts of up to ``SLICE`` characters together; a longer text comes in several slices."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            for out, first in sliced(texts[at], order):
                yield at, out, first
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= SLICE:
            size += len(texts[to])
            to += 1
        yield at, *streams(texts[at:to], order)
        at = to


def gram_hashes(stream: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` letters that end at each place from k - 1 on."""
    n = len(stream) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _R + stream[j : j + n].astype(np.uint64) + np.uint64(1)
    return mix64(out)


def _ends(stream: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams (by place of their first letter) lie in one text."""
    ok = np.ones(max(len(stream) - order + 1, 0), bool)
    for k in range(1, order):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of (lang, text): a gram is ``order`` letters, spaces as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, n, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
            sort = np.argsort(h, kind="stable")
            h = h[sort]
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[begins], np.add.reduceat(n[sort], begins), grams[sort[begins]]

        def told() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                _, n, grams = merged(parts)
                letters = np.where(grams == 0, 0x20, grams - 1).astype("<u4")
                text = letters.tobytes().decode("utf-32-le", "surrogatepass")
                names = [text[i : i + order] for i in range(0, len(text), order)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(names, pa.string()), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            of: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                for _, stream, first in grouped(texts, order):
                    h = gram_hashes(stream, order)
                    places = np.flatnonzero(_ends(stream, first, order))
                    if not len(places):
                        continue
                    h = h[places]
                    sort = np.argsort(h)
                    h = h[sort]
                    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    where = places[sort[begins]]
                    grams = stream[where[:, None] + np.arange(order)]
                    parts = held.setdefault(lang, [])
                    parts.append((h[begins], np.diff(begins, append=len(h)), grams))
                    waiting += len(begins)
                    if len(parts) > 16:
                        before = sum(len(p[0]) for p in parts)
                        held[lang] = [merged(parts)]
                        waiting -= before - len(held[lang][0][0])
            if waiting > COUNTED * 4 or sum(len(p[0][0]) for p in held.values()) > COUNTED:
                yield from told()
                held, waiting = {}, 0
        yield from told()

    found = map_arrow(rows.select("lang", "text"), run, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Interpolated Kneser-Ney as sorted hash arrays: ``grams[k]`` has the hashes of k letters and log2 of their last
    letter's probability after the others, ``left[k]`` those of contexts of k letters and log2 of the mass that goes on to k - 1."""

    order: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    left: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, alphabet: int) -> CharModel:
        """``grams`` is a matrix of letters, all rows different; ``alphabet`` the number of letters that share what no order has."""
        order = grams.shape[1]
        levels: list[tuple[np.ndarray, np.ndarray]] = [(grams, counts.astype(np.float64))]
        for _ in range(order - 1):  # what is one shorter counts the different letters in front of it
            upper = levels[0][0][:, 1:]
            h = _row_hashes(upper)
            _, where, n = np.unique(h, return_index=True, return_counts=True)
            levels.insert(0, (upper[where], n.astype(np.float64)))
        model = cls(order)
        below = np.array([1.0 / alphabet])  # of the empty context, for any letter
        below_hash = np.zeros(1, np.uint64)
        for k, (rows, n) in enumerate(levels, 1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            context = _row_hashes(rows[:, :-1])
            known, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of, n, len(known)), np.bincount(of, minlength=len(known))
            mass = discount * kinds / total
            lower = below if k == 1 else below[np.searchsorted(below_hash, _row_hashes(rows[:, 1:]))]
            probability = (n - discount) / total[of] + mass[of] * lower
            h = _row_hashes(rows)
            sort = np.argsort(h)
            below, below_hash = probability[sort], h[sort]
            model.grams.append((below_hash, np.log2(below).astype(np.float32)))
            model.left.append((known, np.log2(mass).astype(np.float32)))
        model.floor = np.float32(-np.log2(alphabet))
        return model

    floor: np.float32 = np.float32(0)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last letter of each row of ``order`` letters after the others."""
        out, open_ = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for k in range(self.order, 0, -1):
            rows = grams[open_, self.order - k :]
            at, hit = _looked_up(self.grams[k - 1][0], _row_hashes(rows))
            out[open_[hit]] += self.grams[k - 1][1][at[hit]]
            miss = ~hit
            at, seen = _looked_up(self.left[k - 1][0], _row_hashes(rows[miss, :-1]))
            open_ = open_[miss]
            out[open_[seen]] += self.left[k - 1][1][at[seen]]
        out[open_] += self.floor
        return out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = out * _R + rows[:, j].astype(np.uint64) + np.uint64(1)
    return mix64(out)


def _looked_up(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(known, asked)
    at[at == len(known)] = 0
    return at, known[at] == asked


@dataclass
class Identifier:
    """Models of all languages, bounds of rejection, and the score of a lead by its cell."""

    langs: list[str]
    models: list[CharModel]
    order: int
    bounds: np.ndarray
    scores: np.ndarray
    #: Where the n-grams are too many to be broadcast: all of them. The models then have only the scores of the most frequent.
    whole: Whole | None = None


@dataclass
class Whole:
    """For each number of letters from 1 on, (lang, gram, own) and (lang, context, mass): a gram's probability
    is its own part and its context's mass times the probability without its first letter."""

    langs: list[str]
    alphabet: int
    levels: list[tuple[DataFrame, DataFrame]]

    @classmethod
    def of(cls, counted: DataFrame, langs: list[str], order: int) -> Whole:
        tables, counts = [], counted
        for k in range(order, 0, -1):
            stats = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
            discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
            placed = counts.withColumn("context", F.left("gram", F.lit(k - 1)))
            contexts = placed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            contexts = written(contexts.join(F.broadcast(stats.select("lang", discount.alias("d"))), "lang"), "gram-contexts")  # a row for each language
            own = placed.join(contexts, ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
            tables.append((written(own, "gram-shares"), contexts.select("lang", "context", (F.col("d") * F.col("kinds") / F.col("total")).alias("mass"))))
            if k > 1:  # what is one shorter counts the different letters in front of it
                counts = written(counts.groupBy("lang", F.right("gram", F.lit(k - 1)).alias("gram")).agg(F.count("*").alias("n")), "shorter-grams")
        return cls(langs, 2 * (counts.select("gram").distinct().count() + 1), tables[::-1])

    def scored(self, asked: DataFrame) -> DataFrame:
        """(gram, scores) of the distinct grams in ``asked``: log2 of the last letter's probability in each language."""
        asked = cut(asked.select("gram").distinct())
        names = F.broadcast(asked.sparkSession.createDataFrame(list(enumerate(self.langs)), "which int, lang string"))  # a row for each language
        below = names.select("lang", F.lit("").alias("suffix"), F.lit(1.0 / self.alphabet).alias("lower"))
        for k, (own, mass) in enumerate(self.levels, 1):
            wanted = asked.select(F.right("gram", F.lit(k)).alias("gram")).distinct().crossJoin(names)
            wanted = wanted.select("which", "lang", "gram", F.left("gram", F.lit(k - 1)).alias("context"), F.right("gram", F.lit(k - 1)).alias("suffix"))
            met = wanted.join(below, ["lang", "suffix"]).join(own, ["lang", "gram"], "left").join(mass, ["lang", "context"], "left")
            probability = F.coalesce("own", F.lit(0.0)) + F.coalesce("mass", F.lit(1.0)) * F.col("lower")
            found = cut(met.select("which", "lang", "gram", probability.alias("p")))
            below = found.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        score = F.round(F.log2("p") * SCORE_STEP) / SCORE_STEP
        by_lang = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("which", score.alias("score")))).alias("by_lang"))
        return by_lang.select("gram", F.col("by_lang.score").alias("scores"))


class Scorer:
    """Bits of texts under each model. Scores of n-grams met lately are kept in a table of fixed size, looked up by hash."""

    CELLS = 1 << 18

    def __init__(self, identifier: Identifier) -> None:
        self.of = identifier
        self.keys = np.zeros(self.CELLS, np.uint64)
        self.rows = np.zeros((self.CELLS, len(identifier.models)), np.float32)

    def _gram_scores(self, stream: np.ndarray, places: np.ndarray, h: np.ndarray) -> np.ndarray:
        cell = (h & np.uint64(self.CELLS - 1)).astype(np.int64)
        out = self.rows[cell]
        miss = np.flatnonzero(self.keys[cell] != h)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            grams = stream[places[miss[where]][:, None] + np.arange(self.of.order)]
            found = np.stack([m.score(grams) for m in self.of.models], axis=1)
            out[miss] = found[back]
            cell = (new & np.uint64(self.CELLS - 1)).astype(np.int64)
            cell, last = np.unique(cell, return_index=True)  # one of those that share a cell
            self.keys[cell], self.rows[cell] = new[last], found[last]
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(minus log2 of each text's probability under each model, number of letters and spaces scored)."""
        total, size = np.zeros((len(texts), len(self.of.models))), np.zeros(len(texts), np.int64)
        order = self.of.order
        for at, stream, first in grouped(texts, order):
            h = gram_hashes(stream, order)
            places = np.flatnonzero(_ends(stream, first, order))
            if not len(places):
                continue
            scores = self._gram_scores(stream, places, h[places])
            counts = np.diff(first) - (order - 1)
            full = np.flatnonzero(counts > 0)
            begins = (np.cumsum(counts) - counts)[full]
            total[at + full] -= np.add.reduceat(scores.astype(np.float64), begins, axis=0)
            size[at + full] += counts[full]
        return total, size


class KnownScorer:
    """Bits of the frequent n-grams of texts, and their other n-grams."""

    def __init__(self, identifier: Identifier) -> None:
        self.order = identifier.order
        self.hashes = identifier.models[0].grams[-1][0]
        self.scores = np.stack([m.grams[-1][1] for m in identifier.models], axis=1)

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """(minus log2 of the frequent ones, letters and spaces, names of the others, how often each)."""
        total, size = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        names, numbers = [[] for _ in texts], [[] for _ in texts]
        for at, stream, first in grouped(texts, self.order):
            places = np.flatnonzero(_ends(stream, first, self.order))
            h = gram_hashes(stream, self.order)[places]
            counts = np.diff(first) - (self.order - 1)
            text = at + np.repeat(np.arange(len(counts)), counts)
            size[at : at + len(counts)] += counts
            where, hit = _looked_up(self.hashes, h) if len(self.hashes) else (h, np.zeros(len(h), bool))
            found = np.flatnonzero(hit)
            for lang in range(total.shape[1]):
                total[:, lang] -= np.bincount(text[found], self.scores[where[found], lang], len(texts))
            other = np.flatnonzero(~hit)
            other = other[np.lexsort((h[other], text[other]))]
            new = np.ones(len(other), bool)
            new[1:] = (h[other][1:] != h[other][:-1]) | (text[other][1:] != text[other][:-1])
            begins = np.flatnonzero(new)
            grams = stream[places[other[begins]][:, None] + np.arange(self.order)]
            said = np.where(grams == 0, 0x20, grams - 1).astype("<u4").tobytes().decode("utf-32-le")
            for i, (of, n) in enumerate(zip(text[other[begins]].tolist(), np.diff(begins, append=len(other)).tolist(), strict=True)):
                names[of].append(said[i * self.order : (i + 1) * self.order])
                numbers[of].append(n)
        return total, size, names, numbers


def _totals(rows: DataFrame, identifier: Identifier) -> DataFrame:
    """(first column, total, size) of rows (anything, text): the bits of all n-grams, frequent or not."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(identifier, whole=None))  # bounded by ``most_grams``
    first, langs = rows.columns[0], range(len(identifier.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, row = KnownScorer(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            total, size, names, numbers = scorer.bits([t or "" for t in batch.column(1).to_pylist()])
            told = [pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(size), pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(row + np.arange(len(size))), *told], names=[first, "row", "total", "size", "grams", "numbers"])
            row += len(size)

    kind = rows.schema[first].dataType.simpleString()
    parts = written(map_arrow(rows, run, f"{first} {kind}, row long, total array<double>, size long, grams array<string>, numbers array<long>"), "known-bits")
    others = parts.select("row", F.explode(F.arrays_zip("grams", "numbers")).alias("one")).select("row", F.col("one.grams").alias("gram"), F.col("one.numbers").alias("n"))
    met = spread_join(others, identifier.whole.scored(others), "gram")
    sums = met.groupBy("row").agg(F.array(*(F.sum(F.col("n") * F.col("scores")[i]) for i in langs)).alias("more"))
    more = F.coalesce("more", F.array(*(F.lit(0.0) for _ in langs)))
    return parts.join(sums, "row", "left").select(first, F.zip_with("total", more, lambda a, b: a - b).alias("total"), "size")


def _told(batch: pa.RecordBatch, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, size) of a batch of ``_totals``."""
    return batch.column(1).flatten().to_numpy().reshape(-1, langs), batch.column(2).to_numpy()


def lead_cell(bits: np.ndarray) -> np.ndarray:
    """Cell of the lead of the best language over the second, in bits of the whole text."""
    return np.clip((np.log2(1 + np.maximum(bits, 0)) * LEAD_STEP).astype(np.int64), 0, LEAD_CELLS - 1)


def _judged(total: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its bits per character, cell of its lead)."""
    best = np.argmin(total, axis=1)
    rows = np.arange(len(total))
    entropy = total[rows, best] / np.maximum(size, 1)
    others = total.copy()
    others[rows, best] = np.inf
    lead = others.min(axis=1) - total[rows, best] if total.shape[1] > 1 else np.full(len(total), float(1 << 20))
    return best, entropy, lead_cell(lead)


def _rising(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of right answers by cell, made to rise with the cell (pooled neighbours), between 0 and 1."""
    blocks: list[list[float]] = []
    for r, k in zip(right, n, strict=True):
        blocks.append([r, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            r2, k2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + k2, blocks[-1][2] + c2]
    return np.concatenate([np.full(int(c), r / k if k else 0.5) for r, k, c in blocks])


def remainder(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_grams: int = MOST_GRAMS, calibrate: int = CALIBRATE) -> Identifier:
    """Learns from all rows with an id, a text and a language whose crc32(id) mod 4 is not 2."""
    rows = docs.select(remainder(id_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where((F.col("h") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = F.floor(F.col("h") / 4) % calibrate == 0
    counted = cut(gram_counts(rows.where(~held), order))
    if counted.count() > most_grams:
        found = _frequent(counted, order, most_grams)
        return _calibrated(found, rows.where(held))
    grams = counted.orderBy("lang", "gram").toArrow()  # at most ``most_grams`` rows
    langs = grams.column("lang").to_numpy(zero_copy_only=False)
    text = "".join(grams.column("gram").to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32).reshape(-1, order)
    codes = np.where(codes == 0x20, 0, codes + 1).astype(np.uint32)
    counts = grams.column("n").to_numpy()
    names = sorted(set(langs.tolist()))
    alphabet = 2 * (len(np.unique(codes)) + 1)
    models = [CharModel.of(codes[langs == name], counts[langs == name], alphabet) for name in names]
    bounds, scores = np.full(len(names), np.inf), np.full(LEAD_CELLS, 0.5)
    found = Identifier(names, models, order, bounds, scores)
    return _calibrated(found, rows.where(held)) if names else found


def _frequent(counted: DataFrame, order: int, most_grams: int) -> Identifier:
    """All n-grams as tables, and the scores of the most frequent ones to be broadcast."""
    names = sorted(r["lang"] for r in counted.select("lang").distinct().collect())  # a row for each language
    whole = Whole.of(counted, names, order)
    of_all = cut(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    # The least count that keeps the scores within the bound; counts above 65,535 are told as that.
    cells = of_all.groupBy(F.least("n", F.lit(65535)).alias("n")).agg(F.count("*").alias("kinds")).collect()
    least, kept = 65536, 0
    for n, kinds in sorted(((r["n"], r["kinds"]) for r in cells), reverse=True):
        if (kept + kinds) * len(names) > most_grams:
            break
        least, kept = n, kept + kinds
    rows = whole.scored(of_all.where(F.least("n", F.lit(65535)) >= least)).toArrow()  # at most ``most_grams`` scores
    text = "".join(rows.column("gram").to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32).reshape(-1, order)
    h = _row_hashes(np.where(codes == 0x20, 0, codes + 1).astype(np.uint32))
    sort = np.argsort(h)
    scores = rows.column("scores").combine_chunks().flatten().to_numpy().reshape(-1, len(names))[sort]
    models = [CharModel(order, [(h[sort], scores[:, i])]) for i in range(len(names))]
    return Identifier(names, models, order, np.full(len(names), np.inf), np.full(LEAD_CELLS, 0.5), whole)


def _calibrated(identifier: Identifier, rows: DataFrame) -> Identifier:
    joined = identifier.whole is not None
    if joined:
        rows = _totals(rows.select("lang", "text"), identifier)
    few = replace(identifier, models=[], whole=None)
    shared = rows.sparkSession.sparkContext.broadcast(few if joined else identifier)  # bounded by ``most_grams``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        scorer, number = None if joined else Scorer(of), {name: i for i, name in enumerate(of.langs)}
        entropies = np.zeros((len(of.langs), BITS_CELLS), np.int64)
        leads = np.zeros((2, LEAD_CELLS), np.int64)
        for batch in batches:
            true = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            total, size = _told(batch, len(of.langs)) if joined else scorer.bits(batch.column(1).to_pylist())
            use = (size > 0) & (true >= 0)
            best, _, cell = _judged(total, size)
            np.add.at(leads, ((best == true)[use].astype(int), cell[use]), 1)
            own = total[use, true[use]] / size[use]
            np.add.at(entropies, (true[use], np.minimum((own * BITS_STEP).astype(np.int64), BITS_CELLS - 1)), 1)
        kinds, names, cells, n = [], [], [], []
        for kind, counts in (("bits", entropies), ("lead", leads)):
            at, cell = np.nonzero(counts)
            kinds += [kind] * len(at)
            names += at.tolist()
            cells += cell.tolist()
            n += counts[at, cell].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.int64()), pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["kind", "which", "cell", "n"])

    told = map_arrow(rows if joined else rows.select("lang", "text"), run, "kind string, which long, cell long, n long").groupBy("kind", "which", "cell").agg(F.sum("n").alias("n")).collect()
    entropies, leads = np.zeros((len(identifier.langs), BITS_CELLS), np.int64), np.zeros((2, LEAD_CELLS), np.int64)
    for row in told:  # one for each cell
        (entropies if row["kind"] == "bits" else leads)[row["which"], row["cell"]] = row["n"]
    shares = np.cumsum(entropies, axis=1) / np.maximum(entropies.sum(axis=1, keepdims=True), 1)
    some = entropies.sum(axis=1) > 0
    # The bound is the end of the first cell that keeps the share asked for, and half a bit.
    bounds = np.where(some, (np.argmax(shares >= 1 - REJECTED, axis=1) + 1) / BITS_STEP + 0.5, np.inf)
    # Cells without rows count a hundredth of a row, half right, so that neighbours decide.
    scores = np.clip(_rising(leads[1] + 0.005, leads.sum(axis=0) + 0.01), 0.0, 1.0)
    shared.unpersist()
    return replace(identifier, bounds=bounds, scores=scores)


def identify(docs: DataFrame, identifier: Identifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_char and rejected (too unlike all languages) of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = identifier.whole is not None
    if joined:
        rows = _totals(rows, identifier)
    few = replace(identifier, models=[], whole=None)
    shared = docs.sparkSession.sparkContext.broadcast(few if joined else identifier)  # bounded by ``most_grams``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        scorer = Scorer(of) if of.langs and not joined else None
        for batch in batches:
            n = batch.num_rows
            if not of.langs:
                names, scores, bits, rejected = ["und"] * n, [0.0] * n, [None] * n, [True] * n
            else:
                total, size = _told(batch, len(of.langs)) if joined else scorer.bits([t or "" for t in batch.column(1).to_pylist()])
                best, entropy, cell = _judged(total, size)
                none = size == 0
                names = ["und" if x else of.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
                scores = np.where(none, 0.0, of.scores[cell]).tolist()
                bits = [None if x else e for x, e in zip(none.tolist(), entropy.tolist(), strict=True)]
                rejected = (none | (entropy > of.bounds[best])).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "bits_per_char", "rejected"],
            )

    return map_arrow(rows, run, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id") % 4 == 2, F.lit(False))
    return identify(docs, train(docs)).withColumn("held_out", held)
