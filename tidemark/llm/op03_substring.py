"""Substring dedup (operator 3): seed and extend over winnowed anchors.

1. Seeds. In each window of 13 words the five-word run with the least hash is its anchor
   (winnowing), so equal windows have equal anchors wherever they stand. Documents meet on
   their anchors, and only anchors of two or more different texts go on.
2. Extension. A document gets its repeated anchors back and extends each of them both
   ways into all windows that have it as their anchor; these windows are matched across
   documents, and a window is a repeat if a smaller doc_id has it too.
3. Maximal repeats. Overlapping repeats of a document join into its longest repeated
   stretches, whose words are removed.

Exact copies of a whole text are settled by their first document alone and take no part
in the steps above. What many documents share is settled in two steps: each chunk of
texts sends one row for an anchor or a window and decides the rest by itself, so the rows
that meet for one key are as many as the chunks, not the documents. A window that one
document has many times (a word or phrase over and over) is sent once and stands for all
its places there. Rows are read as a sorted stream that holds one row. Each exchange is
sorted, never grouped in memory.

Null text has no words. Texts of fewer words than a window lose nothing. Very long texts
are handled whole. Documents with equal ids never cover each other (a tie is no smaller
id); repeated rows each get the same result. Rows without an id are compared with
nothing and lose nothing. An empty table gives an empty result. Only the id and text
columns are read. Windows are compared by 96 bits of two independent hashes, texts by 96 bits
and their length.

Places of one anchor are not joined in pairs: an anchor that many documents share would give
all pairs of them. Each place is extended by itself instead, and what it extends to meets its
equals in one sorted exchange, which finds the same repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textbytes import SHARD_BYTES, SPACE_WORDS, Chunk, chunks, gram_hashes, runs_within, sliding, word_hashes, words

WINDOW, SEED = 13, 5


def _anchors(chunk: Chunk, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of documents; each window's anchor (0 for windows across documents); window hashes."""
    w = words(chunk, SPACE_WORDS)
    hashes = word_hashes(chunk.buf, w.starts, w.ends)
    grams = gram_hashes(hashes, seed) | np.uint64(1)
    n = len(hashes) - window + 1
    if n <= 0:
        return w.first, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    anchor = sliding(np.minimum, grams, window - seed + 1)
    anchor[~runs_within(w.first, window, n)] = 0
    return w.first, anchor, gram_hashes(hashes, window)


def _checks(chunk: Chunk, window: int) -> np.ndarray:
    """Another 32 bits for each window, of other word hashes."""
    w = words(chunk, SPACE_WORDS)
    return (gram_hashes(word_hashes(chunk.buf, w.starts, w.ends, family=1), window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _first_in_group(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that differ from the row before in one of the keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, same, settled): each text's distinct anchors.

    Where several texts of a chunk share an anchor it is repeated in any case: one of them
    stands for the anchor elsewhere, and the others are settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), SHARD_BYTES):
                first, anchor, _ = _anchors(chunk, window, seed)
                turn = np.flatnonzero(np.diff(anchor, prepend=np.uint64(0)) != 0)  # neighbours mostly share their anchor
                turn = turn[anchor[turn] != 0]
                text = batch.column(0).slice(chunk.first, chunk.rows).to_numpy()[np.searchsorted(first, turn, side="right") - 1]
                own = anchor[turn].view(np.int64)
                order = np.lexsort((text, own))
                own, text = own[order], text[order]
                keep = _first_in_group(own, text)
                own, text = own[keep], text[keep]
                settled = ~_first_in_group(own)
                settled_too = settled.copy()  # the first of several is sent, and known to be repeated
                settled_too[:-1] |= settled[1:]
                state = settled.astype(np.int8) + (settled_too & ~settled) * np.int8(2)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(text), pa.array(state)], names=["anchor", "same", "state"])

    return map_arrow(docs.select("same", "text"), run, "anchor long, same long, state byte")


def _repeated(seeds: DataFrame) -> DataFrame:
    """(same, anchor) of the anchors that two or more texts have; a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # rows of the last anchor so far: two at most
        for batch in batches:
            anchor, same, state = (batch.column(i).to_numpy() for i in range(3))
            done = state == 1
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(same[done]), pa.array(anchor[done])], names=["same", "anchor"])
            # A row known to be repeated is told at once; it still stands for its anchor.
            anchor, same, told = anchor[~done], same[~done], state[~done] == 2
            if told.any():
                yield pa.RecordBatch.from_arrays([pa.array(same[told]), pa.array(anchor[told])], names=["same", "anchor"])
            anchor, same, told = (np.concatenate(x) for x in zip(held, (anchor, same, told), strict=True))
            if not len(anchor):
                continue
            keep = _first_in_group(anchor, same)
            start = np.flatnonzero(_first_in_group(anchor))
            size = np.diff(np.append(start, len(anchor)))
            least, most = same[start], same[start + size - 1]
            repeated = np.repeat(least != most, size) & ~told & keep
            if repeated.any():
                yield pa.RecordBatch.from_arrays([pa.array(same[repeated]), pa.array(anchor[repeated])], names=["same", "anchor"])
            last = slice(start[-1], None)
            a, s, t = anchor[last], same[last], (told | repeated)[last]
            if s[0] == s[-1]:
                held = (a[:1], s[:1], t.any(keepdims=True))
            else:
                held = (a[[0, -1]], s[[0, -1]], np.ones(2, bool))

    key = F.when(F.col("state") == 1, F.col("same")).otherwise(F.col("anchor"))
    dealt = seeds.repartition(key).sortWithinPartitions("anchor", "same")
    return map_arrow(dealt, run, "same long, anchor long")


_PLACE = np.int64((1 << 32) - 1)
#: As a run: all places of the window in the document.
ALL = np.int32(-1)


def _extend(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(window, check, doc_id, place, run): all windows whose anchor is among the document's repeated ones.

    ``place`` has the word in its lower half and above it 31 bits of the text's hash, which
    tell texts apart that have one id. ``run`` is 0, or for what a smaller id of the chunk
    settles the number of windows in a row that are repeats, or ``ALL`` where one row stands
    for all places of a window that the document has several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), SHARD_BYTES):
                first, anchor, hashes = _anchors(chunk, window, seed)
                checks = _checks(chunk, window)
                part = batch.slice(chunk.first, chunk.rows)
                ids, same = part.column(0).to_numpy(), part.column(1).to_numpy()
                places, rows = [], []
                for i in range(chunk.rows):
                    own = anchor[first[i] : first[i + 1]]
                    repeated = part.column(3)[i].values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(own, repeated) & (own != 0))
                    places.append(at)
                    rows.append(np.full(len(at), i))
                place, row = np.concatenate(places), np.concatenate(rows)
                own, check, doc = hashes[first[row] + place].view(np.int64), checks[first[row] + place], ids[row]
                order = np.lexsort((doc, check, own))
                start = np.flatnonzero(_first_in_group(own[order], check[order]))
                least = np.repeat(doc[order][start], np.diff(np.append(start, len(order))))
                settled = np.zeros(len(order), dtype=bool)
                settled[order] = doc[order] > least
                tag = (same[row] & np.int64(0x7FFFFFFF)) << np.int64(32)
                packed = tag | place
                # Rows still stand in the order of documents and words here, so runs are neighbours.
                repeats = np.flatnonzero(settled)
                fresh = np.ones(len(repeats), dtype=bool)
                fresh[1:] = (row[repeats][1:] != row[repeats][:-1]) | (place[repeats][1:] != place[repeats][:-1] + 1)
                begin = np.flatnonzero(fresh)
                length = np.diff(np.append(begin, len(repeats)))
                told = repeats[begin]
                by_window = np.lexsort((row, check, own))
                new = _first_in_group(own[by_window], check[by_window], row[by_window])
                stands, again = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
                again[by_window] = ~new
                stands[by_window] = new & ~np.append(new[1:], True)
                sent = ~settled & ~again
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own[sent], doc[told]])), pa.array(np.concatenate([check[sent], np.zeros(len(told), np.int32)])),
                        pa.array(np.concatenate([doc[sent], doc[told]])),
                        pa.array(np.concatenate([packed[sent], packed[told]])),
                        pa.array(np.concatenate([np.where(stands[sent], ALL, np.int32(0)), length.astype(np.int32)])),
                    ],
                    names=["window", "check", "doc_id", "place", "run"],
                )

    return map_arrow(docs.select("doc_id", "same", "text", "anchors"), run, "window long, check int, doc_id long, place long, run int")


def _covered(windows: DataFrame) -> DataFrame:
    """(doc_id, place, run) of the windows that a smaller id has too; a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least_of_last = None, 0
        for batch in batches:
            own, check, doc, place, length = (batch.column(i).to_numpy() for i in range(5))
            hit = length > 0
            open_ = np.flatnonzero(~hit)
            if len(open_):
                w, c, d = own[open_], check[open_], doc[open_]
                start = np.flatnonzero(_first_in_group(w, c))
                least = d[start].copy()
                if (w[0], c[0]) == last:
                    least[0] = least_of_last
                hit[open_] = d > np.repeat(least, np.diff(np.append(start, len(w))))
                last, least_of_last = (w[-1], c[-1]), least[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[hit]), pa.array(place[hit]), pa.array(np.where(length == 0, np.int32(1), length)[hit])], names=["doc_id", "place", "run"]
            )

    # Rows of settled runs need not meet: near copies in one chunk would all go to the window they begin with.
    key = F.when(F.col("run") > 0, F.xxhash64("doc_id", "place")).otherwise(F.col("window"))
    dealt = windows.repartition(key).sortWithinPartitions("window", "check", "doc_id")
    return map_arrow(dealt, run, "doc_id long, place long, run int")


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _own_windows(part: pa.RecordBatch, window: int) -> dict[int, np.ndarray]:
    """Window hashes of the rows in which one place stands for several."""
    rows = [i for i, runs in enumerate(part.column(4)) if runs.values is not None and (runs.values.to_numpy() == ALL).any()]
    found = {}
    for chunk in chunks(part.column(2).take(pa.array(rows, pa.int64())), SHARD_BYTES):
        w = words(chunk, SPACE_WORDS)
        hashes = gram_hashes(word_hashes(chunk.buf, w.starts, w.ends), window)
        for i in range(chunk.rows):
            found[rows[chunk.first + i]] = hashes[w.first[i] : max(w.first[i + 1] - window + 1, w.first[i])]
    return found


def _remove(docs: DataFrame, window: int) -> DataFrame:
    """Joins each document's repeated windows into maximal repeats and takes their words out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), SHARD_BYTES):
                part = batch.slice(chunk.first, chunk.rows)
                same, copies = part.column(1).to_pylist(), part.column(5).to_pylist()
                equal = _own_windows(part, window)
                rows = []
                for i in range(chunk.rows):
                    own = chunk.text(i).split()
                    n = len(own)
                    places = part.column(3)[i].values
                    if copies[i] and n >= window:
                        own = []
                    elif places is not None and len(places):
                        place, length = places.to_numpy(), part.column(4)[i].values.to_numpy()
                        mine = (place >> np.int64(32)) == (same[i] & 0x7FFFFFFF)
                        start, length = (place & _PLACE)[mine], length[mine]
                        if i in equal:
                            many = length == ALL
                            more = np.flatnonzero(np.isin(equal[i], equal[i][start[many]]))
                            start = np.concatenate([start[~many], more])
                            length = np.concatenate([length[~many], np.ones(len(more), length.dtype)])
                        change = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(change, start, 1)
                        np.add.at(change, start + length + window - 1, -1)
                        own = [own[j] for j in np.flatnonzero(np.cumsum(change[:n]) == 0)]
                    rows.append((n, n - len(own), b" ".join(own)))
                n_words, n_removed, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return map_arrow(docs.select("doc_id", "same", "text", "places", "runs", "is_copy"), run, _RESULT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, removed words and a digest of the kept words of each document."""
    kept = deduplicated(docs, window, seed, id_col=id_col, text_col=text_col)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, removed words and the kept words (``kept_text``, joined by one space) of each document."""
    # Without an alias that changes nothing: the optimiser takes it out of one of the two exchanges of
    # the texts below only (a union keeps its first side's), and then they aren't equal, nor reused.
    doc_id = F.col(id_col)
    if docs.select(doc_id).dtypes != [("doc_id", "bigint")]:
        doc_id = doc_id.cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("same", F.xxhash64("text"))
    known = rows.where(F.col("doc_id").isNotNull())

    # The first document of each distinct text; texts count as equal by 96 bits of hash and their length.
    text_key = ["same", F.hash("text").alias("same_32"), F.length("text").alias("same_length")]
    firsts = known.select("doc_id", *text_key).groupBy("same", "same_32", "same_length").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", F.col("same").alias("first_same"))

    # All joins with the texts are on doc_id alone, so that one exchange of the texts serves them all;
    # the comparison by exclusive or keeps the second column out of the join's keys.
    anchors = _repeated(_seeds(known, window, seed)).groupBy(F.col("same").alias("first_same")).agg(F.collect_set("anchor").alias("anchors"))
    seeded = known.join(anchors.join(firsts, "first_same"), "doc_id").where(F.col("same").bitwiseXOR(F.col("first_same")) == 0)
    windows = _extend(seeded, window, seed)
    repeats = _covered(windows).groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list("run").alias("runs"))
    judged = (
        known.join(firsts.groupBy("doc_id").agg(F.collect_set("first_same").alias("first_of")), "doc_id", "left")
        .join(repeats, "doc_id", "left")
        .withColumn("is_copy", ~F.coalesce(F.array_contains("first_of", F.col("same")), F.lit(False)))
    )
    no_places = [F.array().cast("array<long>").alias("places"), F.array().cast("array<int>").alias("runs"), F.lit(False).alias("is_copy")]
    columns = ["doc_id", "same", "text", "places", "runs", "is_copy"]
    without_id = rows.where(F.col("doc_id").isNull()).select("doc_id", "same", "text", *no_places)
    return _remove(judged.select(*columns).unionByName(without_id), window)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: The contract in SQL, for ids that stand once: all windows of all documents meet as text.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_extract(w, i) AS word, i, n
  FROM (SELECT doc_id, w, len(w) AS n, unnest(generate_series(1, len(w))) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents))),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS phrase
  FROM words QUALIFY i + 12 <= n),
firsts AS (SELECT phrase, min(doc_id) AS first_doc FROM windows GROUP BY phrase),
repeats AS (SELECT doc_id, i FROM windows JOIN firsts USING (phrase) WHERE first_doc < doc_id),
marked AS (
  SELECT w.doc_id, w.i, w.word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last_repeat
  FROM words w LEFT JOIN repeats r ON r.doc_id = w.doc_id AND r.i = w.i),
judged AS (SELECT doc_id, i, word, coalesce(i - last_repeat <= 12, false) AS gone FROM marked),
totals AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN totals t USING (doc_id)
"""
