"""SimHash near-dedup (operator 8): Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints
differ in at most two bits, then in one of the pairs of segments (0, 1), (1, 2), (2, 0)
the first is equal and the second differs in at most one bit (pigeonhole). A segment's
fuzzy keys are the indices of nearby codewords of the perfect (23, 12) Golay code: the
codeword at most 3 bits away and, when it is exactly 3 away, the five at 4 bits; segments
one bit apart always share one. So a fingerprint has 3 to 18 keys of 37 bits. Distinct
fingerprints join on a key, and the bits of each candidate pair are counted.

Keys that more than ``bucket`` fingerprints share are not paired up. There, fingerprints
meet at the exact points of radius one around them instead: two points' balls meet if
and only if they are at most two bits apart, and all that share a point are linked with
each other, so linking each to the least of them is enough. That is 65 rows for each
fingerprint, however many share a key. Joins on a key or a component that many share are
dealt over several tasks.

Null text has no words; documents without words have fingerprint zero and are linked
like any other. Ties (bits set in exactly half of the shingles) give 0. Repeated rows
and exact copies share a fingerprint and so a component. A row without an id has its own
fingerprint and component like any other; it links texts, but the smallest doc_id is one that
is not null, and null only if the component has none. Very long texts are hashed whole. An empty table gives an empty result. Only the id and text columns are read.

The contract above (three words, two bits) is that of the query. The pipeline's stage asks
for five words and a Jaccard similarity of 0.8: the same fingerprints and links, of five words, are
checked on whole texts, and ``near_copies`` adds the pairs whose fingerprints lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import cut, map_arrow, table, written
from .components import connected_components, frequent, spread_join
from .textbytes import LOWER, SPACE_WORDS, Chunk, chunks, words

__all__ = ["components", "fingerprints", "keep_one", "links", "op8_simhash"]

SHINGLE, SEED = 3, 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (1, 2), (2, 0))


#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of a byte array: short ones side by side, those of 32 bytes and more by the library."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(40, np.uint8)])
    eight = np.ndarray((len(buf) + 32,), dtype="<u8", buffer=padded.data, strides=(1,))
    four = np.ndarray((len(buf) + 32,), dtype="<u4", buffer=padded.data, strides=(1,))
    h = size.astype(np.uint64) + np.uint64(seed) + _P5
    for k in range(3):
        own = np.flatnonzero(size >= 8 * (k + 1))
        lane = _turn(eight[starts[own] + 8 * k] * _P2, 31) * _P1
        h[own] = _turn(h[own] ^ lane, 27) * _P1 + _P4
    at, rest = starts + size // 8 * 8, size % 8
    own = np.flatnonzero(rest >= 4)
    h[own] = _turn(h[own] ^ (four[at[own]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[own] += 4
    rest[own] -= 4
    for k in range(3):
        own = np.flatnonzero(rest > k)
        h[own] = _turn(h[own] ^ (padded[at[own] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return h


def shingle_hashes(chunk: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of ``k`` words joined by one space (fewer words: of all), and where documents start."""
    buf = LOWER[chunk.buf]
    w = words(chunk, SPACE_WORDS)
    in_word = SPACE_WORDS[buf]
    in_word[chunk.offsets[1:] - 1] = False
    keep = in_word.copy()
    keep[w.ends] = True  # of the white space after a word, the first byte
    buf[~in_word] = 0x20
    moved = np.cumsum(keep) - keep
    buf, starts, ends = buf[keep], moved[w.starts], moved[w.ends]
    counts = np.diff(w.first)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(w.first[:-1] - first[:-1], many) + np.arange(first[-1])
    last = begin + np.minimum(k, np.repeat(counts, many)) - 1
    return xxh64(buf, starts[begin], ends[last]), first


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each document's hashes; ``first`` has where they start, and the end."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        over = (2 * counts > sizes[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                fp = majority_bits(*shingle_hashes(chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword's index of each 23-bit word; codewords; error patterns of weight 3; for each, five indices."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    code = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, generator << bit, 0)
    nearest = np.zeros(1 << 23, dtype=np.int16)
    index = np.arange(4096, dtype=np.int16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            nearest[code ^ sum(1 << b for b in bits)] = index
    seven = np.flatnonzero(np.bitwise_count(code) == 7)
    patterns = np.array(sorted(sum(1 << b for b in bits) for bits in combinations(range(23), 3)))
    around = np.array([seven[(code[seven] & p) == p] for p in patterns])
    return nearest, code, patterns, around


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every segment's keys."""
    nearest, code, patterns, around = _golay()
    own = nearest[segment].astype(np.int64)
    error = segment ^ code[own]
    far = np.flatnonzero(np.bitwise_count(error) == 3)
    more = own[far][:, None] ^ around[np.searchsorted(patterns, error[far])]
    row = np.concatenate([np.arange(len(segment)), np.repeat(far, more.shape[1])])
    return row, np.concatenate([own, more.reshape(-1)])


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): all keys of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((fp >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
            for number, (exact, fuzzy) in enumerate(PAIRS):
                row, index = golay_keys(parts[fuzzy])
                key = (number << 35) | (parts[exact][row] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["key", "fp"])

    return map_arrow(nodes.select("fp"), run, "key long, fp long")


def links(nodes: DataFrame, bits: int = 2, bucket: int = 32) -> DataFrame:
    """(a, b) of distinct fingerprints at most two bits apart; enough of them to connect all that are."""
    if bits != 2:
        raise ValueError("the segments and keys are laid out for two bits")
    keys = fuzzy_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(spread_join(keys, shared, "key", hot=frequent(shared, "key")))
    few = met.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    later = lambda x, i: F.filter(F.col("fps"), lambda y, j: (j > i) & close(x, y))
    pairs = few.select(
        F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")
    ).select("p.a", "p.b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    balls = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    met_in_balls = balls.join(least, "point").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(met_in_balls).distinct()


def components(docs: DataFrame, *, bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(links(nodes, bucket=bucket))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = cut(spread_join(labelled, least, "component").select("fp", "component_id"))
    return spread_join(prints, by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **options: int | str) -> DataFrame:
    """One row of each component of near copies, linked by fingerprints and a check on whole texts; see ``near_copies.keep_one``."""
    return near_copies.keep_one(docs, shingle, similarity, fingerprint=majority_bits, links=links, **options)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
