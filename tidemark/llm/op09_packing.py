"""Best-fit packing (operator 9): best-fit decreasing with a segment tree.

A document is its token ids and an end id; one that is longer than a sequence is cut into
full pieces and a rest. Full pieces are sequences by themselves. All other pieces are dealt
evenly over groups of about ``group_size`` pieces, and each group is packed by itself: from
the longest piece down, each goes to the open sequence with the least room that still holds
it. Room is a whole number up to the sequence length, so the segment tree stands over the
rooms 0..length and finds the tightest one in about log2(length) steps. A group leaves
about one unfilled sequence, so the groups cost about 1 in 5,000 sequences at their usual size.

Null text is an empty text: just the end id. Equal lengths (ties) are taken by doc_id and
piece. Repeated rows are packed each on its own. Texts of any length are cut, never
dropped. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .textbytes import chunks
from .tokens import ENCODE_BYTES, default_path, encoder


class TightestFit:
    """Open sequences by the room they have left; a segment tree over 0..length counts them."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of ``need`` or more, taken out, with its room."""
        node, count = need + self.size, self.count
        while not count[node]:  # up, until something lies to the right
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # went past the right end of its level
                return None
        while node < self.size:
            node = 2 * node + (not count[2 * node])
        room = node - self.size
        self._change(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    tree = TightestFit(length)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if found := tree.take(need):
            number, room = found
        else:
            number, room, opened = opened, length, opened + 1
        sequence[i], offset[i] = number, length - room
        tree.put(number, room - need)
    return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, length: int = 2048, *, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's pieces of at most ``length`` ids, with checksums."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_chunk = encoder(path).encode
        for batch in batches:
            for chunk in chunks(batch.column(1), ENCODE_BYTES):
                ids, bounds = encode_chunk(chunk)
                counts = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                first = np.cumsum(counts) - counts
                many = -(-counts // length)
                row = np.repeat(np.arange(chunk.rows), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                size = np.minimum(length, counts[row] - start)
                at = first[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(row)), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, PIECES)


PACKED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, length: int = 2048, *, group_size: int = 8192, **options: object) -> DataFrame:
    """The pieces with the sequence that each is in and its place there."""
    all_pieces = written(pieces(docs, length, **options), "pieces")
    full, rest = F.col("length") == length, all_pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_size))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        number = group.column("pack_group")[0].as_py()
        sequence, offset = best_fit(group.column("length").to_numpy(), length)
        own = group.select([f.split()[0] for f in PIECES.split(", ")])
        return own.append_column("sequence_id", pa.array((np.int64(number) << 40) + sequence)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("pack_group", F.pmod(F.monotonically_increasing_id() + F.hash(F.spark_partition_id()), F.lit(groups)))
    packed = dealt.groupBy("pack_group").applyInArrow(run, PACKED)
    alone = all_pieces.where(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
