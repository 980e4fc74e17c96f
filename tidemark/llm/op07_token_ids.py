"""Token-ID output (operator 7): token ids in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id; every partition is one shard, a run of
segments of whole documents (see ``pfor``). Shards are written as rows of a Parquet table
by Spark's own committer, so the output can be in any store that Spark writes and a lost
executor leaves nothing half-written. A document's start in the corpus is the sum of the
shards before, the segments before in its shard, and the documents before in its segment:
no step orders or gathers more than one small row for each shard or segment.

Null text is an empty text and has just the end id. Documents with equal ids stay
together in any order; rows without an id come first. Long texts are whole, whatever
their length, in a segment of their own size. An empty table gives empty output. Only
the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .pfor import Segment, pack
from .textbytes import chunks
from .tokens import ENCODE_BYTES, default_path, encoder

SEGMENTS = (
    "shard int, segment int, n_ids long, doc_ids array<long>, doc_counts array<int>, payload binary"
)
_SEGMENT_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_counts", pa.list_(pa.int32())), ("payload", pa.binary()),
    ]
)


def encode(
    docs: DataFrame, *, end_id: int = 2, tokenizer: str | None = None, percentile: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The segments of all documents in ascending id order, one shard for each partition."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, encode_chunk = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            for chunk in chunks(batch.column(1), ENCODE_BYTES):
                ids, bounds = encode_chunk(chunk)
                counts = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v], kind)
                        for v, kind in zip(
                            (shard, segment, len(ids), batch.column(0).slice(chunk.first, chunk.rows).to_pylist(), counts.tolist(), pack(ids, percentile)),
                            _SEGMENT_ARROW.types,
                            strict=True,
                        )
                    ],
                    schema=_SEGMENT_ARROW,
                )
                segment += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), run, SEGMENTS)


_DOCS = "shard int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def decode(segments: DataFrame) -> DataFrame:
    """Reads the blocks back: one row for each document, with its place in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, doc_ids, counts, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = Segment(payload).ids().astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(segments.select("shard", "segment", "doc_ids", "doc_counts", "payload"), run, _DOCS)


def starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, base): ids before each segment. One row for each shard meets in one task."""
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = shards.select("shard", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_base"))
    own = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own_base"))
    return own.join(before, "shard").select("shard", "segment", (F.col("own_base") + F.col("shard_base")).alias("base"))


def token_table(docs: DataFrame, **options: object) -> DataFrame:
    """Writes the segments, reads them back, and gives each document's place and checksum."""
    segments = written(encode(docs, **options), "token-ids")
    return (
        decode(segments)
        .join(starts(segments), ["shard", "segment"])
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
