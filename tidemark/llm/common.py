"""What the operators share: reading tables, cutting lineage, Arrow row helpers."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a single machine (``local`` masters, as in tests) a temporary folder stands in where it is unset.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_tidemark_shared", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._tidemark_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads don't recompute and survive lost executors."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)



def map_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches that stay small for long texts too: it lowers the session's settings
    for Arrow batches where they are above ``BATCH_ROWS`` and ``BATCH_BYTES``."""
    conf = frame.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return frame.mapInArrow(run, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def spans_text(spans: Iterable[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` of (start, kind index, end), by start and then kind, comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
