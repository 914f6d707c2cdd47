"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir, ship_package, work_dir
from ..sources.points import table

__all__ = ["table", "ready", "cut", "few", "numbered", "written", "is_held_out", "text_batches", "shuffle_width", "ASCII_LOWER"]

#: Byte table that lower-cases A-Z and nothing else (UTF-8 safe).
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and resolve the shared checkpoint folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Spark hands the plan's estimated size on to the checkpoint, and a join's
    estimate is the product of its sides': over rounds that join a table with its own last form the number doubles
    its digits each time, until it fills the driver. An estimate beyond any real size is dropped (the rows are the same)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    plan = kept._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes().bit_length() < SIZE_BITS:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), kept._jdf.schema(), False), spark)


#: Bits of a size estimate from which on a checkpoint has none (Spark's own default takes 63).
SIZE_BITS = 64


#: Rows of narrow tables that one task takes.
TASK_ROWS = 20_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df` in no more tasks than `rows` rows need: a small table in many tasks costs each shuffle and checkpoint
    several files a task, whatever it holds."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and kept when executors are lost."""
    path = work_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order) -> DataFrame:
    """`df`, written, with `id`: the row's place from 0 in `order`, which must be total. A range-partitioned
    sort numbers the rows of each partition; the partitions' counts (one each) give the offsets."""
    rows = written(df.sort(*order).withColumn("_part", F.spark_partition_id())
               .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    offsets, at = {}, 0
    for part in sorted(counts):
        offsets[part], at = at, at + counts[part]
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "_part int, _start bigint")
    return (rows.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_row"))
            .drop("_part", "_row", "_start"))


def is_held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text modulo `modulus`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 max_chars: int = 2_000_000, max_rows: int = 2_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the incoming batches, each of at most `max_rows` rows and about `max_chars`
    characters (one longer text stands alone), with the column's values as Python strings."""
    for b in batches:
        values = b.column(b.schema.get_field_index(column))
        at, n = 0, b.num_rows
        while at < n:
            texts, chars, end = [], 0, at
            while end < n and end - at < max_rows and (chars < max_chars or end == at):
                t = values[end].as_py()
                if end > at and t is not None and chars + len(t) > max_chars:
                    break
                texts.append(t)
                chars += len(t) if t is not None else 0
                end += 1
            yield b.slice(at, end - at), texts
            at = end
