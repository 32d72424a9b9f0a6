"""Replay a table as a file stream and run a streaming query to completion.

Used by tests and registered queries: packets are written in ``(ts_us, seq)``
order as a sequence of Parquet files (one per micro-batch with
``maxFilesPerTrigger=1``) plus a sentinel packet far after the end, so every
event-time timer fires. Work folders live under the session's shared
checkpoint directory, one fresh folder per run.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import with_bucket
from ..session import ensure_checkpoint_dir
from .flows import with_event_time


def work_dir(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


#: Rows of a slice, so of the task that sorts it, at about most.
SLICE_ROWS = 2_000_000


def write_slices(table: DataFrame, path: str, order: list[str], files: int = 8) -> DataFrame:
    """Write ``table`` as slices in ``order``, one after another (the file
    source takes files in modification order); returns the first slice.
    There are ``files`` of them, more where one would pass ``SLICE_ROWS``.

    Rows are dealt to their slices once, beside ``path``; each slice is then
    sorted from its own rows, so the whole table isn't scanned for every slice.
    """
    at, spark = order[0], table.sparkSession
    files = max(files, -(-table.count() // SLICE_ROWS))
    cuts = table.agg(F.percentile_approx(at, [i / files for i in range(1, files)], 10000).alias("q")).first()["q"]
    cuts = sorted({int(x) for x in cuts or []})
    if cuts:
        table = table.filter(F.col(at).isNotNull())
    dealt, n = path.rstrip("/") + "-dealt", len(cuts) + 1
    with_bucket(table, at, cuts).repartition(n, "_bkt").write.mode("overwrite").partitionBy("_bkt").parquet(dealt)
    # a slice without rows has no folder in ``dealt``
    every = spark.read.schema(T.StructType([*table.schema.fields, T.StructField("_bkt", T.LongType())])).parquet(dealt)
    for i in range(n):
        (every.filter(F.col("_bkt") == i).drop("_bkt").coalesce(1).sortWithinPartitions(*order)
         .write.mode("overwrite").parquet(os.path.join(path, f"part{i:04d}")))
    return spark.read.parquet(os.path.join(path, "part0000"))


def write_ordered(packets: DataFrame, path: str, files: int = 8, sentinel_gap_us: int = 400_000_000) -> None:
    """Write ``packets`` as ordered time slices, then one sentinel file."""
    write_slices(packets, path, ["ts_us", "seq"], files)
    write_sentinel(packets, path, sentinel_gap_us)


def write_sentinel(packets: DataFrame, path: str, sentinel_gap_us: int = 400_000_000) -> None:
    spark = packets.sparkSession
    qs = packets.agg(F.max("ts_us").alias("last")).first()
    last = qs["last"] or 0
    sentinel = spark.createDataFrame(
        [(-1, "__sentinel__", int(last) + sentinel_gap_us, 0, 0, "0.0.0.0", "0.0.0.0", 0, 0, 0, 0)],
        packets.select("seq", "capture_id", "ts_us", "length", "proto", "src_ip", "dst_ip", "src_port",
                       "dst_port", "header_len", "tcp_flags").schema)
    sentinel.write.mode("overwrite").parquet(os.path.join(path, "zz_sentinel"))


def shuffled_stream(spark: SparkSession, packets: DataFrame, path: str, disorder_us: int, files: int = 8) -> DataFrame:
    """Replay in which every packet arrives up to ``disorder_us`` late, by a hash of ``seq``."""
    jitter = F.pmod(F.xxhash64("seq"), F.lit(disorder_us))
    cols = packets.columns
    write_slices(packets.withColumn("_arrival", F.col("ts_us") + jitter), path, ["_arrival"], files)
    write_sentinel(packets, path)
    return with_event_time(read_stream(spark, path, packets.select(*cols).schema))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """File stream over ``path/part`` then ``path/zz_sentinel`` (one file per trigger)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(path))


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run ``stream`` with ``availableNow`` into ``out_path`` (append) and wait."""
    q = (stream.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def packet_stream(spark: SparkSession, packets: DataFrame, path: str, files: int = 8) -> DataFrame:
    write_ordered(packets, path, files)
    schema = spark.read.parquet(os.path.join(path, "part0000")).schema
    return with_event_time(read_stream(spark, path, schema))
