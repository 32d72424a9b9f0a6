"""Legacy per-packet tables (S7, P7, P11): text columns as exported by a
packet dissector, one row per frame, coerced later by P6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite
from ..operators.analytics import packet_row_features
from ..schema import LEGACY_FEATURES


def _us_text(us, sep) -> F.Column:
    """Exact seconds text of a non-negative µs count: ``<s><sep><6 digits>``."""
    return F.concat(F.floor(us / 1_000_000).cast("long").cast("string"), sep,
                    F.lpad((us % 1_000_000).cast("string"), 6, "0"))


def legacy_packets(packets: DataFrame) -> DataFrame:
    """Derive the legacy text table from ``packets`` (FIXTURES.md §3).

    Frame number and time delta per capture (P11); ``tcp.flags`` as
    ``0x<hex>``, null on every fifth frame; ``frame.time_delta`` with a comma
    decimal on every third frame; ``mqtt.msgtype`` null off TCP. Keeps
    ``capture_id`` and ``seq`` for ordering.
    """
    r = packet_row_features(packets)
    fn = F.col("frame_number")
    delta_us = F.col("delta_us")
    tcp, udp, icmp = F.col("proto") == 6, F.col("proto") == 17, F.col("proto") == 1
    sep = F.when(fn % 3 == 0, F.lit(",")).otherwise(F.lit("."))
    txt = {
        "frame.number": fn.cast("string"),
        "frame.time_relative": _us_text(F.col("ts_us") - F.col("first_us"), F.lit(".")),
        "frame.len": F.col("length").cast("string"),
        "frame.time_delta": _us_text(delta_us, sep),
        "ip.proto": F.col("proto").cast("string"),
        "tcp.srcport": F.when(tcp, F.col("src_port").cast("string")),
        "tcp.dstport": F.when(tcp, F.col("dst_port").cast("string")),
        "udp.srcport": F.when(udp, F.col("src_port").cast("string")),
        "udp.dstport": F.when(udp, F.col("dst_port").cast("string")),
        "tcp.flags": F.when(tcp & (fn % 5 != 0), F.concat(F.lit("0x"), F.lower(F.hex(F.col("tcp_flags"))))),
        "icmp.type": F.when(icmp, F.lit("8")),
        "icmp.seq": F.when(icmp, fn.cast("string")),
        "mqtt.msgtype": F.when(tcp, F.lit("0")),
    }
    label = F.when(F.col("capture_id") == "normal", F.lit("0")).otherwise(F.lit("1"))
    return r.select("capture_id", "seq", *[v.alias(k) for k, v in txt.items()], label.alias("label"))


def read_packet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Legacy per-packet CSV with every column read as text."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.option("header", True).schema(schema).csv(path)


def align_packet_features(df: DataFrame, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Project to the legacy feature order; missing columns become 0."""
    names = order or LEGACY_FEATURES
    have = set(df.columns)
    cols = [F.col(f"`{c}`") for c in (keep or []) if c in have]
    cols += [(finite(F.col(f"`{c}`")) if c in have else F.lit(0.0)).alias(c) for c in names]
    return df.select(*cols)
