"""File sources and sinks: flow CSV (S2/S3), flattened sequences (S4),
NDJSON event export (S5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import protocol_name, round_half_up
from ..operators.dataset import fill_missing
from ..operators.sequences import flatten_sequences, unflatten_sequences
from ..schema import FEATURES, FLOW_CSV_SCHEMA, LABEL

FLOW_CSV_COLS = FEATURES + ["src_ip", "dst_ip", "attack_type", LABEL]


# -- S2 / S3 ----------------------------------------------------------------
def read_flows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Flow CSV read by the names in its header, in any order; numeric nulls -> 0, attack_type -> ''."""
    raw = spark.read.option("header", True).csv(paths)
    missing = [c for c in FLOW_CSV_COLS if c not in raw.columns]
    if missing:
        raise ValueError(f"flow file misses columns: {missing}")
    return fill_missing(raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in FLOW_CSV_SCHEMA.fields]))


def write_flows(flows: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None,
                mode: str = "overwrite") -> None:
    """S3: write the flow dataset in its fixed column order (CSV with header, or Parquet)."""
    out = flows.select(*[F.col(c) if c in flows.columns else F.lit(None).alias(c) for c in FLOW_CSV_COLS])
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# -- S4 ---------------------------------------------------------------------
def write_sequences(seqs: DataFrame, path: str, seq_len: int = 16, mode: str = "overwrite") -> None:
    """Flattened sequences (``seq_len * 52`` columns + label) as CSV."""
    flatten_sequences(seqs, seq_len).write.mode(mode).option("header", True).csv(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Read flattened sequences back to ``window`` arrays (length from the width)."""
    flat = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return unflatten_sequences(flat)


# -- S5 ---------------------------------------------------------------------
BASE_US = 1_704_067_200_000_000


def event_struct(events: DataFrame, source: str = "capture", event_id: Column | None = None) -> Column:
    """The event document: id, timestamp, source, final, metadata, flow (4 dp),
    result (status, severity, reason, threat_score, flow_key, sequence, barriers), action."""
    final = F.col("final") if "final" in events.columns else F.lit(True)
    # UTC wall clock from an NTZ value: independent of the session time zone
    ts = F.expr(f"date_format(timestampadd(MICROSECOND, {BASE_US} + emit_us, TIMESTAMP_NTZ'1970-01-01 00:00:00'), "
                "\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'\")")
    action = F.struct((F.col("action_type") if "action_type" in events.columns else F.lit("observe")).alias("type"),
                      (F.col("action_message") if "action_message" in events.columns else F.lit(None).cast("string"))
                      .alias("message"))

    def barrier(score, state):
        return F.struct(F.col(score).alias("score"), F.col(state).alias("state"))

    return F.struct(
        (event_id if event_id is not None else F.lit(None).cast("string")).alias("id"),
        ts.alias("timestamp"), F.lit(source).alias("source"), final.alias("final"),
        F.struct("src_ip", "dst_ip", protocol_name(F.col("proto")).alias("protocol"),
                 F.col("a_port").alias("src_port"), F.col("b_port").alias("dst_port")).alias("metadata"),
        F.struct(*[round_half_up(f).alias(f) for f in FEATURES]).alias("flow"),
        F.struct("status", "severity", "reason", "threat_score", F.col("src_ip").alias("flow_key"),
                 F.struct(F.col("needs_context").alias("required"), F.col("history_len").alias("length"),
                          F.col("ready"), F.col("padded")).alias("sequence"),
                 F.struct(barrier("routine_score", "routine_state").alias("routine_xgboost"),
                          barrier("context_score", "context_state").alias("context_transformer"),
                          barrier("anomaly_score", "anomaly_state").alias("zero_day_autoencoder")).alias("barriers"),
                 ).alias("result"),
        action.alias("action"))


def export_events(events: DataFrame, path: str, event_id: Column | None = None, mode: str = "overwrite") -> None:
    """Newline-delimited JSON, one event document per line."""
    events.select(F.to_json(event_struct(events, event_id=event_id)).alias("value")).write.mode(mode).text(path)
