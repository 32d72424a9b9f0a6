"""The ``flows`` table: assembly + features + close reason + labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, KEY_COLS
from ..settings import DEFAULT_FLOW, FlowConfig
from .assemble import assign_flows, capture_ends, with_close_reason
from .features import flow_features

FLOW_COLS = KEY_COLS + ["flow_no", "first_us", "last_us", "emit_us", "close_reason"]


def label_flows(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attach ``label`` / ``attack_type`` per capture.

    The manifest has one row per capture. Under AQE the join becomes a
    broadcast hash join at runtime when the manifest's measured size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a
    shuffle join (with AQE skew splitting for a dominant capture).
    """
    m = manifest.select("capture_id", F.col("label").cast("int").alias("label"),
                        F.coalesce(F.col("attack_type"), F.lit("")).alias("attack_type"))
    return (flows.join(m, "capture_id", "left")
            .withColumn("label", F.coalesce(F.col("label"), F.lit(0)))
            .withColumn("attack_type", F.coalesce(F.col("attack_type"), F.lit(""))))


def build_flows(packets: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, clock: str = "key",
                manifest: DataFrame | None = None) -> DataFrame:
    """Packets -> one row per flow with the ``flows`` schema of FIXTURES.md.

    Columns: key, ``flow_no, first_us, last_us, emit_us, close_reason``, the
    52 features, ``src_ip, dst_ip`` (= endpoints a, b), and with a manifest
    ``attack_type, label``.
    """
    fp = assign_flows(packets, cfg, clock)
    feats = flow_features(fp)
    out = with_close_reason(feats, capture_ends(packets.select("capture_id", "ts_us")), cfg, clock)
    out = out.withColumn("src_ip", F.col("a_ip")).withColumn("dst_ip", F.col("b_ip"))
    cols = FLOW_COLS + FEATURES + ["src_ip", "dst_ip"]
    if manifest is not None:
        out = label_flows(out, manifest)
        cols += ["attack_type", "label"]
    return out.select(*cols)
