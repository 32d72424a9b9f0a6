"""interim snapshots of flows that are still open.

The live path re-scores an open flow when it reaches 2 packets, then every
6 more (8, 14, ...), unless that packet closed it. In batch this is the
running version of the per-flow aggregates: the same aggregate SQL with an
``OVER (... ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)`` frame, kept
only on the snapshot packets. The frame is per flow, and a flow never spans
more than the active timeout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, KEY_COLS
from ..settings import DEFAULT_FLOW, FlowConfig
from .features import _PACKET_EXPRS, AGG_EXPRS, FEATURE_EXPRS, agg_sql

RUNNING = (f"OVER (PARTITION BY {', '.join(KEY_COLS)}, flow_no ORDER BY ts_us, seq "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def snapshot_sql(cfg: FlowConfig = DEFAULT_FLOW, clock: str = "key") -> str:
    """Predicate over running aggregates: a snapshot packet of an open flow."""
    own = f" OR ts_us - first_us >= {cfg.active_us}" if clock == "capture" else ""
    closes = f"(proto = 6 AND (c_rst > 0 OR c_fin >= 2)){own}"
    return (f"n >= {cfg.interim_min_packets} AND (n - {cfg.interim_min_packets}) % {cfg.interim_step} = 0 "
            f"AND NOT ({closes})")


def interim_flows(flow_packets: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, clock: str = "key") -> DataFrame:
    """Packets with ``flow_no`` and gaps -> interim rows: key, ``flow_no``,
    ``packets`` (count so far), ``emit_us`` (the snapshot packet's time),
    ``final`` = false and the 52 features of the flow so far."""
    prepped = flow_packets.withColumns({k: F.expr(v) for k, v in _PACKET_EXPRS.items()})
    running = prepped.select(*KEY_COLS, "flow_no", "seq", "ts_us",
                             *[F.expr(agg_sql(k, RUNNING)).alias(k) for k in AGG_EXPRS])
    snaps = running.filter(F.expr(snapshot_sql(cfg, clock)))
    return snaps.select(*KEY_COLS, "flow_no", F.col("n").alias("packets"), F.col("ts_us").alias("emit_us"),
                        F.lit(False).alias("final"),
                        *[F.expr(v).alias(k) for k, v in FEATURE_EXPRS.items()])


def with_interim(finals: DataFrame, interim: DataFrame) -> DataFrame:
    """Q9 ``include_interim``: finals plus interim rows as one event stream."""
    f = finals.withColumn("final", F.lit(True)) if "final" not in finals.columns else finals
    return f.unionByName(interim, allowMissingColumns=True)


__all__ = ["interim_flows", "snapshot_sql", "with_interim", "FEATURES"]
