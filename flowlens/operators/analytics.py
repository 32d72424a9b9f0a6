"""Operations queries over a scored-events table.

An *events* table is a scored flows table (``score_flows``): one row per
emitted flow with ``emit_us`` (event time), ``src_ip``, ``dst_ip``,
``proto``, ``status``, ``severity``, ``reason``, ``threat_score`` and the
three barrier states. Every "last N" is an ordered limit on the total
emission order (TakeOrderedAndProject: per-partition top-N, then a merge),
never a global sort. Aggregates are partial/final hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import protocol_name, round_sql
from ..schema import KEY_COLS
from .scoring import EMIT_ORDER

STATUSES = ("NORMAL", "SUSPICIOUS", "ATTACK")
# fixed values: severity rank for the alert feed's minimum severity
SEVERITY_RANK = {"observe": 0, "suspicious": 1, "attack": 2}
# fixed values: features shown for the latest flow of a host, in order
HOST_KEY_FEATURES = ["total_packets", "total_bytes", "flow_duration", "flow_pkts_per_s",
                     "down_up_ratio", "syn_flag_count", "rst_flag_count", "pkt_len_mean"]


def _desc(cols: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in cols]


def event_id(df: DataFrame) -> Column:
    """Stable text id of an event: key, flow number and final flag."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in KEY_COLS + ["flow_no"]],
                       F.when(F.coalesce(F.col("final"), F.lit(True)) if "final" in df.columns else F.lit(True),
                              F.lit("f")).otherwise(F.lit("i")))


def _count_status(s: str) -> Column:
    return F.count_if(F.col("status") == s)


# -- A1 ---------------------------------------------------------------------
def status_summary(events: DataFrame) -> DataFrame:
    """Totals per status and attack rate (attacks / max(total, 1), 4 dp)."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        _count_status("NORMAL").alias("normal"),
        _count_status("SUSPICIOUS").alias("suspicious"),
        _count_status("ATTACK").alias("attacks"),
        F.count_if(~F.col("status").isin(*STATUSES) | F.col("status").isNull()).alias("unknown"),
    ).withColumn("attack_rate", F.expr(round_sql("attacks / greatest(total, 1)", 4)))


# -- A2 ---------------------------------------------------------------------
def recent_rate(events: DataFrame, as_of_us: int | Column, window_s: int = 60) -> DataFrame:
    """Flows emitted in the ``window_s`` seconds up to ``as_of_us``."""
    t = as_of_us if isinstance(as_of_us, Column) else F.lit(int(as_of_us))
    lo = t - F.lit(window_s * 1_000_000)
    return events.agg(F.count_if((F.col("emit_us") >= lo) & (F.col("emit_us") <= t)).alias("flows_last_window"))


def latest_emit(events: DataFrame) -> Column:
    """Scalar subquery: the last emission time (as-of default)."""
    return events.select(F.max("emit_us")).scalar()


# -- A3 / O3 ----------------------------------------------------------------
def by_protocol(events: DataFrame) -> DataFrame:
    return events.groupBy(protocol_name(F.col("proto")).alias("protocol")).agg(F.count(F.lit(1)).alias("flows"))


def protocol_mix(events: DataFrame, n: int = 6) -> DataFrame:
    return by_protocol(events).orderBy(F.col("flows").desc(), F.col("protocol")).limit(n)


# -- A4 ---------------------------------------------------------------------
def barrier_alerts(events: DataFrame) -> DataFrame:
    """ALERT count per barrier (unpivot of the three states)."""
    long = events.select(F.expr(
        "stack(3, 'routine_xgboost', routine_state, 'context_transformer', context_state, "
        "'zero_day_autoencoder', anomaly_state) AS (barrier, state)"))
    return long.groupBy("barrier").agg(F.count_if(F.col("state") == "ALERT").alias("alerts"))


# -- A5 / O1 ----------------------------------------------------------------
def by_source(events: DataFrame, host_col: str = "src_ip") -> DataFrame:
    return events.groupBy(F.coalesce(F.col(host_col), F.lit("unknown")).alias("ip")).agg(
        F.count(F.lit(1)).alias("total"),
        _count_status("ATTACK").alias("attacks"),
        _count_status("SUSPICIOUS").alias("suspicious"),
        F.max("emit_us").alias("last_seen_us"))


def top_sources(events: DataFrame, n: int = 10, host_col: str = "src_ip") -> DataFrame:
    """Top sources by (attacks, suspicious, total) desc, ip asc as tie-break."""
    return (by_source(events, host_col)
            .orderBy(F.col("attacks").desc(), F.col("suspicious").desc(), F.col("total").desc(), F.col("ip"))
            .limit(n))


# -- A6 ---------------------------------------------------------------------
def alert_feed(events: DataFrame, limit: int = 500, min_severity: str = "suspicious",
               host_col: str = "src_ip") -> DataFrame:
    """Last ``limit`` alerts; ``min_severity='attack'`` keeps attacks only."""
    rank = SEVERITY_RANK.get(min_severity, 1)
    allowed = ["ATTACK"] if rank >= 2 else ["ATTACK", "SUSPICIOUS"]
    action = F.col("action_type") if "action_type" in events.columns else F.lit("watch")
    out = (events.filter(F.col("status").isin(*allowed))
           .select(event_id(events).alias("id"), *EMIT_ORDER, "status", "severity",
                   F.coalesce(F.col(host_col), F.lit("unknown")).alias("src_ip"),
                   F.coalesce(F.col("dst_ip"), F.lit("unknown")).alias("dst_ip"),
                   protocol_name(F.col("proto")).alias("protocol"), "threat_score", "reason",
                   F.col(host_col).alias("flow_key"), action.alias("action")))
    return out.orderBy(*_desc(EMIT_ORDER)).limit(limit).drop(*[c for c in EMIT_ORDER if c != "emit_us"])


# -- A7 ---------------------------------------------------------------------
def host_history(events: DataFrame, host: str, limit: int = 100, host_col: str = "src_ip") -> DataFrame:
    """Last ``limit`` events of one host (drill-down)."""
    cols = [event_id(events).alias("id"), *EMIT_ORDER, "status", "threat_score", "routine_score",
            "context_score", "anomaly_score", "reason"]
    return (events.filter(F.col(host_col) == host).select(*cols)
            .orderBy(*_desc(EMIT_ORDER)).limit(limit)
            .drop(*[c for c in EMIT_ORDER if c != "emit_us"]))


def host_latest(events: DataFrame, host_col: str = "src_ip") -> DataFrame:
    """Eight key features of each host's latest flow (``max_by`` on emission order)."""
    order = F.struct(*[F.col(c) for c in EMIT_ORDER])
    return events.groupBy(F.col(host_col).alias("host")).agg(
        *[F.max_by(F.col(f), order).alias(f) for f in HOST_KEY_FEATURES])


# -- A8 ---------------------------------------------------------------------
def throughput(events: DataFrame, last: int = 60, fill_gaps: bool = False) -> DataFrame:
    """Per emission second: flows and attacks; the last ``last`` non-empty seconds.

    ``fill_gaps`` adds empty seconds between the first and last kept second.
    """
    per = (events.groupBy(F.floor(F.col("emit_us") / 1_000_000).cast("long").alias("t"))
           .agg(F.count(F.lit(1)).alias("count"), _count_status("ATTACK").alias("attacks")))
    top = per.orderBy(F.col("t").desc()).limit(last)
    if not fill_gaps:
        return top
    span = top.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    secs = span.select(F.explode(F.sequence("lo", "hi")).alias("t"))
    return (secs.join(top, "t", "left")
            .select("t", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("attacks", F.lit(0)).alias("attacks")))


# -- A9 ---------------------------------------------------------------------
def threat_timeline(events: DataFrame, n: int = 120) -> DataFrame:
    return (events.select(event_id(events).alias("id"), *EMIT_ORDER, "threat_score")
            .orderBy(*_desc(EMIT_ORDER)).limit(n)
            .drop(*[c for c in EMIT_ORDER if c != "emit_us"]))


# -- A10 --------------------------------------------------------------------
def status_by_minute(events: DataFrame) -> DataFrame:
    """Counts per emission minute and status (minutes with a counted status only)."""
    return (events.filter(F.col("status").isin(*STATUSES))
            .groupBy(F.floor(F.col("emit_us") / 60_000_000).cast("long").alias("minute"))
            .agg(_count_status("NORMAL").alias("normal"), _count_status("SUSPICIOUS").alias("suspicious"),
                 _count_status("ATTACK").alias("attacks")))


# -- A11 / A13 --------------------------------------------------------------
def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per label and their share of all rows."""
    w = Window.partitionBy()
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    # the window runs over the tiny per-label result, not over the input
    return (counts.withColumn("_all", F.sum("rows").over(w))
            .withColumn("share", F.expr(round_sql("rows / _all", 4))).drop("_all"))


def attack_ratio(df: DataFrame, label_col: str = "label") -> DataFrame:
    return (df.agg(F.avg(F.col(label_col).cast("double")).alias("_r"), F.count(F.lit(1)).alias("rows"))
            .select(F.expr(round_sql("_r", 4)).alias("attack_ratio"), "rows"))


def separation(events: DataFrame, label_col: str = "label") -> DataFrame:
    """Mean threat score per class."""
    return (events.groupBy(F.col(label_col).alias("label"))
            .agg(F.avg("threat_score").alias("_m"), F.count(F.lit(1)).alias("flows"))
            .select("label", F.expr(round_sql("_m", 4)).alias("mean_threat"), "flows"))


# -- P10 --------------------------------------------------------------------
def query_events(events: DataFrame, status: str | None = None, source: str | None = None,
                 limit: int = 100, host_col: str = "src_ip") -> DataFrame:
    """Filter by status / source, then the last ``limit`` events."""
    out = events
    if status and status != "all":
        out = out.filter(F.col("status") == status)
    if source:
        out = out.filter(F.col(host_col) == source)
    return (out.select(event_id(events).alias("id"), *EMIT_ORDER, "status", "severity", "threat_score",
                       F.col(host_col).alias("src_ip"), "dst_ip")
            .orderBy(*_desc(EMIT_ORDER)).limit(limit)
            .drop(*[c for c in EMIT_ORDER if c != "emit_us"]))


# -- P9 ---------------------------------------------------------------------
def filter_packets(packets: DataFrame, source_ip: str | None = None, protocol: str | None = None) -> DataFrame:
    """Packet predicate from protocol name (tcp/udp/icmp) and source host.

    Plain column predicates: pushed into the Parquet scan when the input is a table.
    """
    proto_num = {"icmp": 1, "tcp": 6, "udp": 17}
    out = packets
    if protocol and protocol.lower() in proto_num:
        out = out.filter(F.col("proto") == proto_num[protocol.lower()])
    if source_ip:
        out = out.filter(F.col("src_ip") == source_ip)
    return out


# -- P11 --------------------------------------------------------------------
def packet_row_features(packets: DataFrame) -> DataFrame:
    """Per capture: frame number (1-based, time order), ``first_us`` (time of
    its first packet) and seconds since the previous packet (0 for the first).

    One pass over ranges of time that hold equal shares of all packets; a null
    capture is one like others.
    """
    from .windows import positions

    placed = positions(packets, ["capture_id"], ["ts_us", "seq"], "_cap")
    return (placed.withColumnsRenamed({"_cap_no": "frame_number", "_cap_first": "first_us"})
            .withColumn("delta_us", F.coalesce(F.col("ts_us") - F.col("_cap_prev"), F.lit(0)).cast("long"))
            .withColumn("time_delta", F.col("delta_us") / 1e6).drop("_cap_prev"))
