"""Registered queries: a Spark builder and, where SQL can express it, the
DuckDB oracle SQL, side by side. Column names and types agree on both sides.

Every query reads the driver tables (``events`` -> ``packets``) in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import protocol_name, round_half_up, round_sql, with_flow_key, with_tcp_flags
from ..operators import analytics as A
from ..operators.assemble import assign_flows, min_packets_counts
from ..operators.profile import profile_table
from ..operators.scoring import EMIT_ORDER
from ..schema import FEATURES, KEY_COLS, TCP_FLAGS
from . import context as C
from .oracle import (K, flow_ctes, flow_packet_ctes, keyed_ctes, profile_cte, scored_ctes,
                     walk_ctes, with_ctes)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip().splitlines()[0])
        return fn
    return deco


def _r(col: str, d: int = 4) -> str:
    return f"{round_sql(col, d)} AS {col}"


def _rf(c, d: int = 4):
    return round_half_up(c, d).alias(c)


EVENT_ID_SQL = ("concat_ws('|', capture_id, a_ip, CAST(a_port AS VARCHAR), b_ip, CAST(b_port AS VARCHAR), "
                "CAST(proto AS VARCHAR), CAST(flow_no AS VARCHAR), 'f')")
PROTO_SQL = ("CASE WHEN proto = 1 THEN 'ICMP' WHEN proto = 6 THEN 'TCP' WHEN proto = 17 THEN 'UDP' "
             "ELSE CAST(proto AS VARCHAR) END")
ORDER_DESC = ", ".join(f"{c} DESC" for c in EMIT_ORDER)
ORDER_ASC = ", ".join(EMIT_ORDER)
KEYF = KEY_COLS + ["flow_no"]
KF = ", ".join(KEYF)


# == P1 / P2 ==================================================================
@register("packets_keyed", with_ctes(keyed_ctes(), f"""
SELECT seq, capture_id, a_ip, a_port, b_ip, b_port, proto, fwd,
  {', '.join(f"CAST(CASE WHEN (tcp_flags & {m}) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS {n}_bit" for n, m in TCP_FLAGS.items())}
FROM keyed"""))
def q_packets_keyed(spark, sf):
    """P1+P2: canonical flow key, direction and decoded TCP flag bits per packet."""
    p = with_tcp_flags(with_flow_key(C.packets(spark, sf)))
    return p.select("seq", F.coalesce("capture_id", F.lit("")).alias("capture_id"), "a_ip", "a_port", "b_ip",
                    "b_port", "proto", "fwd", *[f"{n}_bit" for n in TCP_FLAGS])


# == F1 / F2 ==================================================================
def _split_sql(clock: str) -> str:
    return with_ctes(walk_ctes(clock), f"""
SELECT {K}, flow_no, CAST(count(*) AS BIGINT) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us
FROM walk w JOIN keyed k USING ({K}, seq) GROUP BY {K}, flow_no""")


def _split(spark, sf, clock):
    fp = assign_flows(C.packets(spark, sf), clock=clock)
    return fp.groupBy(*KEYF).agg(F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"),
                                 F.max("ts_us").alias("last_us"))


@register("flow_split_key", _split_sql("key"))
def q_flow_split_key(spark, sf):
    """flows per canonical key, key clock (idle 15 s, active 120 s, TCP close)."""
    return _split(spark, sf, "key")


@register("flow_split_capture", _split_sql("capture"))
def q_flow_split_capture(spark, sf):
    """flows per canonical key, capture clock (reference expiry sweep)."""
    return _split(spark, sf, "capture")


# == F4 + P8 ==================================================================
@register("flow_features", with_ctes(flow_ctes("key"), f"""
SELECT {KF}, first_us, last_us, {', '.join(_r(f) for f in FEATURES)} FROM flows"""))
def q_flow_features(spark, sf):
    """F4+P8: the 52 features per flow, rounded to 4 places."""
    f = C.flows(spark, sf)
    return f.select(*KEYF, "first_us", "last_us", *[_rf(c) for c in FEATURES])


@register("flow_features_capture", with_ctes(flow_ctes("capture"), f"""
SELECT {KF}, first_us, last_us, {', '.join(_r(f) for f in FEATURES)} FROM flows"""))
def q_flow_features_capture(spark, sf):
    """the 52 features per flow under the capture clock."""
    f = C.flows(spark, sf, "capture")
    return f.select(*KEYF, "first_us", "last_us", *[_rf(c) for c in FEATURES])


# == F3 / F7 ==================================================================
@register("flow_close", with_ctes(flow_ctes("key"), f"SELECT {KF}, close_reason, emit_us FROM flows"))
def q_flow_close(spark, sf):
    """close reason (tcp_close/idle/active/flush) and emission time per flow."""
    return C.flows(spark, sf).select(*KEYF, "close_reason", "emit_us")


@register("flow_close_capture", with_ctes(flow_ctes("capture"), f"SELECT {KF}, close_reason, emit_us FROM flows"))
def q_flow_close_capture(spark, sf):
    """F3 under the capture clock (own-packet active close)."""
    return C.flows(spark, sf, "capture").select(*KEYF, "close_reason", "emit_us")


# == F5 =======================================================================
@register("min_packets", with_ctes(flow_ctes("key"), """
SELECT CAST(sum(CASE WHEN total_packets >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN total_packets < 2 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM flows"""))
def q_min_packets(spark, sf):
    """flows kept / skipped by a minimum of 2 packets."""
    return min_packets_counts(C.flows(spark, sf), 2)


# == J1 =======================================================================
@register("labelled_flows", with_ctes(flow_ctes("key"), f"SELECT {KF}, src_ip, dst_ip, attack_type, label FROM flows"))
def q_labelled_flows(spark, sf):
    """Label and attack type joined per capture from the manifest."""
    return C.flows(spark, sf).select(*KEYF, "src_ip", "dst_ip", "attack_type", "label")


# == A12 ======================================================================
@register("normal_profile", with_ctes(flow_ctes("key") + [profile_cte()], "SELECT feature, " + _r("mean") + ", " + _r("sd") + " FROM (UNPIVOT prof ON "
          + ", ".join(f"(m__{f}, s__{f}) AS '{f}'" for f in FEATURES) + " INTO NAME feature VALUE mean, sd) u"))
def q_normal_profile(spark, sf):
    """Mean and population std (+1e-6) per feature over normal flows."""
    t = profile_table(C.flows(spark, sf))
    return t.select("feature", _rf("mean"), _rf("sd"))


# == M1 / M2 ==================================================================
@register("surrogate_scores", with_ctes(scored_ctes(), f"""
SELECT {KF}, {_r('dist', 6)}, {_r('routine_score', 6)}, {_r('anomaly_score', 6)} FROM scored"""))
def q_surrogate_scores(spark, sf):
    """M1+M2: distance to the normal centroid, routine and anomaly surrogate scores."""
    e = C.events(spark, sf)
    return e.select(*KEYF, _rf("dist", 6), _rf("routine_score", 6), _rf("anomaly_score", 6))


# == W1 / M3 ==================================================================
@register("host_context", with_ctes(scored_ctes(), f"""
SELECT {KF}, src_ip, history_len, CAST(ctx_n AS BIGINT) AS ctx_n, {_r('ctx_raw', 6)},
       padded, needs_context, ready, {_r('context_score', 6)} FROM scored"""))
def q_host_context(spark, sf):
    """W1+M3: per-host history of 16 flows and the context surrogate with its gate."""
    e = C.events(spark, sf)
    return e.select(*KEYF, "src_ip", "history_len", F.col("ctx_n").cast("long").alias("ctx_n"),
                    _rf("ctx_raw", 6), "padded", "needs_context", "ready", _rf("context_score", 6))


# == M4-M7 ====================================================================
@register("verdicts", with_ctes(scored_ctes(), f"""
SELECT {KF}, status, severity, reason, threat_score, routine_state, context_state, anomaly_state FROM scored"""))
def q_verdicts(spark, sf):
    """M4-M7: status, severity, reason, threat score and barrier states per flow."""
    return C.events(spark, sf).select(*KEYF, "status", "severity", "reason", "threat_score",
                                      "routine_state", "context_state", "anomaly_state")


# == A1 =======================================================================
@register("status_summary", with_ctes(scored_ctes(), f"""
SELECT total, normal, suspicious, attacks, unknown, {round_sql('attacks / greatest(total, 1)', 4)} AS attack_rate FROM (
  SELECT CAST(count(*) AS BIGINT) AS total,
    CAST(sum(CASE WHEN status = 'NORMAL' THEN 1 ELSE 0 END) AS BIGINT) AS normal,
    CAST(sum(CASE WHEN status = 'SUSPICIOUS' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
    CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks,
    CAST(sum(CASE WHEN status NOT IN ('NORMAL', 'SUSPICIOUS', 'ATTACK') OR status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown
  FROM scored) s"""))
def q_status_summary(spark, sf):
    """A1: totals per status and attack rate."""
    return A.status_summary(C.events(spark, sf))


# == A2 =======================================================================
@register("recent_rate", with_ctes(scored_ctes(), """
SELECT CAST(sum(CASE WHEN emit_us >= t - 60000000 AND emit_us <= t THEN 1 ELSE 0 END) AS BIGINT) AS flows_last_window
FROM scored, (SELECT max(emit_us) AS t FROM scored) m"""))
def q_recent_rate(spark, sf):
    """A2: flows emitted in the last 60 s before the latest emission."""
    e = C.events(spark, sf)
    return A.recent_rate(e, A.latest_emit(e), 60)


# == A3 / O3 ==================================================================
@register("by_protocol", with_ctes(scored_ctes(), f"SELECT {PROTO_SQL} AS protocol, CAST(count(*) AS BIGINT) AS flows FROM scored GROUP BY 1"))
def q_by_protocol(spark, sf):
    """A3: flows per protocol name."""
    return A.by_protocol(C.events(spark, sf))


@register("protocol_mix", with_ctes(scored_ctes(), f"""
SELECT protocol, flows FROM (SELECT {PROTO_SQL} AS protocol, CAST(count(*) AS BIGINT) AS flows FROM scored GROUP BY 1) x
ORDER BY flows DESC, protocol LIMIT 6"""))
def q_protocol_mix(spark, sf):
    """O3: protocol mix, top 6."""
    return A.protocol_mix(C.events(spark, sf), 6)


# == A4 =======================================================================
@register("barrier_alerts", with_ctes(scored_ctes(), """
SELECT barrier, CAST(sum(CASE WHEN state = 'ALERT' THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM (
  SELECT 'routine_xgboost' AS barrier, routine_state AS state FROM scored
  UNION ALL SELECT 'context_transformer', context_state FROM scored
  UNION ALL SELECT 'zero_day_autoencoder', anomaly_state FROM scored) u GROUP BY barrier"""))
def q_barrier_alerts(spark, sf):
    """A4: ALERT count per barrier."""
    return A.barrier_alerts(C.events(spark, sf))


# == A5 / O1 ==================================================================
_BY_SOURCE = """SELECT COALESCE(src_ip, 'unknown') AS ip, CAST(count(*) AS BIGINT) AS total,
    CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks,
    CAST(sum(CASE WHEN status = 'SUSPICIOUS' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
    max(emit_us) AS last_seen_us FROM scored GROUP BY 1"""


@register("by_source", with_ctes(scored_ctes(), _BY_SOURCE))
def q_by_source(spark, sf):
    """A5: per-source totals, attacks, suspicious and last seen."""
    return A.by_source(C.events(spark, sf))


@register("top_sources", with_ctes(scored_ctes(), f"SELECT * FROM ({_BY_SOURCE}) s ORDER BY attacks DESC, suspicious DESC, total DESC, ip LIMIT 10"))
def q_top_sources(spark, sf):
    """O1: top-10 sources by attacks, suspicious, total."""
    return A.top_sources(C.events(spark, sf), 10)


# == A6 =======================================================================
@register("alert_feed", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, status, severity, COALESCE(src_ip, 'unknown') AS src_ip,
  COALESCE(dst_ip, 'unknown') AS dst_ip, {PROTO_SQL} AS protocol, threat_score, reason, src_ip AS flow_key,
  'watch' AS action
FROM scored WHERE status IN ('ATTACK', 'SUSPICIOUS') ORDER BY {ORDER_DESC} LIMIT 500"""))
def q_alert_feed(spark, sf):
    """The last 500 alerts (ATTACK / SUSPICIOUS)."""
    return A.alert_feed(C.events(spark, sf), 500, "suspicious")


@register("alert_feed_attacks", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, status, severity, COALESCE(src_ip, 'unknown') AS src_ip,
  COALESCE(dst_ip, 'unknown') AS dst_ip, {PROTO_SQL} AS protocol, threat_score, reason, src_ip AS flow_key,
  'watch' AS action
FROM scored WHERE status = 'ATTACK' ORDER BY {ORDER_DESC} LIMIT 500"""))
def q_alert_feed_attacks(spark, sf):
    """A6 with minimum severity 'attack'."""
    return A.alert_feed(C.events(spark, sf), 500, "attack")


# == A7 =======================================================================
HOST = "10.10.0.5"


@register("host_history", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, status, threat_score, routine_score, context_score, anomaly_score, reason
FROM scored WHERE src_ip = '{HOST}' ORDER BY {ORDER_DESC} LIMIT 100"""))
def q_host_history(spark, sf):
    """Drill-down, the last 100 events of host 10.10.0.5."""
    return A.host_history(C.events(spark, sf), HOST, 100)


@register("host_latest", with_ctes(scored_ctes(), f"""
SELECT src_ip AS host, {', '.join(f'arg_max({f}, struct_pack({", ".join(f"x{i} := {c}" for i, c in enumerate(EMIT_ORDER))})) AS {f}' for f in A.HOST_KEY_FEATURES)}
FROM scored GROUP BY src_ip"""))
def q_host_latest(spark, sf):
    """Eight key features of every host's latest flow."""
    return A.host_latest(C.events(spark, sf))


# == A8 =======================================================================
@register("throughput", with_ctes(scored_ctes(), """
SELECT t, count, attacks FROM (SELECT CAST(floor(emit_us / 1000000) AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS count,
  CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks FROM scored GROUP BY 1) x
ORDER BY t DESC LIMIT 60"""))
def q_throughput(spark, sf):
    """Flows and attacks per second, the last 60 non-empty seconds."""
    return A.throughput(C.events(spark, sf), 60)


# == A9 =======================================================================
@register("threat_timeline", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, threat_score FROM scored ORDER BY {ORDER_DESC} LIMIT 120"""))
def q_threat_timeline(spark, sf):
    """The last 120 threat scores."""
    return A.threat_timeline(C.events(spark, sf), 120)


# == A10 ======================================================================
@register("status_by_minute", with_ctes(scored_ctes(), """
SELECT CAST(floor(emit_us / 60000000) AS BIGINT) AS minute,
  CAST(sum(CASE WHEN status = 'NORMAL' THEN 1 ELSE 0 END) AS BIGINT) AS normal,
  CAST(sum(CASE WHEN status = 'SUSPICIOUS' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
  CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks
FROM scored WHERE status IN ('NORMAL', 'SUSPICIOUS', 'ATTACK') GROUP BY 1"""))
def q_status_by_minute(spark, sf):
    """A10: status counts per minute."""
    return A.status_by_minute(C.events(spark, sf))


# == A11 / A13 ================================================================
@register("label_counts", with_ctes(flow_ctes("key"), f"""
SELECT label, rows, {round_sql('rows / sum(rows) OVER ()', 4)} AS share FROM (
  SELECT label, CAST(count(*) AS BIGINT) AS rows FROM flows GROUP BY label) x"""))
def q_label_counts(spark, sf):
    """Flows per label and share."""
    return A.label_counts(C.flows(spark, sf))


@register("separation", with_ctes(scored_ctes(), f"""
SELECT label, {round_sql('avg(threat_score)', 4)} AS mean_threat, CAST(count(*) AS BIGINT) AS flows FROM scored GROUP BY label"""))
def q_separation(spark, sf):
    """Mean threat score per class (normal vs attack)."""
    return A.separation(C.events(spark, sf))


# == P10 ======================================================================
@register("query_events", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, status, severity, threat_score, src_ip, dst_ip
FROM scored WHERE status = 'SUSPICIOUS' ORDER BY {ORDER_DESC} LIMIT 100"""))
def q_query_events(spark, sf):
    """P10: the last 100 SUSPICIOUS events."""
    return A.query_events(C.events(spark, sf), status="SUSPICIOUS", limit=100)


# == P3 =======================================================================
@register("protocol_names", with_ctes(keyed_ctes(), f"""
SELECT proto, {PROTO_SQL} AS protocol, CAST(count(*) AS BIGINT) AS packets FROM keyed GROUP BY proto"""))
def q_protocol_names(spark, sf):
    """Protocol number -> name, with packet counts."""
    p = with_flow_key(C.packets(spark, sf))
    return p.groupBy("proto").agg(F.count(F.lit(1)).alias("packets")).withColumn(
        "protocol", protocol_name(F.col("proto"))).select("proto", "protocol", "packets")
