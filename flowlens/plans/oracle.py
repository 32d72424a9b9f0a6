"""DuckDB SQL for the correctness oracle.

The chain mirrors the Spark operators but is written independently where it
matters: flows are split by a recursive CTE that walks each key packet by
packet (the sequential semantics), not by islands and a fold. Aggregate,
feature and scoring formulas reuse the same SQL text as the Spark side.
"""

from __future__ import annotations

from ..operators.assemble import close_reason_sqls
from ..operators.features import _PACKET_EXPRS, AGG_EXPRS, FEATURE_EXPRS, agg_sql
from ..operators.scoring import (EMIT_ORDER, column_profile, context_sql, d2_sql, energy_sql,
                                 gate_sqls, routine_sql, anomaly_sql, verdict_sqls)
from ..schema import FEATURES, KEY_COLS
from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS, FlowConfig, Thresholds
from ..sources.fixtures import manifest_sql, packets_sql

K = ", ".join(KEY_COLS)


def _on(a: str, b: str, cols: list[str]) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)


def packets_ctes() -> list[str]:
    return [f"packets AS ({packets_sql('duckdb')})"]


def keyed_ctes() -> list[str]:
    return packets_ctes() + ["""keyed AS (
  SELECT seq, capture_id, ts_us, length, header_len, tcp_flags, proto, fwd,
    CASE WHEN fwd THEN s_ip ELSE d_ip END AS a_ip, CASE WHEN fwd THEN s_port ELSE d_port END AS a_port,
    CASE WHEN fwd THEN d_ip ELSE s_ip END AS b_ip, CASE WHEN fwd THEN d_port ELSE s_port END AS b_port,
    CASE WHEN (tcp_flags & 1) <> 0 THEN 1 ELSE 0 END AS fin_bit,
    CASE WHEN (tcp_flags & 4) <> 0 THEN 1 ELSE 0 END AS rst_bit
  FROM (SELECT seq, COALESCE(capture_id, '') AS capture_id, ts_us, length, header_len,
          COALESCE(tcp_flags, 0) AS tcp_flags, CAST(COALESCE(proto, 0) AS INTEGER) AS proto,
          s_ip, s_port, d_ip, d_port, (s_ip < d_ip OR (s_ip = d_ip AND s_port <= d_port)) AS fwd
        FROM (SELECT *, COALESCE(src_ip, '') AS s_ip, CAST(COALESCE(src_port, 0) AS INTEGER) AS s_port,
                 COALESCE(dst_ip, '') AS d_ip, CAST(COALESCE(dst_port, 0) AS INTEGER) AS d_port
              FROM packets) t0) t1)"""]


def walk_ctes(clock: str = "key", cfg: FlowConfig = DEFAULT_FLOW) -> list[str]:
    """Recursive packet-by-packet flow split per canonical key."""
    idle, active = cfg.idle_us, cfg.active_us
    prev = ", lag(ts_us) OVER (PARTITION BY capture_id ORDER BY ts_us, seq) AS prev_cap" if clock == "capture" else ""
    ref = "prev_cap" if clock == "capture" else "ts_us"
    own_first = "FALSE"
    own_step = f"(ts_us - (CASE WHEN nw THEN ts_us ELSE pf END) >= {active})" if clock == "capture" else "FALSE"
    return keyed_ctes() + [
        f"kn AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts_us, seq) AS rn{prev} FROM keyed)",
        f"""walk AS (
  SELECT {K}, rn, seq, ts_us AS f, ts_us AS l, fin_bit AS c,
         ({own_first} OR (proto = 6 AND (rst_bit = 1 OR fin_bit >= 2))) AS closed, CAST(1 AS BIGINT) AS flow_no
  FROM kn WHERE rn = 1
  UNION ALL
  SELECT {K}, rn, seq, CASE WHEN nw THEN ts_us ELSE pf END, ts_us,
         CASE WHEN nw THEN 0 ELSE pc END + fin_bit,
         ({own_step} OR (proto = 6 AND (rst_bit = 1 OR (CASE WHEN nw THEN 0 ELSE pc END + fin_bit) >= 2))),
         pflow + CASE WHEN nw THEN 1 ELSE 0 END
  FROM (SELECT kn.*, walk.f AS pf, walk.c AS pc, walk.flow_no AS pflow,
          (walk.closed OR {ref} - walk.l >= {idle} OR {ref} - walk.f >= {active}) AS nw
        FROM walk JOIN kn ON {_on('kn', 'walk', KEY_COLS)} AND kn.rn = walk.rn + 1) x)""",
    ]


def flow_packet_ctes(clock: str = "key", cfg: FlowConfig = DEFAULT_FLOW) -> list[str]:
    """``fpg``: keyed packets with ``flow_no``, ``gap_all``, ``gap_dir``."""
    return walk_ctes(clock, cfg) + [
        f"fp AS (SELECT k.*, w.flow_no FROM keyed k JOIN walk w ON {_on('k', 'w', KEY_COLS + ['seq'])})",
        f"""fpg AS (SELECT *,
    CASE WHEN lag(flow_no) OVER wk = flow_no THEN ts_us - lag(ts_us) OVER wk END AS gap_all,
    CASE WHEN lag(flow_no) OVER wd = flow_no THEN ts_us - lag(ts_us) OVER wd END AS gap_dir
  FROM fp
  WINDOW wk AS (PARTITION BY {K} ORDER BY ts_us, seq), wd AS (PARTITION BY {K}, fwd ORDER BY ts_us, seq))""",
    ]


def flow_ctes(clock: str = "key", cfg: FlowConfig = DEFAULT_FLOW) -> list[str]:
    """``flows``: the labelled flows table (same columns as ``build_flows``)."""
    pe = ", ".join(f"{v} AS {k}" for k, v in _PACKET_EXPRS.items())
    ag = ",\n    ".join(f"{agg_sql(k)} AS {k}" for k in AGG_EXPRS)
    fe = ",\n    ".join(f"{v} AS {k}" for k, v in FEATURE_EXPRS.items())
    cr = close_reason_sqls(cfg, clock)
    feats = ", ".join(FEATURES)
    return flow_packet_ctes(clock, cfg) + [
        f"fagg AS (SELECT {K}, flow_no,\n    {ag}\n  FROM (SELECT *, {pe} FROM fpg) x GROUP BY {K}, flow_no)",
        f"ffeat AS (SELECT {K}, flow_no, first_us, last_us,\n    {fe}\n  FROM fagg)",
        "cend AS (SELECT capture_id, max(ts_us) AS capture_end_us FROM keyed GROUP BY capture_id)",
        f"manifest AS ({manifest_sql('packets')})",
        f"""flows AS (SELECT {K}, flow_no, first_us, last_us, {cr['emit_us']} AS emit_us,
    {cr['close_reason']} AS close_reason, {feats}, a_ip AS src_ip, b_ip AS dst_ip,
    COALESCE(m.attack_type, '') AS attack_type, CAST(COALESCE(m.label, 0) AS INTEGER) AS label
  FROM ffeat JOIN cend USING (capture_id) LEFT JOIN manifest m USING (capture_id))""",
    ]


def profile_cte(source: str = "flows", min_sd: float = 1e-6) -> str:
    cols = ", ".join(f"avg({f}) AS m__{f}, stddev_pop({f}) + {min_sd!r} AS s__{f}" for f in FEATURES)
    return f"prof AS (SELECT {cols} FROM {source} WHERE label IS NULL OR label = 0)"


def scored_ctes(clock: str = "key", cfg: FlowConfig = DEFAULT_FLOW,
                t: Thresholds = DEFAULT_THRESHOLDS, host_col: str = "src_ip") -> list[str]:
    """``scored``: flows with scores, host context, gate and verdict."""
    ref = column_profile("p.")
    order = ", ".join(EMIT_ORDER)
    L = cfg.sequence_len
    g = gate_sqls(t, cfg)
    v = verdict_sqls(t)
    return flow_ctes(clock, cfg) + [
        profile_cte(),
        f"sc1 AS (SELECT flows.*, sqrt({d2_sql(ref)}) AS dist, {energy_sql(ref)} AS energy FROM flows CROSS JOIN prof p)",
        f"sc2 AS (SELECT *, {routine_sql()} AS routine_score, {anomaly_sql()} AS anomaly_score FROM sc1)",
        f"""sc3 AS (SELECT *,
    CAST(least(row_number() OVER (PARTITION BY {host_col} ORDER BY {order}), {L}) AS INTEGER) AS history_len,
    count(dist) OVER w AS ctx_n, avg(dist) OVER w AS ctx_mean, stddev_pop(dist) OVER w AS ctx_sd
  FROM sc2 WINDOW w AS (PARTITION BY {host_col} ORDER BY {order} ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW))""",
        f"sc4 AS (SELECT *, {context_sql()} AS ctx_raw FROM sc3)",
        "sc5 AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in g.items()) + " FROM sc4)",
        "scored AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in v.items()) + " FROM sc5)",
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
