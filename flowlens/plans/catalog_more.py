"""Registered queries beyond the flow/scoring/analytics core: response,
data quality, dataset building, training support, scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import response as R
from ..operators.analytics import alert_feed, event_id
from ..operators.scoring import EMIT_ORDER
from ..operators.windows import global_rank
from ..schema import KEY_COLS
from ..settings import Policy
from . import context as C
from .catalog import EVENT_ID_SQL, KF, KEYF, ORDER_ASC, ORDER_DESC, PROTO_SQL, REGISTRY, register
from .oracle import scored_ctes, with_ctes

# Response policy of the registered queries: auto-block on, nothing enforced.
POLICY = Policy(auto_block=True, dry_run=True, block_threshold=5, block_duration_seconds=300)
DUR = POLICY.block_duration_seconds * 1_000_000
ALERT_SQL = "src_ip IS NOT NULL AND status IN ('ATTACK', 'SUSPICIOUS')"


def actions(spark, sf) -> DataFrame:
    return C.actions(spark, sf, POLICY)


def commands(acts: DataFrame) -> DataFrame:
    """Manual commands derived from the data: unblock the first two alerting
    sources 100 s after their first alert; block the quietest source at its
    first event."""
    first = (acts.filter(R.is_alert()).groupBy(F.col("src_ip").alias("ip"))
             .agg(F.min("emit_us").alias("t")).orderBy("t", "ip").limit(2)
             .select("ip", (F.col("t") + 100_000_000).alias("t_us"), F.lit("unblock").alias("command")))
    quiet = (acts.groupBy(F.col("src_ip").alias("ip"))
             .agg(F.count_if(R.is_alert()).alias("a"), F.min("emit_us").alias("t_us"))
             .orderBy("a", "ip").limit(1).select("ip", "t_us", F.lit("block").alias("command")))
    # three rows by construction: materialise them once instead of re-planning the chain
    rows = first.unionByName(quiet).collect()
    return acts.sparkSession.createDataFrame(rows, "ip string, t_us long, command string")


def _actions_ctes() -> list[str]:
    p = POLICY
    return scored_ctes() + [
        f"""act1 AS (SELECT *, CAST(sum(CASE WHEN {ALERT_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip
    ORDER BY {ORDER_ASC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS alert_count FROM scored)""",
        f"""act2 AS (SELECT *,
    CASE WHEN src_ip IS NULL THEN 'observe' WHEN NOT ({ALERT_SQL}) THEN 'observe'
         WHEN {str(p.auto_block).upper()} AND alert_count >= {p.block_threshold} THEN 'block' ELSE 'watch' END AS action_type,
    CASE WHEN src_ip IS NULL THEN '{R.MSG_NO_SOURCE}' WHEN NOT ({ALERT_SQL}) THEN '{R.MSG_BELOW}'
         WHEN {str(p.auto_block).upper()} AND alert_count >= {p.block_threshold} THEN concat('Block registered for ', src_ip, '.')
         ELSE concat(CAST(alert_count AS VARCHAR), ' alert(s) from source.') END AS action_message
  FROM act1)""",
        """bev AS (SELECT src_ip AS ip, emit_us AS t_us, alert_count AS n,
    concat(CAST(alert_count AS VARCHAR), ' alerts') AS reason, 0 AS kind FROM act2 WHERE action_type = 'block')""",
    ]


def _intervals_ctes() -> list[str]:
    return _actions_ctes() + [
        "b2 AS (SELECT *, lag(t_us) OVER (PARTITION BY ip ORDER BY t_us, n) AS prev FROM bev)",
        f"""b3 AS (SELECT *, sum(CASE WHEN prev IS NULL OR t_us - prev >= {DUR} THEN 1 ELSE 0 END)
    OVER (PARTITION BY ip ORDER BY t_us, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM b2)""",
        f"""intervals AS (SELECT ip, max(struct_pack(t := t_us, n := n, r := reason)).r AS reason, TRUE AS dry_run,
    min(t_us) AS blocked_us, CAST(max(t_us) + {DUR} AS BIGINT) AS expires_us, CAST(count(*) AS BIGINT) AS renewals
  FROM b3 GROUP BY ip, isl)""",
    ]


# == W5 / R1 ==================================================================
@register("alert_feed_actions", with_ctes(_actions_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, emit_us, status, severity, COALESCE(src_ip, 'unknown') AS src_ip,
  COALESCE(dst_ip, 'unknown') AS dst_ip, {PROTO_SQL} AS protocol, threat_score, reason, src_ip AS flow_key,
  action_type AS action
FROM act2 WHERE status IN ('ATTACK', 'SUSPICIOUS') ORDER BY {ORDER_DESC} LIMIT 500"""))
def q_alert_feed_actions(spark, sf):
    """A6 over the actions: the last 500 alerts with what was done about each, blocks among them."""
    return alert_feed(actions(spark, sf), 500, "suspicious")


@register("response_actions", with_ctes(_actions_ctes(), f"SELECT {KF}, alert_count, action_type, action_message FROM act2"))
def q_response_actions(spark, sf):
    """R1+W5: running alert count per source and the observe/watch/block action."""
    return actions(spark, sf).select(*KEYF, "alert_count", "action_type", "action_message")


# == R2 =======================================================================
@register("block_intervals", with_ctes(_intervals_ctes(), "SELECT * FROM intervals"))
def q_block_intervals(spark, sf):
    """R2: merged, renewing block intervals per source."""
    return C.block_intervals(spark, sf, POLICY)


@register("active_blocks", with_ctes(_intervals_ctes(), """
SELECT i.* FROM intervals i, (SELECT max(emit_us) AS t FROM scored) m WHERE i.blocked_us <= m.t AND m.t < i.expires_us"""))
def q_active_blocks(spark, sf):
    """R2: blocks in force at the latest emission time."""
    acts = actions(spark, sf)
    t = acts.agg(F.max("emit_us")).first()[0]
    return R.active_blocks(C.block_intervals(spark, sf, POLICY), t)


# == R3 =======================================================================
_CMD_CTES = [
    f"""afirst AS (SELECT src_ip AS ip, min(emit_us) AS t FROM act2 WHERE {ALERT_SQL} GROUP BY src_ip)""",
    """cmds AS (SELECT * FROM (SELECT ip, t + 100000000 AS t_us, 'unblock' AS command FROM afirst ORDER BY t, ip LIMIT 2) u
  UNION ALL SELECT * FROM (SELECT src_ip AS ip, min(emit_us) AS t_us, 'block' AS command FROM act2 GROUP BY src_ip
    ORDER BY sum(CASE WHEN """ + ALERT_SQL + """ THEN 1 ELSE 0 END), src_ip LIMIT 1) q)""",
    """ev AS (SELECT ip, t_us, n, reason, kind FROM bev
  UNION ALL SELECT ip, t_us, 0, 'manual', 0 FROM cmds WHERE command = 'block'
  UNION ALL SELECT ip, t_us, 0, NULL, 1 FROM cmds WHERE command = 'unblock')""",
    """e2 AS (SELECT *, max(CASE WHEN kind = 0 THEN t_us END) OVER w AS prev_b, max(CASE WHEN kind = 1 THEN t_us END) OVER w AS prev_u
  FROM ev WINDOW w AS (PARTITION BY ip ORDER BY t_us, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    f"""e3 AS (SELECT *, sum(CASE WHEN kind = 0 AND (prev_b IS NULL OR t_us - prev_b >= {DUR}
      OR (prev_u IS NOT NULL AND prev_u >= prev_b)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY ip ORDER BY t_us, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM e2)""",
    """e4 AS (SELECT ip, isl, min(CASE WHEN kind = 0 THEN t_us END) AS blocked_us, max(CASE WHEN kind = 0 THEN t_us END) AS last_b,
    min(CASE WHEN kind = 1 THEN t_us END) AS cut,
    max(CASE WHEN kind = 0 THEN struct_pack(t := t_us, n := n, r := reason) END).r AS reason,
    CAST(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS BIGINT) AS renewals
  FROM e3 WHERE isl > 0 GROUP BY ip, isl)""",
]


@register("block_commands", with_ctes(_actions_ctes() + _CMD_CTES, f"""
SELECT ip, reason, TRUE AS dry_run, blocked_us,
  CAST(CASE WHEN cut IS NOT NULL AND cut < last_b + {DUR} THEN cut ELSE last_b + {DUR} END AS BIGINT) AS expires_us, renewals
FROM e4"""))
def q_block_commands(spark, sf):
    """Block intervals with manual block / unblock commands folded in."""
    acts = actions(spark, sf)
    return R.block_intervals(acts, POLICY, commands(acts))


# == R4 =======================================================================
@register("block_fixed", with_ctes(_actions_ctes() + [
    "q AS (SELECT ip, t_us, n, reason, row_number() OVER (PARTITION BY ip ORDER BY t_us, n) AS rn FROM bev)",
    f"""chain AS (SELECT ip, rn, t_us, reason, t_us + {DUR} AS cur_end, TRUE AS starts FROM q WHERE rn = 1
  UNION ALL SELECT q.ip, q.rn, q.t_us, q.reason,
    CASE WHEN q.t_us >= c.cur_end THEN q.t_us + {DUR} ELSE c.cur_end END, q.t_us >= c.cur_end
  FROM chain c JOIN q ON q.ip = c.ip AND q.rn = c.rn + 1)"""],
    f"SELECT ip, reason, TRUE AS dry_run, t_us AS blocked_us, CAST(t_us + {DUR} AS BIGINT) AS expires_us FROM chain WHERE starts"))
def q_block_fixed(spark, sf):
    """Legacy non-renewing blocks (alerts during a block are ignored)."""
    return R.block_intervals_fixed(actions(spark, sf), POLICY)


# == J2 =======================================================================
@register("flag_blocked", with_ctes(_intervals_ctes(), f"""
SELECT {', '.join('s.' + c for c in KEYF)}, i.ip IS NOT NULL AS blocked
FROM scored s LEFT JOIN intervals i ON s.src_ip = i.ip AND i.blocked_us <= s.emit_us AND s.emit_us < i.expires_us"""))
def q_flag_blocked(spark, sf):
    """Was the event's source blocked at its emission time (interval join)."""
    acts = actions(spark, sf)
    return R.flag_blocked(acts, C.block_intervals(spark, sf, POLICY)).select(*KEYF, "blocked")


# =============================================================================
# F6 interim snapshots
# =============================================================================
from ..functions.scalar import round_half_up, round_sql  # noqa: E402
from ..operators.assemble import assign_flows  # noqa: E402
from ..operators.features import _PACKET_EXPRS, AGG_EXPRS, FEATURE_EXPRS, agg_sql  # noqa: E402
from ..operators.interim import interim_flows, snapshot_sql  # noqa: E402
from ..schema import FEATURES  # noqa: E402
from .oracle import K, flow_ctes, flow_packet_ctes  # noqa: E402

_RUN_DUCK = f"OVER (PARTITION BY {K}, flow_no ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _interim_sql(clock: str, identity: str = "flow_no") -> str:
    pe = ", ".join(f"{v} AS {k}" for k, v in _PACKET_EXPRS.items())
    ag = ", ".join(f"{agg_sql(k, _RUN_DUCK)} AS {k}" for k in AGG_EXPRS)
    feats = ", ".join(f"{round_sql(v)} AS {k}" for k, v in FEATURE_EXPRS.items())
    return with_ctes(flow_packet_ctes(clock) + [
        f"ir AS (SELECT {K}, flow_no, seq, ts_us, {ag} FROM (SELECT *, {pe} FROM fpg) x)"],
        f"SELECT {K}, {identity}, n AS packets, ts_us AS emit_us, FALSE AS final, {feats} FROM ir WHERE {snapshot_sql(clock=clock)}")


def _interim(spark, sf, clock):
    it = interim_flows(assign_flows(C.packets(spark, sf), clock=clock), clock=clock)
    return it.select(*KEYF, "packets", "emit_us", "final", *[round_half_up(f).alias(f) for f in FEATURES])


@register("interim_flows", _interim_sql("key"))
def q_interim_flows(spark, sf):
    """interim snapshots of open flows at packets 2, 8, 14, ..."""
    return _interim(spark, sf, "key")


@register("interim_flows_capture", _interim_sql("capture"))
def q_interim_flows_capture(spark, sf):
    """F6 under the capture clock."""
    return _interim(spark, sf, "capture")


# =============================================================================
# D1-D9 data quality on a dirty copy of the flow dataset
# =============================================================================
from ..operators import quality as Q  # noqa: E402

DIRTY_COLS = FEATURES + ["src_ip", "dst_ip", "attack_type", "label", "const_col"]
_DIRTY_CTE = f"""dirty AS (
  SELECT {', '.join(c for c in DIRTY_COLS)} FROM (
    SELECT {', '.join(f for f in FEATURES if f not in ('bwd_iat_min', 'flow_iat_std', 'flow_bytes_per_s'))},
      CASE WHEN total_bwd_packets = 0 THEN NULL ELSE bwd_iat_min END AS bwd_iat_min,
      CASE WHEN total_packets = 1 THEN NULL ELSE flow_iat_std END AS flow_iat_std,
      CASE WHEN flow_duration = 0 AND protocol = 1 THEN CAST('inf' AS DOUBLE) ELSE flow_bytes_per_s END AS flow_bytes_per_s,
      src_ip, dst_ip, attack_type, label, CAST(1.0 AS DOUBLE) AS const_col, close_reason
    FROM flows) b
  UNION ALL
  SELECT {', '.join(c for c in DIRTY_COLS)} FROM (
    SELECT {', '.join(f for f in FEATURES if f not in ('bwd_iat_min', 'flow_iat_std', 'flow_bytes_per_s'))},
      CASE WHEN total_bwd_packets = 0 THEN NULL ELSE bwd_iat_min END AS bwd_iat_min,
      CASE WHEN total_packets = 1 THEN NULL ELSE flow_iat_std END AS flow_iat_std,
      CASE WHEN flow_duration = 0 AND protocol = 1 THEN CAST('inf' AS DOUBLE) ELSE flow_bytes_per_s END AS flow_bytes_per_s,
      src_ip, dst_ip, attack_type, label, CAST(1.0 AS DOUBLE) AS const_col, close_reason
    FROM flows) d WHERE close_reason = 'tcp_close')"""


def dirty_flows(spark, sf) -> DataFrame:
    """Flow dataset with data-driven defects: nulls where a side has no gaps,
    +inf rate on zero-duration ICMP flows, a constant column, and a second
    copy of every TCP-closed flow."""
    f = C.flows(spark, sf)
    base = f.select(*FEATURES, "src_ip", "dst_ip", "attack_type", "label", "close_reason").withColumns({
        "bwd_iat_min": F.when(F.col("total_bwd_packets") == 0, F.lit(None)).otherwise(F.col("bwd_iat_min")),
        "flow_iat_std": F.when(F.col("total_packets") == 1, F.lit(None)).otherwise(F.col("flow_iat_std")),
        "flow_bytes_per_s": F.when((F.col("flow_duration") == 0) & (F.col("protocol") == 1),
                                   F.lit(float("inf"))).otherwise(F.col("flow_bytes_per_s")),
        "const_col": F.lit(1.0)})
    return base.unionByName(base.filter(F.col("close_reason") == "tcp_close")).select(*DIRTY_COLS)


# The flow schema of FIXTURES.md: what is not text or a whole number is double.
_DIRTY_TYPES = {"src_ip": "string", "dst_ip": "string", "attack_type": "string", "label": "int"}


def _dq(select: str) -> str:
    return with_ctes(flow_ctes("key") + [_DIRTY_CTE], select)


@register("dq_schema", _dq("SELECT s.*, r.rows FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{_DIRTY_TYPES.get(c, 'double')}')" for i, c in enumerate(DIRTY_COLS))
    + ") s(position, column_name, type), (SELECT CAST(count(*) AS BIGINT) AS rows FROM dirty) r"))
def q_dq_schema(spark, sf):
    """Column names, types and row count of the dirty dataset."""
    return Q.profile_schema(dirty_flows(spark, sf))


@register("dq_missing", _dq("SELECT column_name, CAST(missing AS BIGINT) AS missing, " + round_sql(
    "CASE WHEN _rows > 0 THEN missing * 100.0e0 / _rows ELSE 0e0 END", 4) + " AS missing_pct FROM (UNPIVOT (SELECT count(*) AS _rows, "
    + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS m__{c}" for c in DIRTY_COLS)
    + " FROM dirty) ON " + ", ".join(f"m__{c} AS '{c}'" for c in DIRTY_COLS) + " INTO NAME column_name VALUE missing) u"))
def q_dq_missing(spark, sf):
    """Missing values per column and percentage."""
    return Q.missing(dirty_flows(spark, sf))


@register("dq_duplicates", _dq("SELECT CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) x) AS BIGINT) AS duplicates"))
def q_dq_duplicates(spark, sf):
    """D3: duplicate rows (second and later copies)."""
    return Q.duplicates(dirty_flows(spark, sf))


def _describe_sql() -> str:
    nums = FEATURES + ["label", "const_col"]
    texts = ["src_ip", "dst_ip", "attack_type"]
    parts = []
    for c in nums:
        x = f"CAST({c} AS DOUBLE)"
        for stat, e in (("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                        ("min", f"min({x})"), ("max", f"max({x})"),
                        ("25%", f"quantile_cont({x}, 0.25) FILTER (WHERE NOT isnan({x}))"),
                        ("50%", f"quantile_cont({x}, 0.5) FILTER (WHERE NOT isnan({x}))"),
                        ("75%", f"quantile_cont({x}, 0.75) FILTER (WHERE NOT isnan({x}))")):
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, {round_sql(e, 4)} AS num, CAST(NULL AS VARCHAR) AS text FROM dirty")
    for c in texts:
        parts.append(f"SELECT '{c}', 'count', CAST(count({c}) AS DOUBLE), NULL FROM dirty")
        parts.append(f"SELECT '{c}', 'unique', CAST(count(DISTINCT {c}) AS DOUBLE), NULL FROM dirty")
        parts.append(f"SELECT '{c}', 'top', NULL, v FROM (SELECT {c} AS v, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1) t")
        parts.append(f"SELECT '{c}', 'freq', CAST(n AS DOUBLE), NULL FROM (SELECT {c} AS v, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1) t")
    return _dq("\nUNION ALL ".join(parts))


@register("dq_describe", _describe_sql())
def q_dq_describe(spark, sf):
    """Describe (count, mean, std, min, quartiles, max; top/freq for text)."""
    return Q.describe(dirty_flows(spark, sf))


@register("dq_cardinality", _dq(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM dirty" for c in DIRTY_COLS)))
def q_dq_cardinality(spark, sf):
    """Distinct values per column."""
    return Q.cardinality(dirty_flows(spark, sf))


@register("dq_infinities", _dq("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN abs({c}) = CAST('inf' AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS infinities FROM dirty"
    for c in FEATURES + ["const_col"]) + ") x WHERE infinities > 0"))
def q_dq_infinities(spark, sf):
    """Infinite values per column."""
    return Q.infinities(dirty_flows(spark, sf))


@register("dq_constant_columns", _dq("SELECT column_name FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d FROM dirty" for c in DIRTY_COLS) + ") x WHERE d = 1"))
def q_dq_constant_columns(spark, sf):
    """Constant columns."""
    return Q.constant_columns(dirty_flows(spark, sf))


def _corr_sql() -> str:
    nums = FEATURES + ["label", "const_col"]
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    sel = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r{j}" for j, (a, b) in enumerate(pairs))
    un = ", ".join(f"r{j}" for j in range(len(pairs)))
    names = " ".join(f"WHEN 'r{j}' THEN '{a}|{b}'" for j, (a, b) in enumerate(pairs))
    return _dq(f"""SELECT split_part(k, '|', 1) AS column_a, split_part(k, '|', 2) AS column_b, {round_sql('r', 3)} AS corr
FROM (SELECT CASE name {names} END AS k, r FROM (UNPIVOT (SELECT {sel} FROM dirty) ON {un} INTO NAME name VALUE r) u) x
WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) > 0.95""")


@register("dq_correlated_pairs", _corr_sql())
def q_dq_correlated_pairs(spark, sf):
    """Column pairs with |corr| > 0.95."""
    return Q.correlated_pairs(dirty_flows(spark, sf), 0.95)


@register("dq_dataset_gate", with_ctes(flow_ctes("key"), f"""
SELECT 'normal_share' AS check, {round_sql('normal / greatest(rows, 1)', 4)} AS value, normal / greatest(rows, 1) >= 0.6 AND normal / greatest(rows, 1) <= 0.8 AS passed FROM g
UNION ALL SELECT 'normal_flows', CAST(normal AS DOUBLE), normal >= 2000 FROM g
UNION ALL SELECT 'attack_flows', CAST(attack AS DOUBLE), attack >= 2000 FROM g
UNION ALL SELECT 'normal_distinct_ports', CAST(ports AS DOUBLE), ports >= 10 FROM g
UNION ALL SELECT 'normal_distinct_sizes', CAST(sizes AS DOUBLE), sizes >= 10 FROM g""".replace(
    "FROM g", "FROM (SELECT count(*) AS rows, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS normal, "
    "sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS attack, count(DISTINCT CASE WHEN label = 0 THEN dst_port END) AS ports, "
    "count(DISTINCT CASE WHEN label = 0 THEN round(avg_pkt_size, 0) END) AS sizes FROM flows) g")))
def q_dq_dataset_gate(spark, sf):
    """Dataset checklist (normal share, flows per class, normal diversity)."""
    return Q.dataset_gate(C.flows(spark, sf))


# =============================================================================
# U1, S6, M13, M14 dataset building
# =============================================================================
from ..operators import dataset as DS  # noqa: E402

ROW_ID_SQL = ("concat_ws('|', capture_id, a_ip, CAST(a_port AS VARCHAR), b_ip, CAST(b_port AS VARCHAR), "
              "CAST(proto AS VARCHAR), CAST(flow_no AS VARCHAR))")


def _row_id():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in KEYF])


@register("merge_flows", with_ctes(flow_ctes("key"), f"""
SELECT {KF}, label, attack_type, md5(concat('42:', {ROW_ID_SQL})) AS shuffle_key FROM (
  SELECT * FROM flows WHERE label = 0 UNION ALL SELECT * FROM flows WHERE label <> 0) u"""))
def q_merge_flows(spark, sf):
    """Merge per-class flow datasets, fill nulls, seeded shuffle key."""
    f = C.flows(spark, sf)
    m = DS.merge_flows([f.filter("label = 0"), f.filter("label <> 0")], 42, _row_id())
    return m.select(*KEYF, "label", "attack_type", "shuffle_key")


@register("replay_selection", with_ctes(flow_ctes("key"), f"""
SELECT {KF}, label, src_ip, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS replay_pos FROM (
  SELECT *, md5(concat('42:', {ROW_ID_SQL})) AS k FROM flows WHERE label = 1 ORDER BY k LIMIT 100) s"""))
def q_replay_selection(spark, sf):
    """Attack-profile replay selection, seeded shuffle, limit 100."""
    s = DS.select_profile(C.flows(spark, sf), "attack", 100, 42, _row_id())
    return s.select(*KEYF, "label", "src_ip", "replay_pos")


@register("stratified_split", with_ctes(flow_ctes("key"), f"""
SELECT {KF}, label, r <= floor(n * 0.2 + 0.5) AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', {ROW_ID_SQL}))) AS r,
         count(*) OVER (PARTITION BY label) AS n FROM flows) s"""))
def q_stratified_split(spark, sf):
    """Exact stratified 20 % test split by seeded md5 order."""
    return DS.stratified_split(C.flows(spark, sf), 0.2, 42, _row_id()).select(*KEYF, "label", "is_test")


@register("class_weights", with_ctes(flow_ctes("key"), """
SELECT negatives, positives, negatives / greatest(positives, 1) AS scale_pos_weight FROM (
  SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
         CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM flows) c"""))
def q_class_weights(spark, sf):
    """Class counts and scale_pos_weight = neg / max(pos, 1)."""
    return DS.class_weights(C.flows(spark, sf))


# =============================================================================
# W2 sequences (long form with oracle; array form rows-only)
# =============================================================================
from ..operators.sequences import build_sequences, sequence_members  # noqa: E402


@register("sequence_members", with_ctes(flow_ctes("key"), f"""
SELECT src_ip, CAST(start_pos / 4 AS BIGINT) AS seq_no, CAST(start_pos AS BIGINT) AS start_pos,
       CAST(slot AS INTEGER) AS slot, {KF} FROM (
  SELECT f.*, s.start_pos, CASE WHEN f.n < 16 THEN f.pos + 16 - f.n ELSE f.pos - s.start_pos END AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY {ORDER_ASC}) - 1 AS pos,
           count(*) OVER (PARTITION BY src_ip) AS n FROM flows) f
  JOIN (SELECT h, CAST(unnest(range(0, n, 4)) AS BIGINT) AS start_pos FROM
          (SELECT src_ip AS h, count(*) AS n FROM flows GROUP BY src_ip) c) s
    ON s.h = f.src_ip AND ((f.n < 16 AND s.start_pos = 0)
       OR (f.n >= 16 AND s.start_pos <= f.n - 16 AND s.start_pos <= f.pos AND f.pos < s.start_pos + 16))) z"""))
def q_sequence_members(spark, sf):
    """Flows per host window (length 16, stride 4, left-padded short hosts)."""
    m = sequence_members(C.flows(spark, sf), 16, 4, "src_ip")
    return m.select("src_ip", "seq_no", "start_pos", "slot", *KEYF)


def _sequence_ctes() -> list[str]:
    """``seq_rows``: every slot of every window, padding included."""
    members = REGISTRY["sequence_members"].sql
    cut = members.index("SELECT src_ip, CAST(start_pos / 4")
    vals = ", ".join(f"f.{c}" for c in FEATURES)
    slots = ", ".join(f"COALESCE(v.{c}, 0) AS {c}" for c in FEATURES)
    return [members[:cut].rstrip().removeprefix("WITH RECURSIVE "), f"sm AS ({members[cut:]})",
            f"""sv AS (SELECT sm.src_ip AS host, sm.seq_no, sm.start_pos, sm.slot, f.label, {vals}
  FROM sm JOIN flows f ON {' AND '.join(f'sm.{c} = f.{c}' for c in KEYF)})""",
            """sg AS (SELECT *, CAST(unnest(range(16)) AS INTEGER) AS slot FROM (
  SELECT host, seq_no, start_pos, max(label) AS label FROM sv GROUP BY 1, 2, 3) w)""",
            f"""seq_rows AS (SELECT g.*, {slots} FROM sg g LEFT JOIN sv v
  ON v.host = g.host AND v.seq_no = g.seq_no AND v.slot = g.slot)"""]


def _rounded_sql() -> str:
    return ", ".join(f"{round_sql(c)} AS {c}" for c in FEATURES)


def _slots(seqs: DataFrame, *keys: str) -> DataFrame:
    """Windows in long form: a row for each slot, the features rounded."""
    rows = seqs.select(*keys, "label", F.posexplode("window").alias("slot", "_row"))
    wide = rows.select(*keys, "label", "slot", *[F.col("_row")[i].alias(c) for i, c in enumerate(FEATURES)])
    return wide.select(*keys, "label", "slot", *[round_half_up(c).alias(c) for c in FEATURES])


@register("flow_sequences", with_ctes(_sequence_ctes(), f"""
SELECT host, seq_no, start_pos, label, slot, {_rounded_sql()} FROM seq_rows"""))
def q_flow_sequences(spark, sf):
    """The 16x52 training sequences, a row for each slot (host, seq_no, slot), padding included."""
    return _slots(build_sequences(C.flows(spark, sf), 16, 4, "src_ip"), "host", "seq_no", "start_pos")


# =============================================================================
# Legacy per-packet path: S7 / P11 / P6 / P6b / P7 / W3, and P5 / P12
# =============================================================================
from ..functions.scalar import align_features, binary_verdict, clean_packets, to_number  # noqa: E402
from ..functions.sql import register_functions  # noqa: E402
from ..operators.analytics import packet_row_features  # noqa: E402
from ..schema import LEGACY_FEATURES  # noqa: E402
from ..sources.legacy import align_packet_features, legacy_packets  # noqa: E402
from .oracle import keyed_ctes, packets_ctes  # noqa: E402


def _q(c: str) -> str:
    return '"' + c + '"'


def _us_sql(us: str, sep: str) -> str:
    return f"concat(CAST(({us}) // 1000000 AS VARCHAR), {sep}, lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0'))"


_LEGACY_CTES = packets_ctes() + [
    """pr AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, seq) AS frame_number,
    COALESCE(ts_us - lag(ts_us) OVER (PARTITION BY capture_id ORDER BY ts_us, seq), 0) AS delta_us,
    min(ts_us) OVER (PARTITION BY capture_id) AS t0 FROM packets)""",
    f"""legacy AS (SELECT capture_id, seq,
    CAST(frame_number AS VARCHAR) AS "frame.number",
    {_us_sql('ts_us - t0', "'.'")} AS "frame.time_relative",
    CAST(length AS VARCHAR) AS "frame.len",
    {_us_sql('delta_us', "CASE WHEN frame_number % 3 = 0 THEN ',' ELSE '.' END")} AS "frame.time_delta",
    CAST(proto AS VARCHAR) AS "ip.proto",
    CASE WHEN proto = 6 THEN CAST(src_port AS VARCHAR) END AS "tcp.srcport",
    CASE WHEN proto = 6 THEN CAST(dst_port AS VARCHAR) END AS "tcp.dstport",
    CASE WHEN proto = 17 THEN CAST(src_port AS VARCHAR) END AS "udp.srcport",
    CASE WHEN proto = 17 THEN CAST(dst_port AS VARCHAR) END AS "udp.dstport",
    CASE WHEN proto = 6 AND frame_number % 5 <> 0 THEN concat('0x', lower(hex(tcp_flags))) END AS "tcp.flags",
    CASE WHEN proto = 1 THEN '8' END AS "icmp.type",
    CASE WHEN proto = 1 THEN CAST(frame_number AS VARCHAR) END AS "icmp.seq",
    CASE WHEN proto = 6 THEN '0' END AS "mqtt.msgtype",
    CASE WHEN capture_id = 'normal' THEN '0' ELSE '1' END AS label
  FROM pr)""",
]


def _to_number_sql(c: str) -> str:
    t = f"trim({c})"
    low = f"lower({t})"
    v = (f"CASE WHEN {c} IS NULL OR {t} = '' OR {low} IN ('nan', 'none', 'null') THEN 0e0 "
         f"WHEN starts_with({low}, '0x') THEN COALESCE(CASE WHEN regexp_full_match(substr({low}, 3), '[0-9a-f]+') "
         f"THEN CAST(TRY_CAST({low} AS BIGINT) AS DOUBLE) END, 0e0) "
         f"ELSE TRY_CAST(replace({t}, ',', '.') AS DOUBLE) END")
    return f"(CASE WHEN ({v}) IS NULL OR isnan({v}) OR isinf({v}) THEN 0e0 ELSE ({v}) END)"


def _legacy(spark, sf):
    return legacy_packets(C.packets(spark, sf))


@register("legacy_packets", with_ctes(_LEGACY_CTES, "SELECT * FROM legacy"))
def q_legacy_packets(spark, sf):
    """S7+P11: legacy per-frame text table (frame number, relative time, delta, ports, hex flags)."""
    return _legacy(spark, sf)


@register("packet_row_features", with_ctes(_LEGACY_CTES, f"""
SELECT capture_id, seq, CAST(frame_number AS BIGINT) AS frame_number, CAST(delta_us AS BIGINT) AS delta_us,
  {round_sql('delta_us / 1e6', 6)} AS time_delta FROM pr"""))
def q_packet_row_features(spark, sf):
    """Frame number and seconds since the previous packet, per capture."""
    r = packet_row_features(C.packets(spark, sf))
    return r.select("capture_id", "seq", "frame_number", "delta_us", round_half_up("time_delta", 6).alias("time_delta"))


@register("legacy_to_number", with_ctes(_LEGACY_CTES, "SELECT capture_id, seq, " + ", ".join(
    f"{_to_number_sql(_q(c))} AS {_q(c)}" for c in LEGACY_FEATURES + ["label"]) + " FROM legacy"))
def q_legacy_to_number(spark, sf):
    """Lenient numeric coercion (blank/nan -> 0, 0x hex, comma decimals)."""
    lg = _legacy(spark, sf)
    return lg.select("capture_id", "seq", *[to_number(F.col(f"`{c}`")).alias(c) for c in LEGACY_FEATURES + ["label"]])


def _seq_mode_sql(c: str) -> str:
    if c == "tcp.flags":
        inner = f"COALESCE({_q(c)}, '0')"
        return (f"CASE WHEN starts_with({inner}, '0x') AND regexp_full_match(substr({inner}, 3), '[0-9a-fA-F]+') "
                f"THEN CAST(TRY_CAST(concat('0x', lower(substr({inner}, 3))) AS BIGINT) AS DOUBLE) ELSE 0e0 END")
    v = f"TRY_CAST({_q(c)} AS DOUBLE)"
    return f"(CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN 0e0 ELSE {v} END)"


@register("sql_functions", with_ctes(_LEGACY_CTES, f"""
SELECT {PROTO_SQL} AS protocol, CAST(count(*) AS BIGINT) AS packets, CAST(sum({_to_number_sql(_q("tcp.flags"))}) AS BIGINT) AS flags,
  {round_sql("max(" + _to_number_sql(_q("frame.time_delta")) + ")", 6)} AS longest
FROM legacy JOIN packets USING (capture_id, seq) GROUP BY 1"""))
def q_sql_functions(spark, sf):
    """P3 and P6 from SQL: ``protocol_name`` and ``text_number`` over the legacy text table."""
    register_functions(spark)
    return spark.sql("""
        SELECT protocol_name(`ip.proto`) AS protocol, count(*) AS packets, CAST(sum(text_number(`tcp.flags`)) AS BIGINT) AS flags,
          floor(max(text_number(`frame.time_delta`)) * 1e6 + 0.5) / 1e6 AS longest
        FROM {legacy} GROUP BY protocol_name(`ip.proto`)""", legacy=_legacy(spark, sf))


@register("legacy_clean_sequence", with_ctes(_LEGACY_CTES, "SELECT " + ", ".join(
    f"{_seq_mode_sql(c)} AS {_q(c)}" for c in LEGACY_FEATURES) + ", CAST(label AS INTEGER) AS label FROM legacy"))
def q_legacy_clean_sequence(spark, sf):
    """Legacy sequence-builder cleaning (hex-or-0 flags, numeric-or-0 columns)."""
    lg = _legacy(spark, sf).select(*[F.col(f"`{c}`") for c in LEGACY_FEATURES], "label")
    return clean_packets(lg, "sequence")


@register("legacy_aligned", with_ctes(_LEGACY_CTES, "SELECT capture_id, seq, " + ", ".join(
    (f"{_to_number_sql(_q(c))} AS {_q(c)}" if c not in ("icmp.seq", "mqtt.msgtype") else f"0e0 AS {_q(c)}")
    for c in LEGACY_FEATURES) + " FROM legacy"))
def q_legacy_aligned(spark, sf):
    """Align a frame table missing two columns to the legacy feature order (missing -> 0)."""
    lg = _legacy(spark, sf)
    partial = lg.select("capture_id", "seq", *[to_number(F.col(f"`{c}`")).alias(c) for c in LEGACY_FEATURES
                                              if c not in ("icmp.seq", "mqtt.msgtype")])
    return align_packet_features(partial, LEGACY_FEATURES, keep=["capture_id", "seq"])


@register("legacy_sequences", with_ctes(_LEGACY_CTES, """
SELECT capture_id, CAST(start_pos / 10 AS BIGINT) AS seq_no, CAST(start_pos AS BIGINT) AS start_pos,
       CAST(pos - start_pos AS INTEGER) AS slot, seq FROM (
  SELECT p.capture_id, p.seq, p.frame_number - 1 AS pos, s.start_pos FROM pr p
  JOIN (SELECT c, CAST(unnest(range(0, greatest(n - 50, 0), 10)) AS BIGINT) AS start_pos FROM
          (SELECT capture_id AS c, count(*) AS n FROM pr GROUP BY capture_id) g) s
    ON s.c = p.capture_id AND s.start_pos <= p.frame_number - 1 AND p.frame_number - 1 < s.start_pos + 50) z"""))
def q_legacy_sequences(spark, sf):
    """Legacy packet windows per capture (length 50, stride 10, last window dropped)."""
    p = C.packets(spark, sf)
    m = sequence_members(p, 50, 10, "capture_id", ["ts_us", "seq"], drop_last=True, pad_short=False, time_col="ts_us")
    return m.select("capture_id", "seq_no", "start_pos", "slot", "seq")


@register("align_features", with_ctes(flow_ctes("key"), f"""
SELECT {KF}, {', '.join((round_sql(f) if f in FEATURES[:10] else '0e0') + ' AS ' + f for f in FEATURES)} FROM flows"""))
def q_align_features(spark, sf):
    """P5: align a table holding the first 10 features to all 52 (missing -> 0)."""
    f = C.flows(spark, sf).select(*KEYF, *[round_half_up(c).alias(c) for c in FEATURES[:10]])
    return align_features(f, keep=KEYF)


@register("binary_verdict", with_ctes(scored_ctes(), f"""
SELECT {KF}, CASE WHEN routine_score > 0.55 THEN 1 ELSE 0 END AS pred,
  {round_sql('CASE WHEN routine_score > 0.55 THEN routine_score ELSE 1 - routine_score END', 6)} AS pred_score FROM scored"""))
def q_binary_verdict(spark, sf):
    """Binary cut at P(attack) > 0.55 with the chosen class's probability."""
    e = C.events(spark, sf).withColumn("attack_proba", F.col("routine_score"))
    b = binary_verdict(e, "attack_proba", 0.55)
    return b.select(*KEYF, "pred", round_half_up("pred_score", 6).alias("pred_score"))


# =============================================================================
# M11, M12, M15, M16 (oracle) and M8-M10, M17, M18, O2 (rows-only)
# =============================================================================
from ..operators import evaluation as EV  # noqa: E402
from ..operators import models as MD  # noqa: E402
from ..operators.boosting import train_boosted  # noqa: E402
from ..streaming.replay import run_to_table, work_dir  # noqa: E402


@register("anomaly_threshold", with_ctes(scored_ctes(), f"""
SELECT p, {round_sql('v', 6)} AS value FROM (
  SELECT 0.95 AS p, quantile_cont(anomaly_score, 0.95) AS v FROM scored WHERE label = 0
  UNION ALL SELECT 0.99, quantile_cont(anomaly_score, 0.99) FROM scored WHERE label = 0) q"""))
def q_anomaly_threshold(spark, sf):
    """p95 / p99 (linear) of the anomaly score on normal flows."""
    t = EV.fit_threshold(C.events(spark, sf), "anomaly_score")
    return t.select("p", round_half_up("value", 6).alias("value"))


@register("detection_rate", with_ctes(scored_ctes(), f"""
SELECT CAST(count(*) AS BIGINT) AS attacks, {round_sql('avg(CASE WHEN anomaly_score >= t THEN 1e0 ELSE 0e0 END)', 4)} AS detected_share,
       {round_sql('avg(anomaly_score)', 6)} AS mean_attack_score
FROM scored, (SELECT quantile_cont(anomaly_score, 0.99) AS t FROM scored WHERE label = 0) q WHERE label = 1"""))
def q_detection_rate(spark, sf):
    """Share of attacks at or above the normal p99 and their mean score."""
    e = C.events(spark, sf)
    thr = EV.fit_threshold(e, "anomaly_score", probs=(0.99,)).first()["value"]
    d = EV.detection_rate(e, "anomaly_score", thr)
    return d.select("attacks", round_half_up("detected_share", 4).alias("detected_share"),
                    round_half_up("mean_attack_score", 6).alias("mean_attack_score"))


def _scaled_sql(kind: str) -> str:
    if kind == "standard":
        stats = ", ".join(f"avg({f}) AS a_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1e0 ELSE stddev_pop({f}) END AS b_{f}" for f in FEATURES)
    else:
        stats = ", ".join(f"min({f}) AS a_{f}, CASE WHEN max({f}) - min({f}) = 0 THEN 1e0 ELSE max({f}) - min({f}) END AS b_{f}" for f in FEATURES)
    cols = ", ".join(f"{round_sql(f'({f} - st.a_{f}) / st.b_{f}', 4)} AS {f}" for f in FEATURES)
    return with_ctes(flow_ctes("key") + [f"st AS (SELECT {stats} FROM flows)"], f"SELECT {KF}, {cols} FROM flows, st")


def _scaled(spark, sf, kind):
    f = C.flows(spark, sf)
    s = EV.scale(f, FEATURES, kind)
    return s.select(*KEYF, *[round_half_up(c).alias(c) for c in FEATURES])


@register("standard_scaled", _scaled_sql("standard"))
def q_standard_scaled(spark, sf):
    """Standard scaling (mean, population std; zero variance -> 1)."""
    return _scaled(spark, sf, "standard")


@register("minmax_scaled", _scaled_sql("minmax"))
def q_minmax_scaled(spark, sf):
    """Min-max scaling (constant column -> 0)."""
    return _scaled(spark, sf, "minmax")


def _evaluate_sql() -> str:
    base = ("SELECT label AS y, CASE WHEN status IN ('ATTACK', 'SUSPICIOUS') THEN 1 ELSE 0 END AS p, "
            "threat_score AS s FROM scored")
    c = ("SELECT sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, "
         "sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp FROM ev")

    def div(a, b):
        return f"CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END"
    m = (f"SELECT *, {div('tp', 'tp + fp')} AS p1, {div('tp', 'tp + fn')} AS r1, {div('tn', 'tn + fn')} AS p0, "
         f"{div('tn', 'tn + fp')} AS r0, tp + fn AS s1, tn + fp AS s0, {div('tp + tn', 'tp + tn + fp + fn')} AS acc FROM c")
    f1 = "COALESCE(CASE WHEN {p} + {r} = 0 THEN NULL ELSE 2 * {p} * {r} / ({p} + {r}) END, 0e0)"
    m2 = f"SELECT *, {f1.format(p='p1', r='r1')} AS f1_1, {f1.format(p='p0', r='r0')} AS f1_0 FROM m"
    rows = {"tn": "tn", "fp": "fp", "fn": "fn", "tp": "tp", "precision_0": "COALESCE(p0, 0e0)",
            "recall_0": "COALESCE(r0, 0e0)", "f1_0": "f1_0", "support_0": "s0", "precision_1": "COALESCE(p1, 0e0)",
            "recall_1": "COALESCE(r1, 0e0)", "f1_1": "f1_1", "support_1": "s1", "accuracy": "COALESCE(acc, 0e0)",
            "macro_precision": "(COALESCE(p0, 0e0) + COALESCE(p1, 0e0)) / 2",
            "macro_recall": "(COALESCE(r0, 0e0) + COALESCE(r1, 0e0)) / 2", "macro_f1": "(f1_0 + f1_1) / 2",
            "weighted_precision": div("COALESCE(p0, 0e0) * s0 + COALESCE(p1, 0e0) * s1", "s0 + s1"),
            "weighted_recall": div("COALESCE(r0, 0e0) * s0 + COALESCE(r1, 0e0) * s1", "s0 + s1"),
            "weighted_f1": div("f1_0 * s0 + f1_1 * s1", "s0 + s1")}
    sel = " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM m2" for k, v in rows.items())
    auc = ("SELECT 'roc_auc', sum(np * (cn - nn + nn * 0.5)) / (sum(np) * sum(nn)) FROM ("
           "SELECT s, np, nn, sum(nn) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM ("
           "SELECT CAST(s AS DOUBLE) AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS np, "
           "sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS nn FROM ev GROUP BY 1) a) b")
    return with_ctes(scored_ctes() + [f"ev AS ({base})", f"c AS ({c})", f"m AS ({m})", f"m2 AS ({m2})"],
                     f"SELECT metric, {round_sql('value', 4)} AS value FROM ({sel} UNION ALL {auc}) z")


@register("evaluate_verdicts", _evaluate_sql())
def q_evaluate_verdicts(spark, sf):
    """Confusion matrix, per-class metrics and ROC AUC of the verdicts vs labels."""
    e = C.events(spark, sf).withColumn("pred", F.col("status").isin("ATTACK", "SUSPICIOUS").cast("int"))
    return EV.evaluate(e, "label", "pred", "threat_score")


def _train_test(spark, sf):
    return MD.holdout(C.flows(spark, sf), 0.2, 42, _row_id())


def _routine_model(spark, sf):
    """The routine GBT, fitted once per session and scale."""
    k = C._key(spark, sf, "routine-model")
    if k not in C._CACHE:
        train, _ = _train_test(spark, sf)
        C._CACHE[k] = MD.train_routine(train)
    return C._CACHE[k]


def _boosted_model(spark, sf):
    """The second-order trees, fitted once per session and scale (shared by M8, O2 and the saved detectors)."""
    k = C._key(spark, sf, "boosted-model")
    if k not in C._CACHE:
        train, _ = _train_test(spark, sf)
        C._CACHE[k] = train_boosted(train)
    return C._CACHE[k]


@register("train_routine")
def q_train_routine(spark, sf):
    """M8+M16: GBT routine classifier (400 trees, depth 7) on an 80/20 stratified split; hold-out metrics."""
    _, test = _train_test(spark, sf)
    scored = MD.routine_scores(_routine_model(spark, sf), test)
    scored = scored.withColumn("pred", (F.col("routine_score") >= 0.5).cast("int"))
    return EV.evaluate(scored, "label", "pred", "routine_score")


@register("train_boosted")
def q_train_boosted(spark, sf):
    """M8+M16: boosted trees with an L2 term, columns drawn for each tree (400 trees, depth 7); hold-out metrics."""
    _, test = _train_test(spark, sf)
    scored = MD.routine_scores(_boosted_model(spark, sf), test)
    scored = scored.withColumn("pred", (F.col("routine_score") >= 0.5).cast("int"))
    return EV.evaluate(scored, "label", "pred", "routine_score")


@register("feature_importances")
def q_feature_importances(spark, sf):
    """O2: top-12 feature importances of the boosted trees, by mean gain."""
    return MD.feature_importances(_boosted_model(spark, sf), 12)


@register("train_anomaly")
def q_train_anomaly(spark, sf):
    """M9+M11+M12: PCA(12) reconstruction-error detector fitted on normal flows; threshold p99; detection."""
    f = C.flows(spark, sf)
    model = MD.train_anomaly(f, 12, 0.99)
    errs = MD.reconstruction_error(f, model)
    return EV.detection_rate(errs, "anomaly_error", model.threshold).withColumn("threshold", F.lit(model.threshold))


@register("train_context")
def q_train_context(spark, sf):
    """M10+M16: sequence classifier (pooled features -> MLP) on an 80/20 split of the windows."""
    seqs = build_sequences(C.flows(spark, sf), 16, 4, "src_ip")
    rid = F.concat_ws("|", F.col("host"), F.col("seq_no").cast("string"))
    s = DS.stratified_split(seqs, 0.2, 42, rid)
    model = MD.train_context(s.filter(~F.col("is_test")))
    out = MD.context_scores(model, s.filter(F.col("is_test")))
    return EV.evaluate(out.withColumn("pred", F.col("prediction").cast("int")), "label", "pred", "context_score")


def _context_windows(spark, sf):
    seqs = build_sequences(C.flows(spark, sf), 16, 4, "src_ip")
    return DS.stratified_split(seqs, 0.2, 42, F.concat_ws("|", F.col("host"), F.col("seq_no").cast("string")))


def _context_model(spark, sf):
    """The attention network, fitted once per session and scale on the training windows."""
    k = C._key(spark, sf, "context-model")
    if k not in C._CACHE:
        C._CACHE[k] = MD.train_attention(_context_windows(spark, sf).filter(~F.col("is_test")))
    return C._CACHE[k]


@register("train_attention")
def q_train_attention(spark, sf):
    """Attention over the 16 flows of a window in their order; metrics on the held-out windows."""
    test = _context_windows(spark, sf).filter(F.col("is_test"))
    out = MD.attention_scores(_context_model(spark, sf), test)
    return EV.evaluate(out.withColumn("pred", (F.col("context_score") >= 0.5).cast("int")), "label", "pred", "context_score")


@register("train_autoencoder")
def q_train_autoencoder(spark, sf):
    """M9: non-linear bottleneck network on normal flows; its threshold and detection."""
    f = C.flows(spark, sf)
    model = MD.train_autoencoder(f)
    errs = MD.reconstruction_error(f, model)
    return EV.detection_rate(errs, "anomaly_error", model.threshold).withColumn("threshold", F.lit(model.threshold))


@register("train_forest")
def q_train_forest(spark, sf):
    """Legacy random forest (100 trees) on cleaned legacy frames, 70/30 stratified split."""
    lg = clean_packets(_legacy(spark, sf).drop("capture_id"), "forest")
    lg = lg.withColumn("_rid", F.col("`seq`").cast("string"))
    s = DS.stratified_split(lg, 0.3, 42, F.col("_rid"))
    feats = [c for c in LEGACY_FEATURES]
    safe = {c: c.replace(".", "_") for c in feats}
    s = s.select(*[F.col(f"`{c}`").alias(safe[c]) for c in feats], "label", "is_test")
    model = MD.train_forest(s.filter(~F.col("is_test")), list(safe.values()))
    out = model.transform(s.filter(F.col("is_test")))
    out = out.withColumn("forest_score", vector_to_array_col(out)).withColumn("pred", F.col("prediction").cast("int"))
    return EV.evaluate(out, "label", "pred", "forest_score")


def vector_to_array_col(df):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col("probability"))[1]


def _saved_detectors(spark, sf) -> str:
    """Folder of the session's boosted trees (400 of depth 7), and a network each for the anomaly and context barriers."""
    k = C._key(spark, sf, "detectors")
    if k not in C._CACHE:
        path = work_dir(spark, "detectors")
        f = C.flows(spark, sf)
        MD.save_detectors(spark, MD.Detectors(_boosted_model(spark, sf), MD.train_autoencoder(f), _context_model(spark, sf)), path)
        C._CACHE[k] = path
    return C._CACHE[k]


@register("detector_health")
def q_detector_health(spark, sf):
    """Per barrier, saved model or surrogate, for models trained on the flows."""
    return MD.load_detectors(spark, _saved_detectors(spark, sf))


@register("model_verdicts")
def q_model_verdicts(spark, sf):
    """M7: verdicts of the three saved models, read back."""
    e = MD.score_with_models(C.flows(spark, sf), C.profile(spark, sf),
                             MD.read_detectors(spark, _saved_detectors(spark, sf)))
    return e.select(*KEYF, "routine_score", "anomaly_score", "status", "severity", "threat_score")


# =============================================================================
# S2 / S3 / S4 / S5 file round trips (written under the shared checkpoint folder)
# =============================================================================
from ..sources import captures as CAP  # noqa: E402
from ..sources import files as FS  # noqa: E402


@register("flows_csv_roundtrip", with_ctes(flow_ctes("key"), "SELECT " + ", ".join(
    [round_sql(f) + f" AS {f}" for f in FEATURES] + ["src_ip", "dst_ip", "attack_type", "label"]) + " FROM flows"))
def q_flows_csv_roundtrip(spark, sf):
    """S3+S2: write the flow dataset as CSV (fixed column order), read it back with the schema."""
    path = os.path.join(work_dir(spark, "flows-csv"), "flows")
    FS.write_flows(C.flows(spark, sf), path, "csv")
    back = FS.read_flows(spark, path)
    return back.select(*[round_half_up(f).alias(f) for f in FEATURES], "src_ip", "dst_ip", "attack_type", "label")


_CAPTURES_SQL = with_ctes(packets_ctes(), """
SELECT capture_id, CAST(ROW_NUMBER() OVER (PARTITION BY capture_id ORDER BY ts_us, seq) AS BIGINT) AS position, ts_us,
  length, proto, src_ip, dst_ip, src_port, dst_port, header_len, tcp_flags
FROM packets""")


def _capture_files(spark, sf) -> str:
    k = C._key(spark, sf, "captures")
    if k not in C._CACHE:
        path = os.path.join(work_dir(spark, "captures"), "pcap")
        CAP.write_captures(C.packets(spark, sf), path)
        C._CACHE[k] = path
    return C._CACHE[k]


def _positions(back):
    return global_rank(back, ["capture_id"], ["ts_us", "seq"], "position").drop("seq", "wire_length")


@register("captures_roundtrip", _CAPTURES_SQL)
def q_captures_roundtrip(spark, sf):
    """Packets written as capture files, several for a capture, and decoded again in their order."""
    return _positions(CAP.read_captures(spark, _capture_files(spark, sf)))


@register("captures_split", _CAPTURES_SQL)
def q_captures_split(spark, sf):
    """The same files in byte ranges of 16 KiB, each of which finds its first record by itself; a task reads one or several."""
    return _positions(CAP.read_captures(spark, _capture_files(spark, sf), split_bytes=1 << 14))


@register("captures_stream", _CAPTURES_SQL)
def q_captures_stream(spark, sf):
    """S1 as a stream: the same files read by the streaming source into a table."""
    wd = work_dir(spark, "captures-stream")
    stream = CAP.stream_captures(spark, _capture_files(spark, sf))
    run_to_table(stream, os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
    return _positions(spark.read.parquet(os.path.join(wd, "out")))


@register("captures_filtered", with_ctes(packets_ctes(), """
SELECT capture_id, ts_us, length, proto, src_ip, dst_ip, src_port, dst_port FROM packets
WHERE proto = 6 AND src_ip IN ('10.10.0.5', '10.10.2.5') AND ts_us >= 60000000"""))
def q_captures_filtered(spark, sf):
    """P9 in the capture scan: protocol, hosts and time are tested on header bytes before a row is built."""
    rows = CAP.read_captures(spark, _capture_files(spark, sf))
    hosts = filter_packets(rows, protocol="tcp").filter(F.col("src_ip").isin("10.10.0.5", "10.10.2.5"))
    return hosts.filter(F.col("ts_us") >= 60_000_000).select(
        "capture_id", "ts_us", "length", "proto", "src_ip", "dst_ip", "src_port", "dst_port")


@register("sequences_csv_roundtrip", with_ctes(_sequence_ctes(), f"SELECT label, slot, {_rounded_sql()} FROM seq_rows"))
def q_sequences_csv_roundtrip(spark, sf):
    """Flattened 16x52 sequences written as CSV (832 columns + label) and read back."""
    path = os.path.join(work_dir(spark, "seq-csv"), "seqs")
    FS.write_sequences(build_sequences(C.flows(spark, sf), 16, 4, "src_ip"), path)
    back = FS.read_sequences(spark, path)
    return _slots(back)


@register("events_ndjson", with_ctes(scored_ctes(), f"""
SELECT {EVENT_ID_SQL} AS id, status, severity, threat_score, src_ip AS flow_key, history_len AS seq_length,
  CASE WHEN proto = 1 THEN 'ICMP' WHEN proto = 6 THEN 'TCP' WHEN proto = 17 THEN 'UDP' ELSE CAST(proto AS VARCHAR) END AS protocol
FROM scored"""))
def q_events_ndjson(spark, sf):
    """Export scored events as NDJSON documents; read back and flatten key fields."""
    path = os.path.join(work_dir(spark, "events-json"), "events")
    ev = C.events(spark, sf)
    FS.export_events(ev, path, event_id=event_id(ev))
    back = spark.read.json(path)
    return back.select("id", F.col("result.status").alias("status"), F.col("result.severity").alias("severity"),
                       F.col("result.threat_score").alias("threat_score"), F.col("result.flow_key").alias("flow_key"),
                       F.col("result.sequence.length").cast("int").alias("seq_length"),
                       F.col("metadata.protocol").alias("protocol"))


# =============================================================================
# P4 finite guard, P9 packet filter, X1 ad-hoc scoring of a partial table
# =============================================================================
from ..functions.scalar import finite  # noqa: E402
from ..operators.analytics import filter_packets  # noqa: E402
from ..operators.scoring import anomaly_sql, column_profile, d2_sql, energy_sql, routine_sql, score_table  # noqa: E402
from .oracle import profile_cte  # noqa: E402

_RAW_SQL = ("CASE capture_id WHEN 'portscan' THEN CAST('nan' AS DOUBLE) WHEN 'synflood' THEN CAST('inf' AS DOUBLE) "
            "WHEN 'udpflood' THEN CAST('-inf' AS DOUBLE) WHEN 'slowdos' THEN NULL ELSE CAST(length AS DOUBLE) END")


@register("finite_guard", with_ctes(packets_ctes(), f"""
SELECT seq, CASE WHEN ({_RAW_SQL}) IS NULL OR isnan({_RAW_SQL}) OR isinf({_RAW_SQL}) THEN 0e0 ELSE {_RAW_SQL} END AS value
FROM packets"""))
def q_finite_guard(spark, sf):
    """NaN / +-inf / null -> 0 (values made non-finite per attack capture)."""
    p = C.packets(spark, sf)
    raw = (F.when(F.col("capture_id") == "portscan", F.lit(float("nan")))
           .when(F.col("capture_id") == "synflood", F.lit(float("inf")))
           .when(F.col("capture_id") == "udpflood", F.lit(float("-inf")))
           .when(F.col("capture_id") == "slowdos", F.lit(None).cast("double"))
           .otherwise(F.col("length").cast("double")))
    return p.select("seq", finite(raw).alias("value"))


@register("filter_packets", with_ctes(packets_ctes(), "SELECT * FROM packets WHERE proto = 6 AND src_ip = '10.10.2.5'"))
def q_filter_packets(spark, sf):
    """Packet predicate from protocol name and source host (pushed into the scan)."""
    return filter_packets(C.packets(spark, sf), source_ip="10.10.2.5", protocol="tcp")


_X1_KEEP = FEATURES[:20]


def _x1_sql() -> str:
    ref = column_profile("p.")
    cols = ", ".join([f"{f}" if f in _X1_KEEP else f"0e0 AS {f}" for f in FEATURES])
    g = gate_sqls_default()
    v = verdict_sqls_default()
    return with_ctes(flow_ctes("key") + [
        profile_cte(),
        f"x0 AS (SELECT {KF}, {cols} FROM flows)",
        f"x1 AS (SELECT x0.*, sqrt({d2_sql(ref)}) AS dist, {energy_sql(ref)} AS energy FROM x0 CROSS JOIN prof p)",
        f"x2 AS (SELECT *, {routine_sql()} AS routine_score, {anomaly_sql()} AS anomaly_score, 1 AS history_len, "
        "CAST(NULL AS DOUBLE) AS ctx_raw FROM x1)",
        "x3 AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in g.items()) + " FROM x2)",
        "x4 AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in v.items()) + " FROM x3)"],
        f"SELECT {KF}, status, severity, threat_score, {round_sql('routine_score', 6)} AS routine_score, "
        f"{round_sql('anomaly_score', 6)} AS anomaly_score, context_state FROM x4")


def gate_sqls_default():
    from ..operators.scoring import gate_sqls
    from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS
    return gate_sqls(DEFAULT_THRESHOLDS, DEFAULT_FLOW)


def verdict_sqls_default():
    from ..operators.scoring import verdict_sqls
    from ..settings import DEFAULT_THRESHOLDS
    return verdict_sqls(DEFAULT_THRESHOLDS)


@register("score_table", _x1_sql())
def q_score_table(spark, sf):
    """Ad-hoc scoring of a table holding only 20 of the 52 features (missing -> 0)."""
    part = C.flows(spark, sf).select(*KEYF, *_X1_KEEP)
    s = score_table(part, C.profile(spark, sf), keep=KEYF)
    return s.select(*KEYF, "status", "severity", "threat_score", round_half_up("routine_score", 6).alias("routine_score"),
                    round_half_up("anomaly_score", 6).alias("anomaly_score"), "context_state")


# =============================================================================
# M15 (sequences): per-feature standardiser over all window rows, padding included
# =============================================================================
from ..operators.sequences import fit_sequence_standardizer  # noqa: E402


def _seq_std_sql() -> str:
    """Window membership from the W2 oracle; padding slots add zeros, so
    sums run over members and the divisor is windows x 16."""
    members = REGISTRY["sequence_members"].sql
    cut = members.index("SELECT src_ip, CAST(start_pos / 4")
    ctes, inner = members[:cut].rstrip(), members[cut:]
    sums = ", ".join(f"sum(f.{f}) AS s_{f}, sum(f.{f} * f.{f}) AS q_{f}" for f in FEATURES)
    return (ctes + f""",
sm AS ({inner}),
nw AS (SELECT count(*) * 16 AS n FROM (SELECT DISTINCT src_ip, seq_no FROM sm) w),
tot AS (SELECT {sums} FROM sm JOIN flows f USING ({KF}))
SELECT feature, {round_sql('s / n', 4)} AS mean, {round_sql('sqrt(greatest(q / n - (s / n) * (s / n), 0e0)) + 1e-6', 4)} AS sd
FROM (SELECT feature, s, q, nw.n FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature,
  unnest([{', '.join(f's_{f}' for f in FEATURES)}]) AS s, unnest([{', '.join(f'q_{f}' for f in FEATURES)}]) AS q
  FROM tot) u, nw) z""")


@register("sequence_standardizer", _seq_std_sql())
def q_sequence_standardizer(spark, sf):
    """Per-feature mean / std over all 16x52 window rows (padding rows included, Q16)."""
    st = fit_sequence_standardizer(build_sequences(C.flows(spark, sf), 16, 4, "src_ip"))
    return st.select("feature", round_half_up("mean").alias("mean"), round_half_up("sd").alias("sd"))
