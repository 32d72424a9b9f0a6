"""the 52 flow features from packets carrying a ``flow_no``.

Plan: two ``lag`` windows (per key, and per key and direction; both refine
the key partitioning, so no new exchange) give inter-arrival gaps, then one
``groupBy(key, flow_no)`` with conditional aggregates (partial + final hash
aggregate). Moments are exact BIGINT sums; each statistic is one double
formula over them, written once as SQL text and shared with the DuckDB
oracle, so both engines produce the same bits independent of row order.
Population std = sqrt(n*S2 - S1^2) / n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURES, KEY_COLS

# Per-packet helper columns (SQL over a packet row with ``fwd``, ``gap_all``, ``gap_dir``).
_PACKET_EXPRS = {
    "_len": "CAST(length AS BIGINT)",
    "_hdr": "CAST(COALESCE(header_len, 0) AS BIGINT)",
    "_flags": "CAST(COALESCE(tcp_flags, 0) AS BIGINT)",
}

# Per-flow aggregates; every sum is exact (BIGINT; squared gaps DECIMAL, as a gap has no bound). ``{w}`` follows every aggregate
# call: empty for GROUP BY, an OVER clause for running (interim) aggregates.
AGG_EXPRS: dict[str, str] = {
    "first_us": "MIN(ts_us){w}",
    "last_us": "MAX(ts_us){w}",
    "n": "CAST(COUNT(*){w} AS BIGINT)",
    "nf": "CAST(SUM(CASE WHEN fwd THEN 1 ELSE 0 END){w} AS BIGINT)",
    "bf": "CAST(SUM(CASE WHEN fwd THEN _len ELSE 0 END){w} AS BIGINT)",
    "bb": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE _len END){w} AS BIGINT)",
    "sf2": "CAST(SUM(CASE WHEN fwd THEN _len * _len ELSE 0 END){w} AS BIGINT)",
    "sb2": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE _len * _len END){w} AS BIGINT)",
    "fmax": "MAX(CASE WHEN fwd THEN _len END){w}",
    "fmin": "MIN(CASE WHEN fwd THEN _len END){w}",
    "bmax": "MAX(CASE WHEN fwd THEN NULL ELSE _len END){w}",
    "bmin": "MIN(CASE WHEN fwd THEN NULL ELSE _len END){w}",
    "amax": "MAX(_len){w}",
    "amin": "MIN(_len){w}",
    "ga_n": "CAST(COUNT(gap_all){w} AS BIGINT)",
    "ga_s": "CAST(SUM(gap_all){w} AS BIGINT)",
    "ga_s2": "CAST(SUM(CAST(gap_all AS DECIMAL(19,0)) * CAST(gap_all AS DECIMAL(19,0))){w} AS DECIMAL(38,0))",
    "ga_max": "MAX(gap_all){w}",
    "ga_min": "MIN(gap_all){w}",
    "gf_n": "CAST(COUNT(CASE WHEN fwd THEN gap_dir END){w} AS BIGINT)",
    "gf_s": "CAST(SUM(CASE WHEN fwd THEN gap_dir END){w} AS BIGINT)",
    "gf_s2": "CAST(SUM(CASE WHEN fwd THEN CAST(gap_dir AS DECIMAL(19,0)) * CAST(gap_dir AS DECIMAL(19,0)) END){w} AS DECIMAL(38,0))",
    "gf_max": "MAX(CASE WHEN fwd THEN gap_dir END){w}",
    "gf_min": "MIN(CASE WHEN fwd THEN gap_dir END){w}",
    "gb_n": "CAST(COUNT(CASE WHEN fwd THEN NULL ELSE gap_dir END){w} AS BIGINT)",
    "gb_s": "CAST(SUM(CASE WHEN fwd THEN NULL ELSE gap_dir END){w} AS BIGINT)",
    "gb_s2": "CAST(SUM(CASE WHEN fwd THEN NULL ELSE CAST(gap_dir AS DECIMAL(19,0)) * CAST(gap_dir AS DECIMAL(19,0)) END){w} AS DECIMAL(38,0))",
    "gb_max": "MAX(CASE WHEN fwd THEN NULL ELSE gap_dir END){w}",
    "gb_min": "MIN(CASE WHEN fwd THEN NULL ELSE gap_dir END){w}",
    "c_fin": "CAST(SUM(CASE WHEN (_flags & 1) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "c_syn": "CAST(SUM(CASE WHEN (_flags & 2) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "c_rst": "CAST(SUM(CASE WHEN (_flags & 4) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "c_psh": "CAST(SUM(CASE WHEN (_flags & 8) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "c_ack": "CAST(SUM(CASE WHEN (_flags & 16) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "c_urg": "CAST(SUM(CASE WHEN (_flags & 32) <> 0 THEN 1 ELSE 0 END){w} AS BIGINT)",
    "hf": "CAST(SUM(CASE WHEN fwd THEN _hdr ELSE 0 END){w} AS BIGINT)",
    "hb": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE _hdr END){w} AS BIGINT)",
}


def agg_sql(name: str, over: str = "") -> str:
    """Aggregate ``name`` as SQL; ``over`` (e.g. ``OVER w``) makes it a window aggregate."""
    return AGG_EXPRS[name].replace("{w}", f" {over}" if over else "")


def _std(n: str, s: str, s2: str) -> str:
    return (f"CASE WHEN {n} > 0 THEN sqrt(greatest(CAST({n} AS DOUBLE) * CAST({s2} AS DOUBLE)"
            f" - CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE), 0e0)) / {n} ELSE 0e0 END")


def _mean(n: str, s: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({s} AS DOUBLE) / {n} ELSE 0e0 END"


def _z(x: str) -> str:
    return f"CAST(COALESCE({x}, 0) AS DOUBLE)"


_DUR = "(CASE WHEN last_us > first_us THEN CAST(last_us - first_us AS DOUBLE) / 1e6 ELSE 1e-6 END)"
_NB = "(n - nf)"
_SEC = " / 1e6"

FEATURE_EXPRS: dict[str, str] = {
    "flow_duration": "CAST(greatest(last_us - first_us, 0) AS DOUBLE) / 1e6",
    "total_fwd_packets": "CAST(nf AS DOUBLE)",
    "total_bwd_packets": f"CAST({_NB} AS DOUBLE)",
    "total_packets": "CAST(n AS DOUBLE)",
    "total_fwd_bytes": "CAST(bf AS DOUBLE)",
    "total_bwd_bytes": "CAST(bb AS DOUBLE)",
    "total_bytes": "CAST(bf + bb AS DOUBLE)",
    "fwd_pkt_len_max": _z("fmax"),
    "fwd_pkt_len_min": _z("fmin"),
    "fwd_pkt_len_mean": _mean("nf", "bf"),
    "fwd_pkt_len_std": _std("nf", "bf", "sf2"),
    "bwd_pkt_len_max": _z("bmax"),
    "bwd_pkt_len_min": _z("bmin"),
    "bwd_pkt_len_mean": _mean(_NB, "bb"),
    "bwd_pkt_len_std": _std(_NB, "bb", "sb2"),
    "pkt_len_max": _z("amax"),
    "pkt_len_min": _z("amin"),
    "pkt_len_mean": _mean("n", "(bf + bb)"),
    "pkt_len_std": _std("n", "(bf + bb)", "(sf2 + sb2)"),
    "pkt_len_var": f"({_std('n', '(bf + bb)', '(sf2 + sb2)')}) * ({_std('n', '(bf + bb)', '(sf2 + sb2)')})",
    "flow_bytes_per_s": f"CAST(bf + bb AS DOUBLE) / {_DUR}",
    "flow_pkts_per_s": f"CAST(n AS DOUBLE) / {_DUR}",
    "fwd_pkts_per_s": f"CAST(nf AS DOUBLE) / {_DUR}",
    "bwd_pkts_per_s": f"CAST({_NB} AS DOUBLE) / {_DUR}",
    "down_up_ratio": f"CASE WHEN nf > 0 THEN CAST({_NB} AS DOUBLE) / nf ELSE 0e0 END",
    "flow_iat_mean": f"({_mean('ga_n', 'ga_s')}){_SEC}",
    "flow_iat_std": f"({_std('ga_n', 'ga_s', 'ga_s2')}){_SEC}",
    "flow_iat_max": f"{_z('ga_max')}{_SEC}",
    "flow_iat_min": f"{_z('ga_min')}{_SEC}",
    "fwd_iat_total": f"{_z('gf_s')}{_SEC}",
    "fwd_iat_mean": f"({_mean('gf_n', 'gf_s')}){_SEC}",
    "fwd_iat_std": f"({_std('gf_n', 'gf_s', 'gf_s2')}){_SEC}",
    "fwd_iat_max": f"{_z('gf_max')}{_SEC}",
    "fwd_iat_min": f"{_z('gf_min')}{_SEC}",
    "bwd_iat_total": f"{_z('gb_s')}{_SEC}",
    "bwd_iat_mean": f"({_mean('gb_n', 'gb_s')}){_SEC}",
    "bwd_iat_std": f"({_std('gb_n', 'gb_s', 'gb_s2')}){_SEC}",
    "bwd_iat_max": f"{_z('gb_max')}{_SEC}",
    "bwd_iat_min": f"{_z('gb_min')}{_SEC}",
    "fin_flag_count": "CAST(c_fin AS DOUBLE)",
    "syn_flag_count": "CAST(c_syn AS DOUBLE)",
    "rst_flag_count": "CAST(c_rst AS DOUBLE)",
    "psh_flag_count": "CAST(c_psh AS DOUBLE)",
    "ack_flag_count": "CAST(c_ack AS DOUBLE)",
    "urg_flag_count": "CAST(c_urg AS DOUBLE)",
    "fwd_header_len": "CAST(hf AS DOUBLE)",
    "bwd_header_len": "CAST(hb AS DOUBLE)",
    "avg_pkt_size": _mean("n", "(bf + bb)"),
    "fwd_seg_size_avg": _mean("nf", "bf"),
    "bwd_seg_size_avg": _mean(_NB, "bb"),
    "protocol": "CAST(proto AS DOUBLE)",
    "dst_port": "CAST(b_port AS DOUBLE)",
}
assert list(FEATURE_EXPRS) == FEATURES


def with_gaps(flow_packets: DataFrame) -> DataFrame:
    """W4 as windows, for packets that carry ``flow_no`` but no gaps yet
    (e.g. read back from storage). :func:`assign_flows` already emits them."""
    wk = Window.partitionBy(*KEY_COLS).orderBy("ts_us", "seq")
    wd = Window.partitionBy(*KEY_COLS, "fwd").orderBy("ts_us", "seq")

    def gap(w):
        return F.when(F.lag("flow_no").over(w) == F.col("flow_no"),
                      F.col("ts_us") - F.lag("ts_us").over(w))

    return flow_packets.withColumn("gap_all", gap(wk)).withColumn("gap_dir", gap(wd))


def flow_aggregates(flow_packets: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Exact per-flow moments (the inputs of :data:`FEATURE_EXPRS`)."""
    group = group_cols or (KEY_COLS + ["flow_no"])
    prepped = flow_packets.withColumns({k: F.expr(v) for k, v in _PACKET_EXPRS.items()})
    return prepped.groupBy(*group).agg(*[F.expr(agg_sql(k)).alias(k) for k in AGG_EXPRS])


def features_from_aggregates(aggs: DataFrame, keep: list[str]) -> DataFrame:
    return aggs.select(*[F.col(c) for c in keep],
                       *[F.expr(v).alias(k) for k, v in FEATURE_EXPRS.items()])


def flow_features(flow_packets: DataFrame) -> DataFrame:
    """Packets with ``flow_no`` -> one row per flow: key, ``flow_no``,
    ``first_us``, ``last_us`` and the 52 features."""
    if "gap_all" not in flow_packets.columns:
        flow_packets = with_gaps(flow_packets)
    aggs = flow_aggregates(flow_packets)
    return features_from_aggregates(aggs, KEY_COLS + ["flow_no", "first_us", "last_us"])
