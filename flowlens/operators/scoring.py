"""Detection: surrogate scorers, host context, verdict fusion.

Every formula is generated as SQL text by one builder and evaluated with
``F.expr`` in Spark; the DuckDB oracle evaluates the same text. In Spark the
fitted profile is inlined as exact double literals, so the whole scoring is a
single projection inside whole-stage codegen.

Host context (W1 + M3) needs only each flow's distance ``d`` to the normal
centroid, so the 16-row frame aggregates three numbers per row, not arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import align_features, round_sql
from ..schema import FEATURES
from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS, FlowConfig, Thresholds
from .profile import Profile
from .windows import sliding_frame

# fixed values: verdict reasons, in decision order
REASONS = {
    "ctx_full": "Transformer confirmed hostile flow-sequence context.",
    "ctx_early": "Transformer flagged the host on partial (early) context.",
    "both": "Routine classifier and anomaly detector both crossed attack policy.",
    "routine_attack": "Routine XGBoost barrier crossed attack threshold.",
    "anom_susp": "Flow is suspicious and outside normal reconstruction range.",
    "anom": "Autoencoder found an out-of-ordinary flow.",
    "routine_susp": "Routine XGBoost barrier marked the flow suspicious.",
    "none": "No model was available to score this flow.",
    "normal": "All available barriers are below policy thresholds.",
}
# fixed values: barrier names of the event document
BARRIERS = ["routine_xgboost", "context_transformer", "zero_day_autoencoder"]

# Emission order of flows (total): drives host history.
EMIT_ORDER = ["emit_us", "first_us", "capture_id", "a_ip", "a_port", "b_ip", "b_port", "proto", "flow_no"]


def _num(x: float) -> str:
    r = repr(float(x))
    return f"CAST('{r}' AS DOUBLE)" if r in ("inf", "-inf", "nan") else f"CAST({r} AS DOUBLE)"


def _sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-greatest(least({x}, 6e1), -6e1))))"


def literal_profile(p: Profile) -> Callable[[int, str], tuple[str, str]]:
    """Profile reference as literals (Spark)."""
    return lambda i, f: (_num(p.mean[i]), _num(p.sd[i]))


def column_profile(prefix: str = "p.") -> Callable[[int, str], tuple[str, str]]:
    """Profile reference as columns ``m__<f>``/``s__<f>`` (oracle SQL)."""
    return lambda i, f: (f"{prefix}m__{f}", f"{prefix}s__{f}")


def _z(i: int, f: str, ref) -> str:
    m, s = ref(i, f)
    return f"((CAST({f} AS DOUBLE) - {m}) / {s})"


def d2_sql(ref) -> str:
    """Mean squared z over the 52 features."""
    terms = " + ".join(f"{_z(i, f, ref)} * {_z(i, f, ref)}" for i, f in enumerate(FEATURES))
    return f"(({terms}) / {len(FEATURES)}e0)"


def energy_sql(ref) -> str:
    """Mean of max(|z| - 1, 0)^2 over the 52 features."""
    g = [f"greatest(abs({_z(i, f, ref)}) - 1e0, 0e0)" for i, f in enumerate(FEATURES)]
    terms = " + ".join(f"{x} * {x}" for x in g)
    return f"(({terms}) / {len(FEATURES)}e0)"


def routine_sql(d: str = "dist") -> str:
    """M1: sigmoid(1.6 (d - 2.2))."""
    return _sigmoid(f"1.6e0 * ({d} - 2.2e0)")


def anomaly_sql(energy: str = "energy") -> str:
    """M2: 0.5 tanh(energy / 6) + 1e-6."""
    return f"(tanh({energy} / 6e0) * 5e-1 + 1e-6)"


def context_sql(n: str = "ctx_n", mean: str = "ctx_mean", sd: str = "ctx_sd") -> str:
    """M3 over the frame's distances: drift, consistency, sigmoid; < 2 rows -> 0."""
    cons = f"greatest(least(1e0 - {sd} / ({mean} + 1e-6), 1e0), 0e0)"
    signal = f"({mean} * (6e-1 + 4e-1 * {cons}))"
    return f"(CASE WHEN {n} < 2 THEN 0e0 ELSE {_sigmoid(f'1.4e0 * ({signal} - 2.2e0)')} END)"


def gate_sqls(t: Thresholds, cfg: FlowConfig) -> dict[str, str]:
    """Context gate (Q18/Q26) over ``routine_score, anomaly_score, history_len``."""
    L, mc = cfg.sequence_len, cfg.min_context
    needs = (f"((routine_score IS NOT NULL AND routine_score >= {_num(t.xgb_suspicious)}) OR "
             f"(anomaly_score IS NOT NULL AND anomaly_score >= {_num(t.autoencoder)}))")
    early = f"({'TRUE' if cfg.pad_early else 'FALSE'} AND history_len >= {mc})"
    avail = f"({needs} AND (history_len >= {L} OR {early}))"
    return {
        "needs_context": needs,
        "padded": f"({needs} AND history_len < {L} AND {early})",
        "context_score": f"(CASE WHEN {avail} THEN ctx_raw END)",
        "ready": f"(history_len >= {L})",
    }


def verdict_sqls(t: Thresholds) -> dict[str, str]:
    """M4 status/severity/reason, M5 threat score, M6 barrier states."""
    xa = f"(routine_score IS NOT NULL AND routine_score >= {_num(t.xgb_attack)})"
    xs = f"(routine_score IS NOT NULL AND routine_score >= {_num(t.xgb_suspicious)})"
    an = f"(anomaly_score IS NOT NULL AND anomaly_score >= {_num(t.autoencoder)})"
    se = f"(context_score IS NOT NULL AND context_score >= {_num(t.transformer)})"
    branches = [
        (f"{se} AND NOT padded", "ATTACK", "critical", "ctx_full"),
        (f"{se} AND padded", "SUSPICIOUS", "high", "ctx_early"),
        (f"{xa} AND {an}", "ATTACK", "high", "both"),
        (xa, "ATTACK", "high", "routine_attack"),
        (f"{an} AND {xs}", "SUSPICIOUS", "medium", "anom_susp"),
        (an, "SUSPICIOUS", "medium", "anom"),
        (xs, "SUSPICIOUS", "medium", "routine_susp"),
        ("routine_score IS NULL AND anomaly_score IS NULL AND context_score IS NULL", "UNKNOWN", "low", "none"),
    ]

    def case(pos: int, default: str) -> str:
        whens = " ".join(f"WHEN {c} THEN '{(s, v, REASONS[r])[pos]}'" for c, s, v, r in branches)
        return f"(CASE {whens} ELSE '{default}' END)"

    def clip01(x: str) -> str:
        return f"greatest(least({x}, 1e0), 0e0)"

    thr2 = f"(greatest({_num(t.autoencoder)}, 1e-9) * 2e0)"
    cands = [f"CASE WHEN routine_score IS NULL THEN -1e0 ELSE {clip01('routine_score')} END",
             f"CASE WHEN context_score IS NULL THEN -1e0 ELSE {clip01('context_score')} END",
             f"CASE WHEN anomaly_score IS NULL THEN -1e0 ELSE {clip01(f'anomaly_score / {thr2}')} END"]
    threat = round_sql(f"greatest({', '.join(cands)}, 0e0)", 4)

    def state(score: str, thr: float, waiting: str | None = None) -> str:
        none = f"CASE WHEN {waiting} THEN 'WAITING' ELSE 'UNAVAILABLE' END" if waiting else "'UNAVAILABLE'"
        return f"(CASE WHEN {score} IS NULL THEN {none} WHEN {score} >= {_num(thr)} THEN 'ALERT' ELSE 'PASS' END)"

    return {
        "status": case(0, "NORMAL"),
        "severity": case(1, "low"),
        "reason": case(2, REASONS["normal"]),
        "threat_score": threat,
        "routine_state": state("routine_score", t.xgb_suspicious),
        "context_state": state("context_score", t.transformer, waiting="needs_context"),
        "anomaly_state": state("anomaly_score", t.autoencoder),
    }


# --- DataFrame operators ------------------------------------------------------

def score_distances(flows: DataFrame, profile: Profile) -> DataFrame:
    """Add ``dist`` (sqrt mean z^2) and ``energy`` from the 52 features."""
    ref = literal_profile(profile)
    return (flows.withColumn("dist", F.expr(f"sqrt({d2_sql(ref)})"))
                 .withColumn("energy", F.expr(energy_sql(ref))))


def score_routine(flows: DataFrame, profile: Profile) -> DataFrame:
    """M1 surrogate routine score."""
    df = flows if "dist" in flows.columns else score_distances(flows, profile)
    return df.withColumn("routine_score", F.expr(routine_sql()))


def score_anomaly(flows: DataFrame, profile: Profile) -> DataFrame:
    """M2 surrogate anomaly score."""
    df = flows if "energy" in flows.columns else score_distances(flows, profile)
    return df.withColumn("anomaly_score", F.expr(anomaly_sql()))


def with_host_context(scored: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, host_col: str = "src_ip",
                      order_cols: list[str] | None = None, bucket_us: int | None = None,
                      chunk_rows: int = 1 << 16) -> DataFrame:
    """W1 + M3: per host, over its last ``sequence_len`` flows in emission order,
    ``history_len`` (capped), frame count/mean/std of ``dist`` and ``ctx_raw``.

    The frame is evaluated by :func:`sliding_frame`, so a host with a large
    share of all flows is spread over buckets and row chunks.
    """
    return _ranked_context(scored, cfg, host_col, order_cols, bucket_us, chunk_rows).drop("_pos")


def _ranked_context(scored: DataFrame, cfg: FlowConfig, host_col: str, order_cols: list[str] | None = None,
                    bucket_us: int | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """:func:`with_host_context`, with ``_pos``, the flow's 1-based place among its host's flows."""
    order = order_cols or EMIT_ORDER
    L = cfg.sequence_len
    # a frame's statistics leave out rows whose features are all zero
    dist = F.col("dist")
    if all(f in scored.columns for f in FEATURES):
        dist = F.when(F.greatest(*[F.abs(F.col(f)) for f in FEATURES]) > 0, dist)
    out = sliding_frame(scored, [host_col], order, L,
                        {"ctx_n": F.count(dist), "ctx_mean": F.avg(dist), "ctx_sd": F.stddev_pop(dist)},
                        time_col=order[0], bucket_us=bucket_us, chunk_rows=chunk_rows, rank_col="_pos")
    return (out.withColumn("history_len", F.least(F.col("_pos"), F.lit(L)).cast("int"))
            .withColumn("ctx_raw", F.expr(context_sql())))


def with_verdict(df: DataFrame, t: Thresholds = DEFAULT_THRESHOLDS,
                 cfg: FlowConfig = DEFAULT_FLOW) -> DataFrame:
    """M4-M6 (+ context gate) over ``routine_score, anomaly_score, ctx_raw, history_len``."""
    g = gate_sqls(t, cfg)
    out = df.withColumns({k: F.expr(v) for k, v in g.items()})
    return out.withColumns({k: F.expr(v) for k, v in verdict_sqls(t).items()})


def score_flows(flows: DataFrame, profile: Profile, t: Thresholds = DEFAULT_THRESHOLDS,
                cfg: FlowConfig = DEFAULT_FLOW, host_col: str = "src_ip",
                routine: Callable[[DataFrame], DataFrame] | None = None,
                anomaly: Callable[[DataFrame], DataFrame] | None = None,
                context: Callable[[DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """M7: full three-barrier scoring of a flows table.

    ``routine`` / ``anomaly`` are scorers of trained models that add
    ``routine_score`` / ``anomaly_score``, ``context`` one that sets
    ``ctx_raw`` of the flows whose context gate is open; without one the
    barrier takes its surrogate (``models.score_with_models`` passes saved
    models).
    """
    s = score_distances(flows, profile)
    s = routine(s) if routine else score_routine(s, profile)
    s = anomaly(s) if anomaly else score_anomaly(s, profile)
    s = _ranked_context(s, cfg, host_col)
    if context:
        g = gate_sqls(t, cfg)
        s = context(s, F.expr(f"{g['needs_context']} AND ({g['ready']} OR {g['padded']})"))
    return with_verdict(s.drop("_pos"), t, cfg).drop("energy", "ctx_mean", "ctx_sd")


def score_table(df: DataFrame, profile: Profile, t: Thresholds = DEFAULT_THRESHOLDS,
                keep: list[str] | None = None) -> DataFrame:
    """Ad-hoc scoring of any table holding (some of) the features.

    Missing features count as 0 (P5). Without host history the context
    barrier reads WAITING/UNAVAILABLE, as for a first flow of a host.
    """
    aligned = align_features(df, keep=keep or [c for c in df.columns if c not in FEATURES])
    s = score_anomaly(score_routine(score_distances(aligned, profile), profile), profile)
    s = s.withColumn("history_len", F.lit(1)).withColumn("ctx_raw", F.lit(None).cast("double"))
    return with_verdict(s, t, DEFAULT_FLOW).drop("energy")
