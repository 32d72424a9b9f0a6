"""Streaming scoring, rolling counts, response state and sink fan-out.

* T2 ``stream_score`` - stateless surrogate scores per flow, then a per-host
  ``applyInPandasWithState`` holding the host's last ``sequence_len - 1``
  distances (a fixed-size state, no flow rows) for the context barrier, then
  the shared verdict SQL.
* T3 ``stream_throughput`` / ``stream_status`` / ``stream_recent`` - event-time
  tumbling / sliding windows with a watermark, append mode.
* T4 ``stream_response`` - per-source alert counter and block expiry with an
  event-time timer that emits the ``unblock``.
* T5 ``fan_out`` - ``foreachBatch`` writing events, alerts and actions per
  batch id (overwrite of that batch's folder: a retried batch is idempotent).

T1 -> T2 run as two queries joined by a sink (the flows table), the robust
way to chain stateful operators.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import Profile
from ..operators.scoring import EMIT_ORDER, context_sql, gate_sqls, score_anomaly, score_distances, \
    score_routine, verdict_sqls
from ..settings import DEFAULT_FLOW, DEFAULT_POLICY, DEFAULT_THRESHOLDS, FlowConfig, Policy, Thresholds
from .flows import BASE_US

HOST_STATE = T.StructType([T.StructField("hist", T.StringType()), T.StructField("cnt", T.LongType())])


def _host_fn(L: int, order: list[str]):
    def fn(key, pdfs: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order)
        hist, cnt = ([], 0)
        if state.exists:
            h, cnt = state.get
            hist = [float(x) for x in h.split(",")] if h else []
        hl, n_, m_, s_ = [], [], [], []
        for d in pdf["dist"].astype(float):
            hist = (hist + [d])[-L:]
            cnt += 1
            arr = np.asarray(hist)
            hl.append(min(cnt, L)); n_.append(len(arr)); m_.append(float(arr.mean())); s_.append(float(arr.std()))
            hist = hist[-(L - 1):] if L > 1 else []
        state.update((",".join(repr(x) for x in hist), cnt))
        yield pdf.assign(history_len=np.asarray(hl, dtype="int32"), ctx_n=np.asarray(n_, dtype="int64"),
                         ctx_mean=m_, ctx_sd=s_)
    return fn


def stream_score(flows: DataFrame, profile: Profile, t: Thresholds = DEFAULT_THRESHOLDS,
                 cfg: FlowConfig = DEFAULT_FLOW, host_col: str = "src_ip") -> DataFrame:
    """Scored events from a flows stream (per-host history of ``sequence_len``)."""
    f = flows
    if "src_ip" not in f.columns:
        f = f.withColumn("src_ip", F.col("a_ip")).withColumn("dst_ip", F.col("b_ip"))
    if "flow_no" not in f.columns:
        f = f.withColumn("flow_no", F.col("first_us"))   # stream flow identity
    s = score_anomaly(score_routine(score_distances(f, profile), profile), profile)
    out_schema = T.StructType(s.schema.fields + [T.StructField("history_len", T.IntegerType()),
                                                 T.StructField("ctx_n", T.LongType()),
                                                 T.StructField("ctx_mean", T.DoubleType()),
                                                 T.StructField("ctx_sd", T.DoubleType())])
    ctx = s.groupBy(host_col).applyInPandasWithState(_host_fn(cfg.sequence_len, EMIT_ORDER), out_schema,
                                                     HOST_STATE, "append", "NoTimeout")
    ctx = ctx.withColumn("ctx_raw", F.expr(context_sql()))
    ctx = ctx.withColumns({k: F.expr(v) for k, v in gate_sqls(t, cfg).items()})
    return ctx.withColumns({k: F.expr(v) for k, v in verdict_sqls(t).items()})


def with_emit_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros(F.lit(BASE_US) + F.col("emit_us")))


SENTINEL = "__sentinel__"


def _watermarked(events: DataFrame, watermark: str) -> DataFrame:
    """Watermark, then drop end-of-replay sentinel rows (they still advance event time).

    The predicate mentions the event-time column on purpose: Catalyst does
    not push such a filter below the watermark, so sentinels reach it.
    """
    e = events.withWatermark("ts", watermark)
    return e.filter((F.coalesce(F.col("status"), F.lit("")) != SENTINEL) | F.col("ts").isNull())


def stream_throughput(events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Flows and attacks per emission second (append once a second closes)."""
    e = _watermarked(events, watermark)
    return (e.groupBy(F.window("ts", "1 second").alias("w"))
            .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == "ATTACK").alias("attacks"))
            .select(((F.unix_micros(F.col("w.start")) - BASE_US) / 1_000_000).cast("long").alias("t"),
                    "count", "attacks"))


def stream_status(events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Status counts per emission minute."""
    e = _watermarked(events, watermark)
    return (e.groupBy(F.window("ts", "1 minute").alias("w"))
            .agg(F.count_if(F.col("status") == "NORMAL").alias("normal"),
                 F.count_if(F.col("status") == "SUSPICIOUS").alias("suspicious"),
                 F.count_if(F.col("status") == "ATTACK").alias("attacks"))
            .select(((F.unix_micros(F.col("w.start")) - BASE_US) / 60_000_000).cast("long").alias("minute"),
                    "normal", "suspicious", "attacks"))


def stream_recent(events: DataFrame, window_s: int = 60, slide_s: int = 1, watermark: str = "0 seconds") -> DataFrame:
    """Flows in a sliding ``window_s`` window every ``slide_s``."""
    e = _watermarked(events, watermark)
    return (e.groupBy(F.window("ts", f"{window_s} seconds", f"{slide_s} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("flows"))
            .select(((F.unix_micros(F.col("w.end")) - BASE_US)).alias("window_end_us"), "flows"))


RESPONSE_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()), T.StructField("t_us", T.LongType()),
    T.StructField("alert_count", T.LongType()), T.StructField("action_type", T.StringType()),
    T.StructField("expires_us", T.LongType())])
RESPONSE_STATE = T.StructType([T.StructField("alerts", T.LongType()), T.StructField("until", T.LongType())])


def _response_fn(policy: Policy):
    dur = int(policy.block_duration_seconds) * 1_000_000

    def fn(key, pdfs: Iterator, state) -> Iterator:
        import pandas as pd

        alerts, until = state.get if state.exists else (0, None)
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], until, alerts, "unblock", until))
            state.update((alerts, None))
        else:
            pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(EMIT_ORDER)
            for t, status in zip(pdf["emit_us"], pdf["status"]):
                if until is not None and t >= until:  # it ran out before this row
                    rows.append((key[0], until, alerts, "unblock", until))
                    until = None
                if status not in ("ATTACK", "SUSPICIOUS"):
                    continue
                alerts += 1
                if policy.auto_block and alerts >= int(policy.block_threshold):
                    until = int(t) + dur
                    rows.append((key[0], int(t), alerts, "block", until))
                else:
                    rows.append((key[0], int(t), alerts, "watch", None))
            if until is not None:
                ms = (BASE_US + until) // 1000
                if ms > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(ms)
                else:  # no timer can fire for it any more
                    rows.append((key[0], until, alerts, "unblock", until))
                    until = None
            state.update((alerts, until))
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in RESPONSE_SCHEMA.fields]).astype(
                {"t_us": "Int64", "alert_count": "Int64", "expires_us": "Int64"})
    return fn


def stream_response(events: DataFrame, policy: Policy = DEFAULT_POLICY, host_col: str = "src_ip",
                    watermark: str = "0 seconds") -> DataFrame:
    """T4: per-source alert counter, block (renewing) and timer-driven unblock."""
    e = _watermarked(events, watermark).select(F.col(host_col).alias("ip"), *EMIT_ORDER, "status", "ts")
    e = e.filter(F.col("ip").isNotNull() | F.col("ts").isNull())
    return e.groupBy("ip").applyInPandasWithState(_response_fn(policy), RESPONSE_SCHEMA, RESPONSE_STATE,
                                                  "append", "EventTimeTimeout")


def fan_out(root: str):
    """T5: a ``foreachBatch`` function writing events and alerts of each batch
    to ``root/<table>/batch_id=<id>`` (overwrite: retries are idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter(F.col("status").isNull() | (F.col("status") != SENTINEL))
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(os.path.join(root, "events", f"batch_id={batch_id}"))
            (batch.filter(F.col("status").isin("ATTACK", "SUSPICIOUS"))
             .write.mode("overwrite").parquet(os.path.join(root, "alerts", f"batch_id={batch_id}")))
        finally:
            batch.unpersist()
    return write


def fan_out_blocks(root: str):
    """T5: a ``foreachBatch`` function writing the block and unblock rows of each
    batch of T4 to ``root/blocks/batch_id=<id>`` (overwrite: retries are idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.filter(F.col("action_type").isin("block", "unblock"))
         .write.mode("overwrite").parquet(os.path.join(root, "blocks", f"batch_id={batch_id}")))
    return write
