"""Registered streaming queries; the SQL is the batch result the replay must come to.

Each replays the derived ``packets`` table as a time-ordered file stream
(``availableNow``) through T1 and, chained by sinks, T2-T5, then returns the
sink contents as a DataFrame. Sinks and checkpoints live under the session's
shared checkpoint folder; T1 and T2 results are reused within a session.
``stream_reordered``, ``stream_interim`` and ``stream_chain`` run the operators
of ``streaming.ordered``: a shuffled replay, its snapshots, and T1 with T2 in
one query.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.scalar import round_half_up, round_sql
from ..schema import FEATURES, KEY_COLS
from ..settings import DEFAULT_FLOW
from ..streaming.flows import stream_flows
from ..streaming.operators import (SENTINEL, fan_out, fan_out_blocks, stream_recent, stream_response, stream_score, stream_status,
                                   stream_throughput, with_emit_time)
from ..streaming.ordered import assemble_stream, run_counting_late, score_stream, state_partitions
from ..streaming.replay import SLICE_ROWS, packet_stream, read_stream, run_to_table, shuffled_stream, work_dir, write_slices
from . import context as C
from .catalog import register
from .catalog_more import ALERT_SQL, DUR, POLICY, _interim_sql, _intervals_ctes
from .oracle import flow_ctes, scored_ctes, with_ctes

# event-time disorder of emitted flows on a replay is bounded by one input
# slice plus the active timeout; counts use a watermark that covers it
EVENT_WATERMARK = "30 minutes"
FILES_PER_TRIGGER = 16


def _t1_dir(spark, sf) -> str:
    k = C._key(spark, sf, "stream-t1")
    if k not in C._CACHE:
        wd = work_dir(spark, "stream-flows")
        ps = packet_stream(spark, C.packets(spark, sf), os.path.join(wd, "in"), 8)
        run_to_table(stream_flows(ps), os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
        C._CACHE[k] = os.path.join(wd, "out")
    return C._CACHE[k]


def _t2_dir(spark, sf) -> str:
    k = C._key(spark, sf, "stream-t2")
    if k not in C._CACHE:
        wd = work_dir(spark, "stream-scores")
        # a host's history is the order of arrival: the flows come in the order of their emission
        first = write_slices(spark.read.parquet(_t1_dir(spark, sf)), os.path.join(wd, "in"), ["emit_us"])
        flows = read_stream(spark, os.path.join(wd, "in"), first.schema)
        run_to_table(stream_score(flows, C.profile(spark, sf)), os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
        # one sentinel event a day after the end, written last: closes every window / timer
        out = spark.read.parquet(os.path.join(wd, "out"))
        last = out.agg(F.max("emit_us")).first()[0] or 0
        (out.limit(1).select(*[(F.lit(SENTINEL) if c == "status" else F.lit(int(last) + 86_400_000_000)
                                if c == "emit_us" else F.lit(None)).cast(out.schema[c].dataType).alias(c)
                               for c in out.columns])
         .write.mode("overwrite").parquet(os.path.join(wd, "sentinel")))
        C._CACHE[k] = wd
    return C._CACHE[k]


def _events_stream(spark, sf):
    wd = _t2_dir(spark, sf)
    schema = spark.read.parquet(os.path.join(wd, "out")).schema
    return with_emit_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
                          .parquet(os.path.join(wd, "{out,sentinel}", "*.parquet")))


def _run(spark, stream, name):
    wd = work_dir(spark, name)
    run_to_table(stream, os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
    return spark.read.parquet(os.path.join(wd, "out"))


# A stream does not know the end of a capture: flows that are flushed there close by their timer.
_TIMER_SQL = (f"CASE WHEN close_reason <> 'flush' THEN close_reason "
              f"WHEN last_us + {DEFAULT_FLOW.idle_us} <= first_us + {DEFAULT_FLOW.active_us} THEN 'idle' ELSE 'active' END")


@register("stream_flows", with_ctes(flow_ctes("key"), f"""
SELECT {', '.join(KEY_COLS)}, first_us, last_us, emit_us, {_TIMER_SQL} AS close_reason, TRUE AS final,
  {', '.join(f'{round_sql(f)} AS {f}' for f in FEATURES)} FROM flows"""))
def q_stream_flows(spark, sf):
    """Streaming flow assembly (per-key state, event-time timers) replayed over the packets."""
    return spark.read.parquet(_t1_dir(spark, sf)).select(
        *KEY_COLS, "first_us", "last_us", "emit_us", "close_reason", "final",
        *[round_half_up(f).alias(f) for f in FEATURES])


#: Packets of the shuffled replay arrive up to this much late; the watermark covers it.
DISORDER_S = 90


def _batch_partitions(spark, path) -> int:
    """State partitions for a replay of the slices in ``path``."""
    return state_partitions(spark, min(SLICE_ROWS, spark.read.option("recursiveFileLookup", "true").parquet(path).count()))


def _shuffled_dir(spark, sf) -> str:
    k = C._key(spark, sf, "stream-shuffled")
    if k not in C._CACHE:
        wd = work_dir(spark, "stream-shuffled")
        ps = shuffled_stream(spark, C.packets(spark, sf), os.path.join(wd, "in"), DISORDER_S * 1_000_000, 4)
        flows = assemble_stream(ps, watermark=f"{DISORDER_S} seconds", reorder=True, interim=True)
        parts = _batch_partitions(spark, os.path.join(wd, "in"))
        if run_counting_late(flows, os.path.join(wd, "out"), os.path.join(wd, "ckpt"), partitions=parts):
            raise RuntimeError("the replay has packets beyond its own disorder")
        C._CACHE[k] = os.path.join(wd, "out")
    return C._CACHE[k]


@register("stream_reordered", with_ctes(flow_ctes("key"), f"""
SELECT {', '.join(KEY_COLS)}, first_us, last_us, emit_us, {_TIMER_SQL} AS close_reason, TRUE AS final,
  {', '.join(f'{round_sql(f)} AS {f}' for f in FEATURES)} FROM flows"""))
def q_stream_reordered(spark, sf):
    """T1 with reordering: packets that arrive out of order across micro-batches give the flows of the batch operator."""
    return spark.read.parquet(_shuffled_dir(spark, sf)).filter("final").select(
        *KEY_COLS, "first_us", "last_us", "emit_us", "close_reason", "final", *[round_half_up(f).alias(f) for f in FEATURES])


@register("stream_interim", _interim_sql("key", "first_us"))
def q_stream_interim(spark, sf):
    """T1 interim rows: snapshots of open flows at packets 2, 8, 14, ... in the output of the same stream."""
    return spark.read.parquet(_shuffled_dir(spark, sf)).filter("NOT final").select(
        *KEY_COLS, "first_us", "packets", "emit_us", "final", *[round_half_up(f).alias(f) for f in FEATURES])


@register("stream_chain", with_ctes(scored_ctes(), """
SELECT capture_id, a_ip, a_port, b_ip, b_port, proto, first_us, emit_us, src_ip, history_len, status, severity,
  reason, threat_score FROM scored"""))
def q_stream_chain(spark, sf):
    """T1 into T2 in one streaming query, no table between them: packets in, scored events out."""
    wd = work_dir(spark, "stream-chain")
    ps = packet_stream(spark, C.packets(spark, sf), os.path.join(wd, "in"), 4)
    run_counting_late(score_stream(assemble_stream(ps), C.profile(spark, sf)), os.path.join(wd, "out"), os.path.join(wd, "ckpt"),
                      partitions=_batch_partitions(spark, os.path.join(wd, "in")))
    return spark.read.parquet(os.path.join(wd, "out")).select(
        "capture_id", "a_ip", "a_port", "b_ip", "b_port", "proto", "first_us", "emit_us", "src_ip",
        "history_len", "status", "severity", "reason", "threat_score")


@register("stream_scores", with_ctes(scored_ctes(), """
SELECT capture_id, a_ip, a_port, b_ip, b_port, proto, first_us, emit_us, src_ip, history_len, status, severity,
  reason, threat_score FROM scored"""))
def q_stream_scores(spark, sf):
    """Streaming three-barrier scoring with per-host history state."""
    return spark.read.parquet(os.path.join(_t2_dir(spark, sf), "out")).select(
        "capture_id", "a_ip", "a_port", "b_ip", "b_port", "proto", "first_us", "emit_us", "src_ip",
        "history_len", "status", "severity", "reason", "threat_score")


@register("stream_throughput", with_ctes(scored_ctes(), """
SELECT emit_us // 1000000 AS t, CAST(count(*) AS BIGINT) AS count,
  CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks FROM scored GROUP BY 1"""))
def q_stream_throughput(spark, sf):
    """Flows / attacks per second from the scored event stream (watermarked tumbling window)."""
    return _run(spark, stream_throughput(_events_stream(spark, sf), EVENT_WATERMARK), "stream-tput")


@register("stream_status", with_ctes(scored_ctes(), """
SELECT emit_us // 60000000 AS minute, CAST(sum(CASE WHEN status = 'NORMAL' THEN 1 ELSE 0 END) AS BIGINT) AS normal,
  CAST(sum(CASE WHEN status = 'SUSPICIOUS' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
  CAST(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS attacks FROM scored GROUP BY 1"""))
def q_stream_status(spark, sf):
    """Status counts per minute from the scored event stream."""
    return _run(spark, stream_status(_events_stream(spark, sf), EVENT_WATERMARK), "stream-status")


@register("stream_recent", with_ctes(scored_ctes(), """
SELECT window_end_us, CAST(count(*) AS BIGINT) AS flows FROM (
  SELECT unnest(range((emit_us // 10000000 + 1) * 10000000, (emit_us // 10000000 + 7) * 10000000, 10000000)) AS window_end_us
  FROM scored) w GROUP BY 1"""))
def q_stream_recent(spark, sf):
    """Flows in a sliding 60 s window (10 s slide) over the event stream."""
    return _run(spark, stream_recent(_events_stream(spark, sf), 60, 10, EVENT_WATERMARK), "stream-recent")


_RESPONSE_CTE = f"""response AS (SELECT src_ip AS ip, emit_us AS t_us, alert_count, action_type,
    CASE WHEN action_type = 'block' THEN CAST(emit_us + {DUR} AS BIGINT) END AS expires_us FROM act2 WHERE {ALERT_SQL}
  UNION ALL SELECT ip, max(t_us) + {DUR}, CAST(max(n) AS BIGINT), 'unblock', max(t_us) + {DUR} FROM b3 GROUP BY ip, isl)"""


def _response_dir(spark, sf) -> str:
    k = C._key(spark, sf, "stream-t4")
    if k not in C._CACHE:
        wd = work_dir(spark, "stream-response")
        run_to_table(stream_response(_events_stream(spark, sf), POLICY, watermark=EVENT_WATERMARK),
                     os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
        C._CACHE[k] = os.path.join(wd, "out")
    return C._CACHE[k]


@register("stream_response", with_ctes(_intervals_ctes() + [_RESPONSE_CTE], """
SELECT ip, t_us, alert_count, action_type, COALESCE(expires_us, 0) AS expires_us FROM response"""))
def q_stream_response(spark, sf):
    """T4: streaming alert counter, renewing blocks and timer unblocks per source (watch rows: expiry 0)."""
    return spark.read.parquet(_response_dir(spark, sf)).withColumn("expires_us", F.coalesce("expires_us", F.lit(0)))


def _each_batch(stream, write, ckpt: str) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(
        availableNow=True).start().awaitTermination()


@register("stream_fanout", with_ctes(_intervals_ctes() + [_RESPONSE_CTE], f"""
SELECT 'events' AS table_name, src_ip AS ip, emit_us AS t_us, status AS kind FROM scored
UNION ALL SELECT 'alerts', src_ip, emit_us, status FROM scored WHERE status IN ('ATTACK', 'SUSPICIOUS')
UNION ALL SELECT 'blocks', ip, t_us, action_type FROM response WHERE action_type IN ('block', 'unblock')"""))
def q_stream_fanout(spark, sf):
    """T5: foreachBatch fan-out into the tables of events, alerts and blocks; returns all three."""
    wd = work_dir(spark, "stream-fanout")
    tables = os.path.join(wd, "tables")
    _each_batch(_events_stream(spark, sf), fan_out(tables), os.path.join(wd, "ckpt"))
    src = _response_dir(spark, sf)
    actions = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    _each_batch(actions, fan_out_blocks(tables), os.path.join(wd, "ckpt-blocks"))
    out = [spark.read.parquet(os.path.join(tables, t)).select(
        F.lit(t).alias("table_name"), F.col(ip).alias("ip"), F.col(at).alias("t_us"), F.col(kind).alias("kind"))
        for t, ip, at, kind in (("events", "src_ip", "emit_us", "status"), ("alerts", "src_ip", "emit_us", "status"),
                                ("blocks", "ip", "t_us", "action_type"))]
    return out[0].unionByName(out[1]).unionByName(out[2])
