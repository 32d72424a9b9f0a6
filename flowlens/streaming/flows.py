"""Streaming flow assembly (key clock) with Structured Streaming.

``packets`` stream -> canonical key -> ``groupBy(key).applyInPandasWithState``.
The state of a key is the open flow's running moments (counts, sums, sums of
squares, min/max, last times per direction, flag counts) - a fixed set of
numbers, never a packet list. Each arriving packet is applied with the same
key-clock rule as the batch operator (sorted by ``(ts_us, seq)`` inside the
micro-batch); an event-time timeout at ``min(last + idle, first + active)``
closes flows that stay quiet once the watermark passes it.

Emitted rows carry the same aggregate names as the batch aggregation, so the
shared feature SQL turns them into the 52 features. A stream's flow identity
is ``(key, first_us)``; per-key state is dropped when its flow closes.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import with_flow_key
from ..operators.assemble import close_reason_sqls
from ..operators.features import AGG_EXPRS, FEATURE_EXPRS
from ..schema import KEY_COLS
from ..settings import DEFAULT_FLOW, FlowConfig

BASE_US = 1_704_067_200_000_000          # stream timestamps: BASE_US + ts_us
_INT_AGGS = [k for k in AGG_EXPRS]        # all integer-valued
STATE_FIELDS = _INT_AGGS + ["lf_us", "lb_us"]   # + last forward / backward packet time

_KEY_TYPES = {"capture_id": T.StringType(), "a_ip": T.StringType(), "a_port": T.IntegerType(),
              "b_ip": T.StringType(), "b_port": T.IntegerType(), "proto": T.IntegerType()}

SQUARES = ("ga_s2", "gf_s2", "gb_s2")     # sums of squared gaps


def _agg_type(name: str) -> T.DataType:
    return T.DecimalType(38, 0) if name in SQUARES else T.LongType()


FLOW_STREAM_SCHEMA = T.StructType(
    [T.StructField(k, t) for k, t in _KEY_TYPES.items()]
    + [T.StructField(k, _agg_type(k)) for k in _INT_AGGS]
    + [T.StructField("emit_us", T.LongType()), T.StructField("close_reason", T.StringType()),
       T.StructField("final", T.BooleanType()), T.StructField("ts", T.TimestampType())])
STATE_SCHEMA = T.StructType([T.StructField(k, _agg_type(k)) for k in STATE_FIELDS])


def _new(t: int) -> dict:
    s = {k: None for k in STATE_FIELDS}
    s.update(first_us=t, last_us=t, n=0, nf=0, bf=0, bb=0, sf2=0, sb2=0, ga_n=0, ga_s=0, ga_s2=Decimal(0),
             gf_n=0, gf_s=0, gf_s2=Decimal(0), gb_n=0, gb_s=0, gb_s2=Decimal(0), c_fin=0, c_syn=0, c_rst=0, c_psh=0,
             c_ack=0, c_urg=0, hf=0, hb=0)
    return s


def _mx(a, b):
    return b if a is None else max(a, b)


def _mn(a, b):
    return b if a is None else min(a, b)


def _add(s: dict, t: int, fwd: bool, length: int, hdr: int, flags: int) -> None:
    if s["n"] > 0:
        g = t - s["last_us"]
        s["ga_n"] += 1; s["ga_s"] += g; s["ga_s2"] += g * g
        s["ga_max"] = _mx(s["ga_max"], g); s["ga_min"] = _mn(s["ga_min"], g)
    side = "f" if fwd else "b"
    lt = s["lf_us"] if fwd else s["lb_us"]
    if lt is not None:
        g = t - lt
        s[f"g{side}_n"] += 1; s[f"g{side}_s"] += g; s[f"g{side}_s2"] += g * g
        s[f"g{side}_max"] = _mx(s[f"g{side}_max"], g); s[f"g{side}_min"] = _mn(s[f"g{side}_min"], g)
    s["lf_us" if fwd else "lb_us"] = t
    s["n"] += 1
    s["last_us"] = t
    if fwd:
        s["nf"] += 1; s["bf"] += length; s["sf2"] += length * length; s["hf"] += hdr
        s["fmax"] = _mx(s["fmax"], length); s["fmin"] = _mn(s["fmin"], length)
    else:
        s["bb"] += length; s["sb2"] += length * length; s["hb"] += hdr
        s["bmax"] = _mx(s["bmax"], length); s["bmin"] = _mn(s["bmin"], length)
    s["amax"] = _mx(s["amax"], length); s["amin"] = _mn(s["amin"], length)
    for name, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32)):
        if flags & bit:
            s[f"c_{name}"] += 1


def _flow_state_fn(cfg: FlowConfig):
    idle, active = cfg.idle_us, cfg.active_us

    def emit(key, s, reason, emit_us):
        row = dict(zip(KEY_COLS, key))
        row.update({k: s[k] for k in _INT_AGGS})
        row.update(emit_us=emit_us, close_reason=reason, final=True)
        return row

    def fn(key, pdfs: Iterator, state) -> Iterator:
        import pandas as pd

        out = []
        s = dict(zip(STATE_FIELDS, state.get)) if state.exists else None
        if state.hasTimedOut:
            if s is not None:
                timer = min(s["last_us"] + idle, s["first_us"] + active)
                reason = "idle" if s["last_us"] + idle <= s["first_us"] + active else "active"
                out.append(emit(key, s, reason, timer))
            state.remove()
        else:
            pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "seq"])
            tcp = int(key[5]) == 6
            for t, fwd, length, hdr, flags in zip(pdf["ts_us"], pdf["fwd"], pdf["length"],
                                                  pdf["header_len"], pdf["tcp_flags"]):
                t, flags = int(t), int(flags or 0)
                if s is not None and (t - s["last_us"] >= idle or t - s["first_us"] >= active):
                    timer = min(s["last_us"] + idle, s["first_us"] + active)
                    reason = "idle" if s["last_us"] + idle <= s["first_us"] + active else "active"
                    out.append(emit(key, s, reason, timer))
                    s = None
                if s is None:
                    s = _new(t)
                _add(s, t, bool(fwd), int(length), int(hdr or 0), flags)
                if tcp and (s["c_rst"] > 0 or s["c_fin"] >= 2):
                    out.append(emit(key, s, "tcp_close", s["last_us"]))
                    s = None
            if s is None:
                if state.exists:
                    state.remove()
            else:
                timer = min(s["last_us"] + idle, s["first_us"] + active)
                if (BASE_US + timer) // 1000 + 1 <= state.getCurrentWatermarkMs():
                    # already expired by event time (input arrived late): close now
                    reason = "idle" if s["last_us"] + idle <= s["first_us"] + active else "active"
                    out.append(emit(key, s, reason, timer))
                    if state.exists:
                        state.remove()
                else:
                    state.update(tuple(s[k] for k in STATE_FIELDS))
                    state.setTimeoutTimestamp((BASE_US + timer) // 1000 + 1)
        if out:
            df = pd.DataFrame(out)
            for k in [*(k for k in _INT_AGGS if k not in SQUARES), "emit_us"]:
                df[k] = df[k].astype("Int64")
            df["ts"] = pd.to_datetime(BASE_US + df["emit_us"].astype("int64"), unit="us")
            yield df[[f.name for f in FLOW_STREAM_SCHEMA.fields]]

    return fn


def with_event_time(packets: DataFrame) -> DataFrame:
    """Add ``ts`` = ``BASE_US + ts_us`` as a timestamp (the watermark column)."""
    return packets.withColumn("ts", F.timestamp_micros(F.lit(BASE_US) + F.col("ts_us")))


def stream_flows(packets: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, watermark: str = "0 seconds") -> DataFrame:
    """Streaming packets (with ``ts``) -> final flows with the 52 features.

    Packets later than the watermark are dropped by Spark (counted in the
    query's progress metrics); ordered input (or ``watermark`` covering the
    disorder) gives the same flows as the batch key-clock operator.
    """
    keyed = with_flow_key(packets.withColumn("capture_id", F.coalesce(F.col("capture_id"), F.lit(""))))
    keyed = keyed.withWatermark("ts", watermark).select(*KEY_COLS, "seq", "ts_us", "fwd", "length",
                                                         "header_len", "tcp_flags", "ts")
    flows = keyed.groupBy(*KEY_COLS).applyInPandasWithState(
        _flow_state_fn(cfg), FLOW_STREAM_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout")
    return flows.select(*KEY_COLS, "first_us", "last_us", "emit_us", "close_reason", "final", "ts",
                        *[F.expr(v).alias(k) for k, v in FEATURE_EXPRS.items()])


__all__ = ["stream_flows", "with_event_time", "BASE_US", "close_reason_sqls"]
