"""T1 and T2 on ``transformWithStateInPandas``: reordering, interim rows, and both in one streaming query.

* :func:`assemble_stream` - T1 with list state. With ``reorder`` a key's packets wait in its state until the watermark has
  passed them and are then applied in the order of time, so packets may arrive in any order within the watermark's delay;
  later ones are dropped and counted by Spark (:func:`run_counting_late`). With ``interim`` the running moments of an open
  flow come out at packets 2, 8, 14, ... as rows with ``final`` = false.
* :func:`score_stream` - T2 per host: flows wait until the watermark has passed their emission, so a host's history is in
  the order of emission, whatever micro-batch a flow came in. Both operators name their event-time column, so they chain
  in one query without a table between them.

Timers: each key has at most one, at the next thing that is due. A row's event time is the time it stands for, never
before the watermark of the batch before. Needs the RocksDB state store (:func:`rocksdb_state`) and protobuf.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import with_flow_key
from ..operators.features import FEATURE_EXPRS
from ..operators.profile import Profile
from ..operators.scoring import EMIT_ORDER, context_sql, gate_sqls, score_anomaly, score_distances, score_routine, verdict_sqls
from ..schema import KEY_COLS
from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS, FlowConfig, Thresholds
from .flows import _INT_AGGS, BASE_US, FLOW_STREAM_SCHEMA, SQUARES, STATE_FIELDS, STATE_SCHEMA
from .moments import PACKET, Moments, cut_flows, expiry, from_pandas, in_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PENDING = "part binary"
#: Packets of one value of a key's list.
PART = 1 << 14
_PACKET = ["ts_us", "seq", "fwd", "length", "header_len", "tcp_flags"]
_TIMER = "ms long"


#: Rows of a micro-batch for each state partition, where there are more than cores.
STATE_ROWS = 50_000


def state_partitions(spark: SparkSession, batch_rows: int) -> int:
    """State partitions for micro-batches of so many rows: one for each core, more where they'd have over ``STATE_ROWS``,
    and the session's shuffle partitions at most. Each is a task with a state store and a Python worker in every micro-batch,
    whether rows come to it or not."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, -(-batch_rows // STATE_ROWS))))


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep their state in RocksDB, which these operators need, in so many ``partitions`` (else as many
    as the session shuffles to); the session's settings come back."""
    new = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        new["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ms(us: int) -> int:
    """The first millisecond at which the watermark has passed ``us``."""
    return -(-(BASE_US + us) // 1000)


class _Timed(StatefulProcessor):
    """A key with one timer: kept while it is early enough, set anew when it fires."""

    def _timers(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", _TIMER)

    def _due(self, us: int | None) -> None:
        if us is None:
            return
        at = _ms(us)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class FlowProcessor(_Timed):
    """A key's open flow as running moments, its waiting packets as parts of ``PART`` packets, each one value of a list."""

    def __init__(self, cfg: FlowConfig, reorder: bool, interim: bool):
        self.cfg, self.reorder, self.interim = cfg, reorder, interim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timers(handle)
        self.flow = handle.getValueState("flow", STATE_SCHEMA)
        self.waiting = handle.getListState("waiting", _PENDING)

    def _expired(self, first_us: int, last_us: int) -> str:
        return "idle" if last_us + self.cfg.idle_us <= first_us + self.cfg.active_us else "active"

    def _apply(self, key, packets, s) -> tuple[list, dict | None]:
        """Packets in the order of time -> frames of closed flows and snapshots, and the flow that stays open."""
        import numpy as np

        out, cfg = [], self.cfg
        if s is not None and len(packets) and packets["ts_us"][0] >= expiry(s["first_us"], s["last_us"], cfg):
            out.append(self._closed(key, s))
            s = None
        if not len(packets):
            return out, s
        start, end, tcp = cut_flows(packets, int(key[5]) == 6, cfg, s)
        done = (end < len(packets)) | tcp
        last = end[done] - 1
        snaps = np.empty(0, np.int64)
        if self.interim:
            size = end - start
            n = np.arange(len(packets)) - np.repeat(start, size) + 1
            if s is not None:
                n[:size[0]] += s["n"]
            hit = (n >= cfg.interim_min_packets) & ((n - cfg.interim_min_packets) % cfg.interim_step == 0)
            hit[end[tcp] - 1] = False
            snaps = np.flatnonzero(hit)
        m = Moments(packets, start, s, np.r_[last, snaps, len(packets) - 1])
        rows, stop = m.rows(len(last) + len(snaps)), len(last) + len(snaps)
        if stop:
            first, final = rows["first_us"][:len(last)].tolist(), rows["last_us"][:len(last)].tolist()
            closed = tcp[done].tolist()
            reason = ["tcp_close" if c else self._expired(x, y) for c, x, y in zip(closed, first, final, strict=True)]
            emit = [y if c else expiry(x, y, cfg) for c, x, y in zip(closed, first, final, strict=True)]
            out.append(_flow_frame(key, rows, np.r_[np.array(emit, np.int64), packets["ts_us"][snaps]], reason + [None] * len(snaps)))
        return out, None if done[-1] else m.state(-1)

    def _closed(self, key, s):
        """An open flow that has run out of time."""
        rows = {k: [s[k]] for k in _INT_AGGS}
        return _flow_frame(key, rows, [expiry(s["first_us"], s["last_us"], self.cfg)], [self._expired(s["first_us"], s["last_us"])])

    def _advance(self, key, arrived, watermark_ms: int) -> Iterator:
        import numpy as np

        passed = watermark_ms * 1000 - BASE_US
        s = dict(zip(STATE_FIELDS, self.flow.get())) if self.flow.exists() else None
        had, due = s is not None, []
        if self.reorder:
            if self.waiting.exists():
                arrived = np.concatenate([arrived, *[np.frombuffer(r[0], PACKET) for r in self.waiting.get()]])
            ahead = arrived["ts_us"] > passed
            later, arrived = arrived[ahead], arrived[~ahead]
            if len(later):
                self.waiting.put([(later[i:i + PART].tobytes(),) for i in range(0, len(later), PART)])
                due.append(int(later["ts_us"].min()))
            else:
                self.waiting.clear()
        out, s = self._apply(key, in_order(arrived), s)
        if s is not None and expiry(s["first_us"], s["last_us"], self.cfg) <= passed:
            out.append(self._closed(key, s))
            s = None
        if s is not None:
            self.flow.update(tuple(s[k] for k in STATE_FIELDS))
            due.append(expiry(s["first_us"], s["last_us"], self.cfg))
        elif had:
            self.flow.clear()
        self._due(min(due) if due else None)
        yield from out

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np

        yield from self._advance(key, np.concatenate([from_pandas(pdf) for pdf in rows]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np

        self.timer.clear()
        yield from self._advance(key, np.empty(0, PACKET), timerValues.getCurrentWatermarkInMs())


def _flow_frame(key, rows: dict, emit_us, reason: list):
    """Rows of the moments at their emission; those without a reason are snapshots."""
    import numpy as np
    import pandas as pd

    emit = np.asarray(emit_us, np.int64)
    data = {k: [v] * len(emit) for k, v in zip(KEY_COLS, key)}
    data |= {k: v if k in SQUARES else pd.array(v, "Int64") for k, v in rows.items()}
    data |= {"emit_us": emit, "close_reason": np.array(reason, object), "final": np.array([r is not None for r in reason]),
             "ts": pd.to_datetime(BASE_US + emit, unit="us")}
    return pd.DataFrame(data)[[f.name for f in FLOW_STREAM_SCHEMA.fields]]


def assemble_stream(packets: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, watermark: str = "0 seconds",
                    reorder: bool = False, interim: bool = False) -> DataFrame:
    """Streaming packets (with ``ts``) -> flows with the 52 features, and ``packets``, the count so far.

    ``reorder``: packets that arrive within ``watermark`` of the latest one are put in order first, so any such arrival
    gives the flows of the batch key-clock operator. Too late is a packet at or before the watermark of the micro-batch
    before: nothing after that has been applied yet. Without it a micro-batch is put in order, and batches must come in
    order. ``interim``: adds the snapshots of F6, with a null ``close_reason``.
    """
    keyed = with_flow_key(packets.withColumn("capture_id", F.coalesce(F.col("capture_id"), F.lit(""))))
    keyed = keyed.withWatermark("ts", watermark).select(*KEY_COLS, *_PACKET, "ts")
    flows = keyed.groupBy(*KEY_COLS).transformWithStateInPandas(
        FlowProcessor(cfg, reorder, interim), FLOW_STREAM_SCHEMA, "Append", "EventTime", eventTimeColumnName="ts")
    return flows.select(*KEY_COLS, "first_us", "last_us", "emit_us", "close_reason", "final", "ts",
                        F.col("n").alias("packets"), *[F.expr(v).alias(k) for k, v in FEATURE_EXPRS.items()])


class HostProcessor(_Timed):
    """A host's last distances; its flows wait until the watermark has passed their emission."""

    def __init__(self, columns: list[str], schema: T.StructType, length: int):
        self.columns, self.schema, self.length = columns, schema, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timers(handle)
        self.history = handle.getValueState("history", "dist array<double>, n long")
        self.waiting = handle.getListState("waiting", self.schema)

    def _advance(self, rows: list[tuple], watermark_ms: int) -> Iterator:
        import numpy as np
        import pandas as pd

        passed = watermark_ms * 1000 - BASE_US
        at = self.columns.index("emit_us")
        order = [self.columns.index(c) for c in EMIT_ORDER]
        if self.waiting.exists():
            rows = rows + [tuple(r) for r in self.waiting.get()]
        later = [r for r in rows if r[at] > passed]
        ready = sorted((r for r in rows if r[at] <= passed), key=lambda r: [(r[i] is not None, r[i] or 0) for i in order])
        if later:
            self.waiting.put(later)
            self._due(min(r[at] for r in later))
        else:
            self.waiting.clear()
        if not ready:
            return
        hist, n = self.history.get() if self.history.exists() else ([], 0)
        hist, length, made = list(hist), self.length, []
        dist = self.columns.index("dist")
        for r in ready:
            hist = [*hist, float(r[dist])][-length:]
            n += 1
            x = np.asarray(hist)
            made.append((min(n, length), len(x), float(x.mean()), float(x.std())))
            hist = hist[1 - length:] if length > 1 else []
        self.history.update((hist, n))
        out = pd.DataFrame(ready, columns=self.columns)
        out["ts"] = pd.to_datetime(BASE_US + out["emit_us"].astype("int64"), unit="us")
        yield pd.concat([out, pd.DataFrame(made, columns=["history_len", "ctx_n", "ctx_mean", "ctx_sd"])], axis=1)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        arrived = []
        for pdf in rows:
            pdf = pdf[self.columns].astype(object)
            arrived += zip(*[pdf[c].where(pdf[c].notna(), None).tolist() for c in self.columns])
        yield from self._advance(arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.timer.clear()
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())


def score_stream(flows: DataFrame, profile: Profile, t: Thresholds = DEFAULT_THRESHOLDS, cfg: FlowConfig = DEFAULT_FLOW,
                 host_col: str = "src_ip") -> DataFrame:
    """T2 after :func:`assemble_stream` in the same query: scored events, a host's history in the order of emission.

    Interim rows have no place in a history (as in batch) and are left out.
    """
    f = flows.filter("final")
    f = f if "src_ip" in f.columns else f.withColumn("src_ip", F.col("a_ip")).withColumn("dst_ip", F.col("b_ip"))
    f = f if "flow_no" in f.columns else f.withColumn("flow_no", F.col("first_us"))
    s = score_anomaly(score_routine(score_distances(f, profile), profile), profile)
    s = s.select(*[c for c in s.columns if c != "ts"], "ts")
    held = T.StructType([T.StructField(x.name, x.dataType) for x in s.schema.fields if x.name != "ts"])
    out = T.StructType([*held.fields, T.StructField("ts", T.TimestampType()), T.StructField("history_len", T.IntegerType()),
                        T.StructField("ctx_n", T.LongType()), T.StructField("ctx_mean", T.DoubleType()),
                        T.StructField("ctx_sd", T.DoubleType())])
    ctx = s.groupBy(host_col).transformWithStateInPandas(
        HostProcessor(held.fieldNames(), held, cfg.sequence_len), out, "Append", "EventTime", eventTimeColumnName="ts")
    ctx = ctx.withColumn("ctx_raw", F.expr(context_sql()))
    ctx = ctx.withColumns({k: F.expr(v) for k, v in gate_sqls(t, cfg).items()})
    return ctx.withColumns({k: F.expr(v) for k, v in verdict_sqls(t).items()})


def run_counting_late(stream: DataFrame, out_path: str, checkpoint: str, poll_s: float = 0.5, partitions: int | None = None) -> int:
    """Run ``stream`` with ``availableNow`` into Parquet and return how many rows came too late for the watermark.

    Spark drops such rows at each stateful operator and reports their number by micro-batch; the sum of the first
    operator, the one that reads the packets, is returned. ``partitions``: of the state, see :func:`rocksdb_state`.
    """
    late: dict[int, int] = {}
    with rocksdb_state(stream.sparkSession, partitions):
        q = (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        done = False
        while not done:
            done = q.awaitTermination(poll_s)
            for p in q.recentProgress:
                ops = p["stateOperators"]
                late[p["batchId"]] = max(late.get(p["batchId"], 0), max((o["numRowsDroppedByWatermark"] for o in ops), default=0))
    return sum(late.values())
