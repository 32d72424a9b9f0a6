"""Flow assembly: split each canonical key's packets into flows.

Rules (packets of one key in ``(ts_us, seq)`` order; ``first``/``last`` are the
open flow's first and latest packet; ``prev`` is the previous packet of the
whole capture):

* ``clock="key"``: a packet opens a new flow if the previous packet closed
  the flow, or ``ts - last >= idle``, or ``ts - first >= active``.
* ``clock="capture"``: a packet opens a new flow if the previous packet
  closed it, or ``prev - last >= idle``, or ``prev - first >= active``; a
  packet with ``ts - first >= active`` is added and then closes its flow.
* both: a TCP packet closes its flow when it carries RST or the flow's FIN
  count reaches two.

Plan. Idle gaps and RST closes depend only on the previous packet, so
*islands* come from ``lag`` + running ``sum`` windows (JVM, codegen). An
island is a single flow unless it spans the active timeout or has a FIN close
before its last packet. Only those islands need the ordered fold, which runs
in a sorted, streaming ``mapInArrow`` pass: memory is one Arrow batch plus a
few integers of state, never a collected group.

A key with more than ``hot_rows`` packets is too long for one task, islands
and all. Such keys are cut into blocks by time: islands from carried values
(``windows.last_before``), flow starts as a chain by pointer doubling over
blocks (``chains.mark_starts``), flow numbers and gaps from carried sums.

The capture clock needs each packet's predecessor in the whole capture. It is
computed per (capture, range of time) with a carry of the previous non-empty
range's last timestamp; the ranges hold equal shares of all packets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import flag_bit, with_flow_key
from ..schema import KEY_COLS
from ..session import materialised
from ..settings import DEFAULT_FLOW, FlowConfig
from .chains import mark_starts
from .windows import last_before, positions, running_sum

_KEY_ORDER = ["ts_us", "seq"]


def _key_window(*extra: str) -> Window:
    return Window.partitionBy(*KEY_COLS, *extra).orderBy(*_KEY_ORDER)


def with_capture_prev(packets: DataFrame) -> DataFrame:
    """Add ``prev_cap_us``: timestamp of the previous packet of the same capture (a null capture is one like others).

    A capture is cut into time ranges that hold equal shares of all packets, with a carry table of one row per capture and
    range, so that no task holds a capture, however fast it is.
    """
    placed = positions(packets, ["capture_id"], _KEY_ORDER, "_cap")
    return placed.withColumnRenamed("_cap_prev", "prev_cap_us").drop("_cap_no", "_cap_first")


_FLOW_COLS = KEY_COLS + ["seq", "ts_us", "fwd", "length", "header_len", "tcp_flags"]
FLOW_PACKET_COLS = _FLOW_COLS + ["flow_no", "gap_all", "gap_dir"]


def _make_fold(active_us: int, capture_clock: bool):
    """Ordered pass over packets sorted by (key, ts_us, seq).

    Emits ``flow_no`` and the inter-arrival gaps ``gap_all`` (previous packet of
    the flow) and ``gap_dir`` (previous packet of the flow in the same
    direction). Flow numbering and gaps are vectorised; only rows of complex
    islands step through the active-timeout / FIN rule. State carried between
    batches is a handful of scalars.
    """

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        st = {"key": None, "flow_no": 0, "f": 0, "c": 0, "closed": False,
              "last_ts": None, "dir_ts": {True: None, False: None}}
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            kc = np.zeros(n, dtype=bool)
            for k in KEY_COLS:
                col = batch.column(k)
                if n > 1:
                    ne = pc.not_equal(col.slice(1), col.slice(0, n - 1))
                    kc[1:] |= ne.to_numpy(zero_copy_only=False)
            first_key = tuple(batch.column(k)[0].as_py() for k in KEY_COLS)
            kc[0] = first_key != st["key"]
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False).astype(np.int64)
            isl = batch.column("_isl_start").to_numpy(zero_copy_only=False).astype(bool)
            cplx = batch.column("_complex").to_numpy(zero_copy_only=False).astype(bool)
            fwd = batch.column("fwd").to_numpy(zero_copy_only=False).astype(bool)
            fs = isl | kc
            idx = np.flatnonzero(cplx)
            if len(idx):
                ref = (batch.column("prev_cap_us").to_numpy(zero_copy_only=False)
                       if capture_clock else ts)
                fin = batch.column("fin_bit").to_numpy(zero_copy_only=False)
                rst = batch.column("rst_bit").to_numpy(zero_copy_only=False)
                tcp = batch.column("proto").to_numpy(zero_copy_only=False) == 6
                f, c, closed = st["f"], st["c"], st["closed"]
                for i in idx.tolist():
                    t = int(ts[i])
                    if fs[i]:
                        f, c, closed = t, 0, False
                    elif closed or int(ref[i]) - f >= active_us:
                        fs[i] = True
                        f, c = t, 0
                    c += int(fin[i])
                    closed = bool(tcp[i] and (rst[i] or c >= 2))
                    if capture_clock and t - f >= active_us:
                        closed = True
                st["f"], st["c"], st["closed"] = f, c, closed
            # flow_no: running count of flow starts, restarting at each key
            cs = np.cumsum(fs, dtype=np.int64)
            starts = np.flatnonzero(kc)
            seg = np.cumsum(kc)
            base = np.empty(len(starts) + 1, dtype=np.int64)
            base[0] = -st["flow_no"]
            base[1:] = cs[starts] - 1
            flow_no = cs - base[seg]
            # gap to the previous packet of the same flow
            gap_all = np.zeros(n, dtype=np.int64)
            valid_all = ~fs
            gap_all[1:] = ts[1:] - ts[:-1]
            if not fs[0] and st["last_ts"] is not None:
                gap_all[0] = ts[0] - st["last_ts"]
            elif not fs[0]:
                valid_all[0] = False
            # gap to the previous packet of the same flow and direction
            gap_dir = np.zeros(n, dtype=np.int64)
            valid_dir = np.zeros(n, dtype=bool)
            new_dir = dict(st["dir_ts"]) if cs[-1] == 0 else {True: None, False: None}
            for d in (True, False):
                ix = np.flatnonzero(fwd == d)
                if not len(ix):
                    continue
                cur, prv = ix[1:], ix[:-1]
                same = cs[cur] == cs[prv]
                gap_dir[cur] = ts[cur] - ts[prv]
                valid_dir[cur] = same
                j = ix[0]
                if cs[j] == 0 and st["dir_ts"][d] is not None:
                    gap_dir[j] = ts[j] - st["dir_ts"][d]
                    valid_dir[j] = True
                last_flow = ix[cs[ix] == cs[-1]]
                if len(last_flow):
                    new_dir[d] = int(ts[last_flow[-1]])
            st["dir_ts"] = new_dir
            st["key"] = tuple(batch.column(k)[n - 1].as_py() for k in KEY_COLS)
            st["flow_no"] = int(flow_no[-1])
            st["last_ts"] = int(ts[-1])
            keep = [batch.column(batch.schema.get_field_index(c_)) for c_ in _FLOW_COLS]
            yield pa.RecordBatch.from_arrays(
                keep + [pa.array(flow_no, type=pa.int64()),
                        pa.array(gap_all, type=pa.int64(), mask=~valid_all),
                        pa.array(gap_dir, type=pa.int64(), mask=~valid_dir)],
                names=FLOW_PACKET_COLS)

    return fold


#: Packets of one key beyond which it is spread over many tasks.
HOT_ROWS = 4_000_000


def assign_flows(packets: DataFrame, cfg: FlowConfig = DEFAULT_FLOW, clock: str = "key",
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """packets -> one row per packet with the canonical key, ``fwd``,
    ``flow_no`` (flows per key counted from 1 in time order) and the W4
    inter-arrival gaps ``gap_all`` / ``gap_dir`` in µs (null on a flow's first
    packet, overall / per direction).

    Keys with more than ``hot_rows`` packets are spread over many tasks. To
    find them, rows are counted first, and counted by key if there are that
    many (None: no such keys, nothing is counted).
    """
    if clock not in ("key", "capture"):
        raise ValueError("clock must be 'key' or 'capture'")
    p = with_flow_key(packets.withColumn("capture_id", F.coalesce(F.col("capture_id"), F.lit(""))))
    p = p.withColumns({
        "fin_bit": flag_bit("tcp_flags", "fin"),
        "rst_bit": flag_bit("tcp_flags", "rst"),
    })
    if clock == "capture":
        p = with_capture_prev(p)
    extra = ["prev_cap_us"] if clock == "capture" else []
    p = p.select(*_FLOW_COLS, "fin_bit", "rst_bit", *extra)
    hot = None if hot_rows is None or packets.count() <= hot_rows else hot_keys(packets, hot_rows)
    if hot is None:
        return _folded_keys(p, cfg, clock)
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in KEY_COLS]
    cool = p.join(hot, same, "left_anti")
    return _folded_keys(cool, cfg, clock).unionByName(spread_keys(p.join(hot, same), cfg, clock))


def hot_keys(packets: DataFrame, hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` packets, numbered (``_hot``), or None; at most rows / ``hot_rows`` of them."""
    keyed = with_flow_key(packets.withColumn("capture_id", F.coalesce(F.col("capture_id"), F.lit(""))))
    many = keyed.groupBy(*KEY_COLS).count().filter(F.col("count") > hot_rows)
    found = materialised(many.select(*[F.col(k).alias(f"_h_{k}") for k in KEY_COLS],
                                     F.monotonically_increasing_id().alias("_hot")), "hot-keys")
    return None if found.isEmpty() else found


def spread_keys(p: DataFrame, cfg: FlowConfig, clock: str, buckets: int | None = None) -> DataFrame:
    """Packets of numbered keys (``_hot``) -> the columns of :func:`assign_flows`; no task holds a whole key or island."""
    part = ["_hot"]
    ref = "prev_cap_us" if clock == "capture" else "ts_us"
    rst = F.when((F.col("rst_bit") == 1) & (F.col("proto") == 6), F.lit(1)).otherwise(F.lit(0))
    p = last_before(p, part, _KEY_ORDER, {"_p_ts": F.col("ts_us"), "_p_rst": rst}, "ts_us")
    forced = F.col("_p_ts").isNull() | (F.col(ref) - F.col("_p_ts") >= cfg.idle_us) | (F.col("_p_rst") == 1)
    fin = F.when(F.col("proto") == 6, F.col("fin_bit")).otherwise(F.lit(0))
    p = mark_starts(p.withColumns({"_isl": forced, "_fin": fin}), "_hot", _KEY_ORDER, cfg.active_us, ref, "_isl", "_fin", buckets)
    p = running_sum(p, part, _KEY_ORDER, F.col("is_start").cast("int"), "flow_no", "ts_us")
    p = last_before(p, [*part, "fwd"], _KEY_ORDER, {"_d_ts": F.col("ts_us"), "_d_no": F.col("flow_no")}, "ts_us")
    return p.select(*_FLOW_COLS, "flow_no",
                    F.when(~F.col("is_start"), F.col("ts_us") - F.col("_p_ts")).alias("gap_all"),
                    F.when(F.col("_d_no") == F.col("flow_no"), F.col("ts_us") - F.col("_d_ts")).alias("gap_dir"))


def _folded_keys(p: DataFrame, cfg: FlowConfig, clock: str) -> DataFrame:
    """A key's packets in one task: islands by windows, the ordered fold inside complex ones."""
    idle, active = cfg.idle_us, cfg.active_us
    # One hash exchange on the key; every later window/group refines it.
    p = p.repartition(*KEY_COLS)
    wk = _key_window()
    ref = F.col("prev_cap_us") if clock == "capture" else F.col("ts_us")
    prev_ts = F.lag("ts_us").over(wk)
    prev_rst = F.lag((F.col("rst_bit") == 1) & (F.col("proto") == 6)).over(wk)
    p = p.withColumn("_isl_start", (prev_ts.isNull() | (ref - prev_ts >= idle) | prev_rst).cast("int"))
    p = p.withColumn("island", F.sum("_isl_start").over(wk.rowsBetween(Window.unboundedPreceding, 0)))

    wi = Window.partitionBy(*KEY_COLS, "island")
    wio = _key_window("island").rowsBetween(Window.unboundedPreceding, 0)
    p = (p.withColumn("_cum_fin", F.sum("fin_bit").over(wio))
          .withColumn("_isl_first", F.min("ts_us").over(wi))
          .withColumn("_isl_last", F.max("ts_us").over(wi))
          .withColumn("_fin_closes", F.sum(((F.col("_cum_fin") >= 2) & (F.col("proto") == 6)).cast("int")).over(wi)))
    p = p.withColumn("_complex", (F.col("_isl_last") - F.col("_isl_first") >= active)
                     | (F.col("_fin_closes") >= 2))
    p = p.sortWithinPartitions(*KEY_COLS, *_KEY_ORDER)
    out_schema = T.StructType([p.schema[c] for c in _FLOW_COLS]
                              + [T.StructField(c, T.LongType()) for c in ("flow_no", "gap_all", "gap_dir")])
    return p.mapInArrow(_make_fold(active, clock == "capture"), out_schema)


def capture_ends(packets: DataFrame) -> DataFrame:
    """Last packet time per capture (tiny: one row per capture)."""
    return (packets.groupBy(F.coalesce(F.col("capture_id"), F.lit("")).alias("capture_id"))
            .agg(F.max("ts_us").alias("capture_end_us")))


def close_reason_sqls(cfg: FlowConfig = DEFAULT_FLOW, clock: str = "key") -> dict[str, str]:
    """F3/F7 as SQL over ``first_us, last_us, fin_flag_count, rst_flag_count,
    proto, capture_end_us`` (shared with the oracle).

    ``tcp_close`` (RST, or two FINs) and, in capture clock, ``active`` on the
    packet that crosses the active timeout emit at the last packet. Other
    flows expire by timer at ``min(last + idle, first + active)``: ``idle`` or
    ``active`` when the capture runs past that time, ``flush`` when the
    capture ends first (end-of-capture flush; emitted at the timer time too).
    """
    idle, active = cfg.idle_us, cfg.active_us
    timer = f"least(last_us + {idle}, first_us + {active})"
    tcp = "(proto = 6 AND (rst_flag_count > 0 OR fin_flag_count >= 2))"
    own = f"(last_us - first_us >= {active})" if clock == "capture" else "FALSE"
    reason = (f"CASE WHEN {tcp} THEN 'tcp_close' WHEN {own} THEN 'active' "
              f"WHEN capture_end_us < {timer} THEN 'flush' "
              f"WHEN last_us + {idle} <= first_us + {active} THEN 'idle' ELSE 'active' END")
    emit = f"CAST(CASE WHEN {tcp} OR {own} THEN last_us ELSE {timer} END AS BIGINT)"
    return {"close_reason": reason, "emit_us": emit}


def with_close_reason(flows: DataFrame, ends: DataFrame, cfg: FlowConfig = DEFAULT_FLOW,
                      clock: str = "key") -> DataFrame:
    """Add ``close_reason`` and ``emit_us`` (see :func:`close_reason_sqls`).

    ``ends`` has one row per capture; under AQE this join becomes a broadcast
    hash join at runtime once its measured size is under the threshold.
    """
    out = flows.join(ends, "capture_id", "left")
    out = out.withColumns({k: F.expr(v) for k, v in close_reason_sqls(cfg, clock).items()})
    return out.drop("capture_end_us")


def min_packets(flows: DataFrame, n: int = 1) -> DataFrame:
    """keep flows with at least ``n`` packets."""
    return flows.filter(F.col("total_packets") >= n)


def min_packets_counts(flows: DataFrame, n: int = 1) -> DataFrame:
    """F5 counters: flows kept and skipped."""
    return flows.agg(F.count_if(F.col("total_packets") >= n).alias("kept"),
                     F.count_if(F.col("total_packets") < n).alias("skipped"))
