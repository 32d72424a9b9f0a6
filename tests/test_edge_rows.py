"""Rows that simple inputs don't have: no source, long silences, reordered columns, late fragments, renewed blocks."""

import struct

import pandas as pd
from pyspark.sql import functions as F

from flowlens.operators.analytics import alert_feed, query_events
from flowlens.operators.dataset import stratified_split
from flowlens.operators.flows import build_flows
from flowlens.operators.response import MSG_NO_SOURCE, with_action
from flowlens.operators.scoring import with_host_context
from flowlens.operators.windows import global_rank, last_before
from flowlens.plans import context as C
from flowlens.schema import FEATURES
from flowlens.settings import Policy
from flowlens.sources.captures import decode_frame
from flowlens.sources.files import read_flows, write_flows
from flowlens.streaming.operators import BASE_US, _response_fn

from conftest import SF001
from helpers import packets, pk


def test_rows_without_a_source_stay(spark):
    e = C.events(spark, SF001).withColumn("src_ip", F.when(F.col("flow_no") % 3 != 0, F.col("src_ip")))
    n, without = e.count(), e.where("src_ip IS NULL").count()
    out = with_action(e.drop("alert_count", "action_type", "action_message"))
    assert without > 0 and out.count() == n
    none = out.where("src_ip IS NULL").select("action_type", "action_message").distinct().collect()
    assert [tuple(r) for r in none] == [("observe", MSG_NO_SOURCE)]


def test_null_keys_in_ordered_windows(spark):
    df = spark.createDataFrame([(k, t, t) for k in ("a", None) for t in range(5)], "k string, t long, v long")
    got = {(r.k, r.t): r.pos for r in global_rank(df, ["k"], ["t"], "pos", time_col="t", bucket_us=2).collect()}
    assert got == {(k, t): t + 1 for k in ("a", None) for t in range(5)}
    prev = last_before(df, ["k"], ["t"], {"p": F.col("v")}, "t", 2)
    assert {(r.k, r.t): r.p for r in prev.collect()} == {(k, t): (t - 1 if t else None) for k in ("a", None) for t in range(5)}


def test_zero_rows_are_left_out_of_the_host_frame(spark):
    rows = [("h", i, i, float(i), 0.0 if i == 2 else 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "src_ip string, emit_us long, pos long, dist double, f double")
    df = df.select("src_ip", "emit_us", "pos", "dist", *[F.col("f").alias(c) for c in FEATURES])
    out = with_host_context(df, order_cols=["emit_us", "pos"]).where("pos = 3").first()
    assert out.ctx_n == 3 and abs(out.ctx_mean - 4 / 3) < 1e-12 and out.history_len == 4


def test_long_silence_in_the_capture_clock(spark):
    f = build_flows(packets(spark, [pk(1, 0.0, proto=17), pk(2, 4000.0, proto=17)]), clock="capture").collect()
    assert sum(r.total_packets for r in f) == 2  # squared gaps don't overflow


def test_flow_csv_is_read_by_name(spark, tmp_path):
    f = C.flows(spark, SF001).limit(20)
    write_flows(f, str(tmp_path / "a"))
    back = read_flows(spark, str(tmp_path / "a"))
    back.select(*reversed(back.columns)).write.option("header", True).csv(str(tmp_path / "b"))
    again = read_flows(spark, str(tmp_path / "b"))
    assert again.columns == back.columns
    assert again.exceptAll(back).count() == 0 and back.count() == 20


def test_later_fragments_have_no_ports():
    head = bytes([0x45, 0, 0, 40, 0, 0, 0, 1, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    frame = b"\x00" * 12 + b"\x08\x00" + head + b"ABCDEFGH"
    assert decode_frame(1, frame) == (17, "10.0.0.1", "10.0.0.2", 0, 0, 20, 0)
    first = bytearray(frame)
    first[14 + 7] = 0
    first[34:38] = struct.pack(">HH", 53, 99)
    assert decode_frame(1, bytes(first))[3:5] == (53, 99)


class _State:
    """The part of a group state that the function uses."""

    def __init__(self, watermark_us):
        self.value, self.timer, self.mark, self.hasTimedOut = None, None, (BASE_US + watermark_us) // 1000, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, ms):
        self.timer = ms


def test_blocks_that_run_out_between_alerts_are_lifted():
    policy = Policy(auto_block=True, block_threshold=1, block_duration_seconds=300)
    rows = pd.DataFrame({"emit_us": [0, 10_000_000_000], "status": ["ATTACK"] * 2, "first_us": [0, 0], "a_ip": "a"})
    for c in ("capture_id", "a_port", "b_ip", "b_port", "proto", "flow_no"):
        rows[c] = 0
    state = _State(0)
    out = pd.concat(list(_response_fn(policy)(("ip",), iter([rows]), state)))
    assert out.action_type.tolist() == ["block", "unblock", "block"] and out.t_us.tolist()[1] == 300_000_000
    assert state.timer == (BASE_US + 10_300_000_000) // 1000
    late = _State(20_000_000_000)  # no timer can fire for the last one
    out = pd.concat(list(_response_fn(policy)(("ip",), iter([rows]), late)))
    assert out.action_type.tolist() == ["block", "unblock", "block", "unblock"] and late.value[1] is None


def test_limits_are_the_callers(spark):
    e = C.events(spark, SF001)
    many = e.withColumn("status", F.lit("ATTACK")).crossJoin(spark.range(4)).drop("id")
    assert alert_feed(many, limit=2000).count() == 2000
    assert query_events(many, limit=1500).count() == 1500


def test_rows_without_a_label_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "id long, label int")
    out = stratified_split(df, 0.25, row_id=F.col("id").cast("string"))
    assert out.count() == 40
    assert {r.label: r.n for r in out.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 5, None: 5}


def test_packets_of_a_null_capture_are_kept(spark):
    """P11, S7 and the capture clock take a null capture as a capture; a fast capture is cut within a minute too."""
    from flowlens.operators.analytics import packet_row_features
    from flowlens.operators.assemble import with_capture_prev
    from flowlens.sources.legacy import legacy_packets
    from helpers import packets, pk

    rows = [pk(k, t, capture=c) for k, (t, c) in enumerate([(0, None), (1, "a"), (20, None), (40, None), (60.5, "a"), (130, None)])]
    df = packets(spark, rows)
    got = {r.seq: (r.frame_number, r.delta_us // 1_000_000) for r in packet_row_features(df).collect()}
    assert got == {0: (1, 0), 2: (2, 20), 3: (3, 20), 5: (4, 90), 1: (1, 0), 4: (2, 59)}
    assert {r.seq: r.prev_cap_us for r in with_capture_prev(df).collect()} == {
        0: None, 1: None, 2: 0, 3: 20_000_000, 4: 1_000_000, 5: 40_000_000}
    legacy = {r.seq: r["frame.time_relative"] for r in legacy_packets(df).collect()}
    assert len(legacy) == 6 and legacy[5] == "130.000000" and legacy[4] == "59.500000"
