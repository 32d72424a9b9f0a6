"""Flow assembly goldens (Q1-Q6) and fixture counts."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators.assemble import assign_flows
from flowlens.operators.flows import build_flows
from flowlens.sources.fixtures import read_packets

from conftest import SF001
from helpers import ACK, FIN, RST, SYN, packets, pk


def flows_of(spark, rows, clock="key"):
    fp = assign_flows(packets(spark, rows), clock=clock)
    return sorted((r["seq"], r["flow_no"]) for r in fp.select("seq", "flow_no").collect())


def test_fixture_counts(spark):
    p = read_packets(spark, SF001)
    for clock, want in (("key", 605), ("capture", 579)):
        fp = assign_flows(p, clock=clock)
        assert fp.select("capture_id", "a_ip", "a_port", "b_ip", "b_port", "proto", "flow_no").distinct().count() == want
        assert fp.count() == p.count()          # every packet in exactly one flow


def test_rst_closes_and_next_packet_opens(spark):
    rows = [pk(1, 0.0, flags=SYN), pk(2, 1.0, flags=RST), pk(3, 2.0)]
    assert flows_of(spark, rows) == [(1, 1), (2, 1), (3, 2)]


def test_two_fins_close_one_does_not(spark):
    rows = [pk(1, 0.0, flags=FIN | ACK), pk(2, 1.0), pk(3, 2.0, flags=FIN | ACK), pk(4, 3.0)]
    assert flows_of(spark, rows) == [(1, 1), (2, 1), (3, 1), (4, 2)]
    one = [pk(1, 0.0, flags=FIN | ACK), pk(2, 1.0), pk(3, 2.0)]
    assert flows_of(spark, one) == [(1, 1), (2, 1), (3, 1)]


def test_udp_flag_bits_never_close(spark):
    rows = [pk(i, float(i), proto=17, flags=RST) for i in range(1, 4)]
    assert flows_of(spark, rows) == [(1, 1), (2, 1), (3, 1)]


def test_idle_gap_key_vs_capture_clock(spark):
    # exactly 15 s idle, no other traffic: key clock splits, capture clock joins (Q4)
    rows = [pk(1, 0.0), pk(2, 15.0)]
    assert flows_of(spark, rows, "key") == [(1, 1), (2, 2)]
    assert flows_of(spark, rows, "capture") == [(1, 1), (2, 1)]
    # another key's packet in between moves the capture clock: both split
    other = rows[:1] + [pk(9, 16.0, src="10.9.9.9")] + [pk(2, 17.0)]
    assert dict(flows_of(spark, other, "capture"))[2] == 2


def test_active_timeout(spark):
    rows = [pk(i, i * 10.0) for i in range(14)]          # 0..130 s, gaps of 10 s
    got = dict(flows_of(spark, rows, "key"))
    assert got[12] == 2 and got[11] == 1                  # packet at 120 s opens flow 2
    cap = dict(flows_of(spark, rows, "capture"))
    assert cap[12] == 1 and cap[13] == 2                  # crossing packet is included, then closes


def test_text_ordering_and_direction(spark):
    # '10.10.2.10' < '9.9.9.9' as text: endpoint a is the 10.x host (Q2)
    rows = [pk(1, 0.0, src="9.9.9.9", dst="10.10.2.10", sport=22, dport=40000)]
    r = assign_flows(packets(spark, rows)).first()
    assert (r["a_ip"], r["b_ip"], r["fwd"]) == ("10.10.2.10", "9.9.9.9", False)


def test_single_packet_and_empty_backward_side(spark):
    f = build_flows(packets(spark, [pk(1, 5.0, length=60)])).first()
    assert f["flow_duration"] == 0.0
    assert f["flow_pkts_per_s"] == pytest.approx(1 / 1e-6)
    assert f["bwd_pkt_len_max"] == 0.0 and f["bwd_iat_mean"] == 0.0 and f["down_up_ratio"] == 0.0


def test_features_match_packet_math(spark):
    rows = [pk(1, 0.0, length=100), pk(2, 1.0, src="10.0.0.2", dst="10.0.0.1", sport=80, dport=1000, length=300),
            pk(3, 3.0, length=200)]
    f = build_flows(packets(spark, rows)).first()
    assert f["total_packets"] == 3 and f["total_fwd_packets"] == 2 and f["total_bwd_packets"] == 1
    assert f["pkt_len_mean"] == pytest.approx(200.0)
    assert f["pkt_len_std"] == pytest.approx((20000 / 3) ** 0.5)
    assert f["flow_iat_mean"] == pytest.approx(1.5) and f["fwd_iat_total"] == pytest.approx(3.0)
    assert f["close_reason"] == "flush"


def test_swapping_direction_keeps_features(spark):
    from flowlens.schema import FEATURES
    rows = [pk(1, 0.0, length=100), pk(2, 1.0, src="10.0.0.2", dst="10.0.0.1", sport=80, dport=1000, length=300)]
    swapped = [(s, c, t, ln, pr, dst, src, dp, sp, h, fl) for (s, c, t, ln, pr, src, dst, sp, dp, h, fl) in rows]
    a = build_flows(packets(spark, rows)).select(*FEATURES).first()
    b = build_flows(packets(spark, swapped)).select(*FEATURES).first()
    # swapping every packet's endpoints swaps nothing in the canonical key
    assert a["total_packets"] == b["total_packets"]
    assert a["total_fwd_bytes"] == b["total_bwd_bytes"] and a["total_bwd_bytes"] == b["total_fwd_bytes"]


def test_sum_of_packets(spark):
    p = read_packets(spark, SF001)
    f = build_flows(p)
    assert f.agg(F.sum("total_packets")).first()[0] == p.count()


def test_packet_times_ignore_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        sums = []
        for tz in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            sums.append(read_packets(spark, SF001).agg(F.sum("ts_us")).first()[0])
        assert sums[0] == sums[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
