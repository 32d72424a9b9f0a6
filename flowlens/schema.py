"""Column names and types shared by every operator.

The flow feature list is the contract between flow assembly, scoring and
training: its order defines the layout of feature vectors and flattened
sequences.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the 52 flow features, in contractual order -------------
FEATURES: list[str] = [
    "flow_duration", "total_fwd_packets", "total_bwd_packets", "total_packets",
    "total_fwd_bytes", "total_bwd_bytes", "total_bytes",
    "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
    "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
    "pkt_len_max", "pkt_len_min", "pkt_len_mean", "pkt_len_std", "pkt_len_var",
    "flow_bytes_per_s", "flow_pkts_per_s", "fwd_pkts_per_s", "bwd_pkts_per_s",
    "down_up_ratio",
    "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min",
    "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
    "bwd_iat_total", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
    "ack_flag_count", "urg_flag_count",
    "fwd_header_len", "bwd_header_len", "avg_pkt_size", "fwd_seg_size_avg",
    "bwd_seg_size_avg",
    "protocol", "dst_port",
]
# --- fixed values: TCP flag bit masks ---------------------------------------
TCP_FLAGS: dict[str, int] = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
# --- fixed values: legacy per-packet feature columns, in order --------------
LEGACY_FEATURES: list[str] = [
    "frame.number", "frame.time_relative", "frame.len", "frame.time_delta",
    "ip.proto", "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport",
    "tcp.flags", "icmp.type", "icmp.seq", "mqtt.msgtype",
]

NUM_FEATURES = len(FEATURES)
LABEL = "label"
US = 1_000_000

# Canonical bidirectional flow key (endpoint a <= endpoint b).
KEY_COLS: list[str] = ["capture_id", "a_ip", "a_port", "b_ip", "b_port", "proto"]
FLOW_ID_COLS: list[str] = KEY_COLS + ["flow_no"]

PACKET_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("capture_id", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("header_len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
])

# Flow CSV layout: features, then endpoint text, attack type and label.
FLOW_CSV_SCHEMA = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("src_ip", T.StringType()),
       T.StructField("dst_ip", T.StringType()),
       T.StructField("attack_type", T.StringType()),
       T.StructField(LABEL, T.IntegerType())]
)

MANIFEST_SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField(LABEL, T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
])
