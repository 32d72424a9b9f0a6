"""Hand-made packet tables for golden tests."""

from flowlens.schema import PACKET_SCHEMA

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
S = 1_000_000


def pk(seq, ts_s, src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80, proto=6, flags=ACK, length=100,
       capture="c"):
    return (seq, capture, int(round(ts_s * S)), length, proto, src, dst, sport, dport, 40 if proto == 6 else 28,
            flags if proto == 6 else 0)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET_SCHEMA)
