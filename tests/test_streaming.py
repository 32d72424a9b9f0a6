"""Replayed stream equals the batch key-clock flows."""

import os

from pyspark.sql import functions as F

from flowlens.plans import context as C
from flowlens.schema import FEATURES, KEY_COLS
from flowlens.streaming.flows import stream_flows
from flowlens.streaming.replay import packet_stream, run_to_table, work_dir

from conftest import SF001


def test_stream_equals_batch(spark):
    wd = work_dir(spark, "test-t1")
    ps = packet_stream(spark, C.packets(spark, SF001), os.path.join(wd, "in"), 4)
    run_to_table(stream_flows(ps), os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
    s = spark.read.parquet(os.path.join(wd, "out"))
    b = C.flows(spark, SF001)
    cols = KEY_COLS + ["first_us", "last_us", "emit_us"] + FEATURES

    def r(d):
        return d.select(*[F.round(c, 6).alias(c) if c in FEATURES else F.col(c) for c in cols])

    assert s.count() == b.count()
    assert r(b).exceptAll(r(s)).count() == 0
    # a stream cannot know the capture's end: flushed flows close by their timer instead
    diff = b.join(s.select(*KEY_COLS, "first_us", F.col("close_reason").alias("s_reason")), KEY_COLS + ["first_us"])
    assert diff.filter(F.col("close_reason") != F.col("s_reason")).filter(F.col("close_reason") != "flush").count() == 0


def test_late_packets_are_counted(spark):
    """Packets out of order across files give the flows of the rest in order; those beyond the watermark are counted."""
    from flowlens.operators.assemble import assign_flows
    from flowlens.operators.features import flow_features
    from flowlens.streaming import ordered
    from flowlens.streaming.flows import with_event_time
    from flowlens.streaming.replay import read_stream
    from helpers import FIN, packets, pk

    times = [0, 4, 21, 22, 60, 61, 40, 90, 130, 100, 101, 125, 200, 260, 250, 300]
    rows = [pk(k, t, flags=FIN if k in (8, 11) else 16) for k, t in enumerate(times)]
    rows += [pk(100 + k, t + 1, src="10.0.0.9") for k, t in enumerate(times)]
    late = [pk(200, 10), pk(201, 30, src="10.0.0.9")]
    behind = [pk(202, 180)]  # over 50 s behind the latest packet, but not behind the watermark of the batch before
    end = [pk(300, 900, capture="__sentinel__")]
    wd = work_dir(spark, "test-late")
    files = [[r for r in rows if r[0] % 100 in range(lo, lo + 4)] for lo in (0, 4, 8, 12)] + [late + behind, end]
    for i, part in enumerate(files):
        packets(spark, part).coalesce(1).write.parquet(os.path.join(wd, "in", f"part{i}"))
    ps = with_event_time(read_stream(spark, os.path.join(wd, "in"), packets(spark, rows).schema))
    n = ordered.run_counting_late(ordered.assemble_stream(ps, watermark="50 seconds", reorder=True),
                                  os.path.join(wd, "out"), os.path.join(wd, "ckpt"))
    assert n == len(late)
    got = spark.read.parquet(os.path.join(wd, "out")).select(*KEY_COLS, "first_us", "last_us", *FEATURES)
    want = flow_features(assign_flows(packets(spark, rows + behind))).select(*KEY_COLS, "first_us", "last_us", *FEATURES)
    assert got.count() == want.count() > 8 and want.exceptAll(got).isEmpty()
