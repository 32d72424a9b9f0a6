"""Work that must not grow faster than the rows: how often an input is read, how many tasks a fit takes."""

import glob
import os

from flowlens.operators import dataset as DS
from flowlens.operators import models as MD
from flowlens.streaming.replay import work_dir, write_slices


def counted(df):
    """``df`` and a counter of the rows that were read of it."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), rows


def test_slices_are_written_from_their_own_rows(spark):
    times = [None if k % 50 == 49 else 7 * k % 400 for k in range(500)] + [123] * 60
    df = spark.createDataFrame([(t, k, "x" * (k % 3)) for k, t in enumerate(times)], "ts_us long, seq long, v string").repartition(3)
    want = sorted((r.ts_us, r.seq, r.v) for r in df.collect() if r.ts_us is not None)
    for files in (8, 20):
        table, rows = counted(df)
        path = os.path.join(work_dir(spark, "test-slices"), "in")
        write_slices(table, path, ["ts_us", "seq"], files)
        assert rows.value <= 3 * len(times)  # their number, their boundaries, their writing, however many slices
        parts = sorted(glob.glob(path.removeprefix("file:") + "/part*/*.parquet"))
        got = [[tuple(r) for r in spark.read.parquet(p).collect()] for p in parts]
        assert len(parts) > files // 2 and sum(got, []) == want
        assert [os.path.getmtime(p) for p in parts] == sorted(os.path.getmtime(p) for p in parts)


def test_one_slice_keeps_rows_without_time(spark):
    df = spark.createDataFrame([(None, 1), (5, 2)], "ts_us long, seq long")
    assert write_slices(df, os.path.join(work_dir(spark, "test-slices"), "in"), ["ts_us", "seq"], 1).count() == 2


def test_split_reads_its_input_once(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 9 else int(k % 3 == 0)) for k in range(600)], "id long, label int")
    table, rows = counted(df)
    out = DS.stratified_split(table, 0.25, 42, table["id"]).collect()
    assert rows.value == 600 == len(out)
    for label in (0, 1, None):
        mine = [r.is_test for r in out if r.label == label]
        assert sum(mine) == int(len(mine) * 0.25 + 0.5)


def test_partitions_of_a_fit_follow_its_rows(spark):
    class Fit:
        def fit(self, data):
            return data.rdd.getNumPartitions(), data.count()

    assert MD._fit_persisted(Fit(), spark.range(1000).repartition(40)) == (1, 1000)
    assert MD._fit_persisted(Fit(), spark.range(3 * MD.FIT_ROWS + 1).repartition(40)) == (4, 3 * MD.FIT_ROWS + 1)
    assert MD._fit_persisted(Fit(), spark.range(3 * MD.FIT_ROWS + 1).repartition(2))[0] == 2
