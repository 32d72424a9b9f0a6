"""Rows as blocks of arrays that executors hold between the jobs of an iterative fit.

A fit is hundreds or thousands of short jobs over the same rows. As blocks they are read and converted once, and a job costs
what its own numbers cost: no scan, no plan, no conversion by row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from ..session import materialised

#: Bytes of a block at about most.
BLOCK_BYTES = 16 << 20
#: Memory of the executors, disk beyond it.
HELD = StorageLevel.MEMORY_AND_DISK


def merged(blocks: Iterator[tuple], rows: int) -> Iterator[tuple]:
    """Blocks of fewer rows joined, in their order, until they have ``rows``."""
    held, n = [], 0
    for b in blocks:
        held.append(b)
        n += len(b[0])
        if n >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def blocks(data: DataFrame, convert: Callable[..., tuple], row_bytes: int, name: str) -> RDD:
    """Tuples of arrays with a row for each row of ``data``, which ``convert`` makes of Arrow batches; written once, so that a
    lost executor re-reads files."""
    rows = max(1, BLOCK_BYTES // row_bytes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, rows):
                block = pickle.dumps(convert(b.slice(start, rows)), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    written = materialised(data.mapInArrow(run, "block binary"), name)
    return written.rdd.mapPartitions(lambda found: merged((pickle.loads(r[0]) for r in found), max(1, rows // 2)))
