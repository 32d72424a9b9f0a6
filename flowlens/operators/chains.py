"""Chains of starts over the rows of one hot key, by pointer doubling over blocks.

A row may open something that lasts: a flow until the active timeout or its second FIN, a block of a source until it
runs out. The next one starts at a row that follows from the present start alone, so the starts are a chain from the
key's first row, and a plain fold walks it in one task. Here the key's rows are cut into blocks of about equal size:

1. In each block, every row gets the row at which its chain leaves the block (its *tail*), as if it were a start.
2. The successor of a tail lies in another block. What depends on counts (forced starts, hits) comes from a carry table
   with a row for each block; what depends on time is looked up in the block that holds that time.
3. Successors of tails, and the first row, are the only rows at which the chain can enter a block. Their pointers
   (entry -> entry of a later block) are doubled until all entries that the first row reaches are known.
4. Each block walks its own part of the chain from its entry.

A task holds one block, or one block and the tails of another one that look into it. Rows with one and the same time stay
in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised, ship_package
from .windows import bucket_splits, with_bucket

_FAR = np.iinfo(np.int64).max
_COLS = ["_part", "_bkt", "_pos", "_t", "_ref", "_forced", "_hit"]


def block_next(t: np.ndarray, ref: np.ndarray, forced: np.ndarray, hit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(next, left): by row the index of the next start if the row is one, len(t) and more where that is outside the block,
    and how many hits that takes there (0: the row after the block's last is the start, if no other rule comes first)."""
    n = len(t)
    index = np.arange(n)
    stops = np.r_[np.flatnonzero(forced), n]
    nxt = stops[np.searchsorted(stops, index, "right")] if n else index
    nxt = np.minimum(nxt, np.searchsorted(ref, t + width, "left"))
    at = np.flatnonzero(hit)
    before = np.cumsum(hit) - hit
    second = before + 1  # the second hit from the row on
    inside = second < len(at)
    closes = np.full(n, n + 1)
    closes[inside] = at[second[inside]] + 1
    left = np.where(inside, 0, 2 - (len(at) - before))
    return np.minimum(nxt, closes), left


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by part, bucket and position -> one table for each block."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        part, bkt = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cut = np.flatnonzero((part[1:] != part[:-1]) | (bkt[1:] != bkt[:-1])) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = (part[lo], bkt[lo])
            if last is not None and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _arrays(block: pa.Table) -> list[np.ndarray]:
    return [block.column(c).to_numpy() for c in ("_t", "_ref", "_forced", "_hit")]


def _tails(rows: DataFrame, width: int) -> DataFrame:
    """Rows with their block's carry -> (_part, _bkt, _pos, tail, x, cst): x and cst for tails only.

    ``x``: the time from which the next start is due; ``cst``: the position at which a count calls for it, if that is known.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            t, ref, forced, hit = _arrays(block)
            n, pos = len(t), block.column("_pos").to_numpy()
            nxt, left = block_next(t, ref, forced, hit, width)
            out = nxt >= n
            tail = np.where(out, np.arange(n), np.minimum(nxt, n - 1))
            while not np.array_equal(tail, tail[tail]):
                tail = tail[tail]
            stop, one, two = (block.column(c)[0].as_py() for c in ("_f_next", "_h_next", "_h_second"))
            after = np.array([pos[-1] + 1, _FAR if one is None else one + 1, _FAR if two is None else two + 1])
            cst = np.minimum(after[left], _FAR if stop is None else stop)
            none = ~out
            yield pa.RecordBatch.from_arrays(
                [block.column("_part").combine_chunks(), block.column("_bkt").combine_chunks(), pa.array(pos),
                 pa.array(pos[tail]), pa.array(t + width, mask=none), pa.array(cst, mask=none | (cst == _FAR))],
                names=["_part", "_bkt", "_pos", "tail", "x", "cst"])

    return rows.mapInArrow(run, "_part long, _bkt long, _pos long, tail long, x long, cst long")


def _walked(rows: DataFrame, width: int) -> DataFrame:
    """Rows with ``_entry``, the position at which the chain enters their block -> (_part, _pos) of the starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            nxt, _ = block_next(*_arrays(block), width)
            n, pos = len(nxt), block.column("_pos").to_numpy()
            at, starts = int(block.column("_entry")[0].as_py() - pos[0]), []
            nxt = nxt.tolist()
            while at < n:
                starts.append(at)
                at = nxt[at]
            found = pos[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), block.column("_part")[0].as_py())), pa.array(found)], names=["_part", "_pos"])

    return rows.mapInArrow(run, "_part long, _pos long")


def _later(block: str) -> Window:
    """The blocks of a part after the present one (read from the end, so that a running minimum does)."""
    return Window.partitionBy("_part").orderBy(F.col(block).desc()).rowsBetween(Window.unboundedPreceding, -1)


def _carries(placed: DataFrame) -> DataFrame:
    """(_part, _bkt, _f_next, _h_next, _h_second): the first forced start and the first two hits after each block."""
    hits = F.slice(F.sort_array(F.collect_list(F.when(F.col("_hit") > 0, F.col("_pos")))), 1, 2)
    per = placed.groupBy("_part", "_bkt").agg(F.min(F.when(F.col("_forced"), F.col("_pos"))).alias("_f"), hits.alias("_h"))
    later = _later("_bkt")
    per = per.withColumns({"_f_next": F.min("_f").over(later), "_h_next": F.min(F.get("_h", F.lit(0))).over(later)})
    # the hit after a block's first one: its own second, or the first of a later block
    pair = F.when(F.size("_h") > 0, F.coalesce(F.get("_h", F.lit(1)), "_h_next"))
    return per.withColumn("_s", pair).withColumn("_h_second", F.min("_s").over(later)).select(
        "_part", "_bkt", "_f_next", "_h_next", "_h_second")


def _first_at(placed: DataFrame, tails: DataFrame, splits: list[float]) -> DataFrame:
    """Tails -> (_part, _pos, j, j_ref): the first row whose time is ``x`` or later.

    The rows of a block go to every block of tails that looks into it; such pairs of blocks are about as many as blocks.
    """
    asks = with_bucket(tails, "x", splits).select("_part", F.col("_bkt").alias("_at"), F.col("_src"), "_pos", "x")
    pairs = materialised(asks.select("_part", "_at", "_src").distinct(), "chain-pairs")
    rows = placed.select("_part", F.col("_bkt").alias("_at"), "_t", "_pos", "_ref").join(pairs, ["_part", "_at"])
    none = F.lit(None).cast("long")
    both = asks.select("_part", "_at", "_src", F.col("x").alias("_t"), F.col("_pos").alias("ask"), none.alias("j"), none.alias("j_ref")).union(
        rows.select("_part", "_at", "_src", "_t", none, F.col("_pos"), F.col("_ref")))
    # from the end: the rows of a time are met before the questions about it
    order = [F.col("_t").desc(), F.col("j").desc_nulls_last()]
    w = Window.partitionBy("_part", "_at", "_src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("j").isNotNull(), F.struct("j", "j_ref"))
    found = both.withColumn("_row", F.min(row).over(w)).where("ask IS NOT NULL").select(
        "_part", "_at", F.col("ask").alias("_pos"), "_row")
    # nothing left in that block: the first row of the part's next block
    first = F.min(F.struct(F.col("_pos").alias("j"), F.col("_ref").alias("j_ref")))
    firsts = placed.groupBy("_part", F.col("_bkt").alias("_at")).agg(first.alias("_first"))
    firsts = firsts.join(pairs.select("_part", "_at").distinct(), ["_part", "_at"], "full")
    firsts = firsts.select("_part", "_at", F.min("_first").over(_later("_at")).alias("_first"))
    return found.join(firsts, ["_part", "_at"], "left").withColumn("_row", F.coalesce("_row", "_first")).select(
        "_part", "_pos", F.col("_row.j").alias("j"), F.col("_row.j_ref").alias("j_ref"))


def _reached(pointers: DataFrame, first: DataFrame) -> DataFrame:
    """Entries (_part, _pos) on the chains from ``first``, by doubling the pointers (_part, _pos, to)."""
    seen, jump = materialised(first, "chain-seen"), pointers
    while True:
        new = materialised(seen.join(jump, ["_part", "_pos"]).select("_part", F.col("to").alias("_pos")), "chain-new")
        if new.isEmpty():
            return seen
        seen = materialised(seen.union(new).distinct(), "chain-seen")
        onward = jump.select("_part", F.col("_pos").alias("to"), F.col("to").alias("next"))
        jump = materialised(jump.join(onward, ["_part", "to"]).select("_part", "_pos", F.col("next").alias("to")), "chain-jump")


def mark_starts(rows: DataFrame, part: str, order: list[str], width: int, ref: str | None = None, forced: str | None = None,
                hit: str | None = None, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``is_start``: which rows of a ``part`` (a long) open a span, walking in ``order``.

    The first row is a start. After a start at time ``t`` the next one is the first of: a row with ``forced``; the row
    after the second row with ``hit`` (a 0/1 number) from the start on; the first row whose ``ref`` (a time from that of the
    row before to the row's own, which is the default; null: before all) is ``t + width`` or later. ``order[0]`` is the
    time, a long; ``order`` names every row once.
    """
    spark = rows.sparkSession
    ship_package(spark)
    base = materialised(rows.withColumns({
        "_part": F.col(part).cast("long"), "_t": F.col(order[0]).cast("long"),
        "_ref": F.coalesce(F.col(ref).cast("long"), F.lit(-(1 << 62))) if ref else F.col(order[0]).cast("long"),
        "_forced": F.coalesce(F.col(forced).cast("boolean"), F.lit(False)) if forced else F.lit(False),
        "_hit": F.coalesce(F.col(hit).cast("long"), F.lit(0)) if hit else F.lit(0).cast("long")}), "chain-rows")
    splits = bucket_splits(base, "_t", buckets)
    cut = with_bucket(base, "_t", splits)
    inner = Window.partitionBy("_part", "_bkt").orderBy(*order)
    size = cut.groupBy("_part", "_bkt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_part").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("_part", "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = cut.withColumn("_rn", F.row_number().over(inner)).join(size, ["_part", "_bkt"]).withColumn(
        "_pos", F.col("_off") + F.col("_rn") - 1).drop("_off", "_rn")
    placed = materialised(placed, "chain-placed")
    thin = placed.select(*_COLS)

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("_part", "_bkt").sortWithinPartitions("_part", "_bkt", "_pos")

    led = materialised(_tails(by_block(thin.join(_carries(thin), ["_part", "_bkt"])), width), "chain-tails")
    tails = led.where("x IS NOT NULL").withColumn("_src", F.col("_bkt"))
    due = _first_at(thin, tails, splits)
    total = thin.groupBy("_part").agg(F.max("_pos").alias("_last"))
    nxt = tails.join(due, ["_part", "_pos"], "left").join(total, "_part")
    by_time = F.when(F.col("j_ref") >= F.col("x"), F.col("j")).when(F.col("j") < F.col("_last"), F.col("j") + 1)
    to = F.least(by_time, "cst")
    nxt = materialised(nxt.select("_part", F.col("_pos").alias("tail"), F.when(to <= F.col("_last"), to).alias("to")), "chain-next")
    first = thin.select("_part").distinct().select("_part", F.lit(0).cast("long").alias("_pos"))
    entries = nxt.where("to IS NOT NULL").select("_part", F.col("to").alias("_pos")).union(first).distinct()
    entries = materialised(entries.join(led, ["_part", "_pos"]).select("_part", "_pos", "_bkt", "tail"), "chain-entries")
    pointers = materialised(entries.join(nxt.where("to IS NOT NULL"), ["_part", "tail"]).select("_part", "_pos", "to"), "chain-pointers")
    seen = _reached(pointers, first)
    entered = entries.join(seen, ["_part", "_pos"]).select("_part", "_bkt", F.col("_pos").alias("_entry"))
    starts = _walked(by_block(thin.join(entered, ["_part", "_bkt"])), width).withColumn("_s", F.lit(True))
    out = placed.join(starts, ["_part", "_pos"], "left").withColumn("is_start", F.coalesce("_s", F.lit(False)))
    return out.drop("_s", *_COLS)
