"""Ordered per-key windows that stay parallel when one key is huge.

A plain ``Window.partitionBy(host)`` sends every row of a host to one task;
a host holding a third of all flows would then be one task. The helpers here
cut a key's rows into buckets first. A bucket is a range of the leading order
column that holds about ``1 / buckets`` of all rows (boundaries from one
approximate-quantile aggregate), so no (key, bucket) holds more than that,
however the rows lie in time; only rows with one and the same value stay
together.

* :func:`running_sum` - per-bucket totals, an exclusive prefix over the small
  (key, bucket) table, then a running sum inside each (key, bucket).
* :func:`global_rank` - the same construction for a 1-based position.
* :func:`sliding_frame` - fixed-size chunks of the global position; the last
  ``width - 1`` rows of each chunk are copied into the next chunk as context,
  so a ``rowsBetween(-(width-1), 0)`` frame is exact inside every chunk.

The rows are joined with their own bucket totals, so each helper first writes
its input once to the shared folder (``session.materialised``): what lies
upstream runs a single time, and lost executors don't bring it back.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

HOUR_US = 3_600_000_000


def _null_safe(left: list[str], right: list[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def _join_buckets(rows: DataFrame, per: DataFrame, part: list[str]) -> DataFrame:
    """Join on key and bucket; a null key is a key like any other, so that its rows are kept."""
    keys = [*part, "_bkt"]
    right = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                       *[c for c in per.columns if c not in keys])
    names = [f"_k{i}" for i in range(len(keys))]
    return rows.join(right, _null_safe(keys, names)).drop(*names)


def size_buckets(table: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bkt``: about equally filled ranges of the number ``col``, never decreasing along it.

    ``buckets`` is four for each shuffle partition unless given. Nulls come
    first and NaN last, as in an ascending sort. The boundaries are the only
    numbers that reach the driver.
    """
    return with_bucket(table, col, bucket_splits(table, col, buckets))


def bucket_splits(table: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """Inner boundaries of about equally filled ranges of ``col``."""
    n = buckets or 4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))
    found = table.agg(F.percentile_approx(F.when(~F.isnan(x), x), [i / n for i in range(1, n)],
                                          max(10_000, 20 * n)).alias("q")).first()["q"] if n > 1 else None
    return sorted({v for v in found or [] if abs(v) != float("inf")})


def with_bucket(table: DataFrame, col: str, inner: list[float]) -> DataFrame:
    """Add ``_bkt``, the range of ``col`` by its inner boundaries (nulls first, NaN last)."""
    if not inner:
        return table.withColumn("_bkt", F.lit(0).cast("long"))
    x = F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_bx", outputCol="_bf",
                     handleInvalid="keep")
    return (cut.transform(table.withColumn("_bx", x)).withColumn("_bkt", F.col("_bf").cast("long"))
            .drop("_bx", "_bf"))


def _bucketed(table: DataFrame, order_col: str | None, bucket_us: int | None, bucket: Column | None,
              buckets: int | None = None) -> DataFrame:
    if bucket is not None:
        return table.withColumn("_bkt", bucket)
    if bucket_us is not None:
        return table.withColumn("_bkt", F.floor(F.col(order_col) / F.lit(bucket_us)).cast("long"))
    return size_buckets(table, order_col, buckets)


def _bucket_offsets(b: DataFrame, part: list[str], total: str | None = None) -> DataFrame:
    """One row per (key, bucket): ``_s`` its sum of ``_v``, ``_off`` the sum of the earlier buckets."""
    per = (b.groupBy(*part, "_bkt").agg(F.sum("_v").alias("_s"))
           .withColumn("_off", F.coalesce(F.sum("_s").over(
               Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return per if total is None else per.withColumn(total, F.sum("_s").over(Window.partitionBy(*part)))


def running_sum(df: DataFrame, part: list[str], order: list[str], value: Column | str, out: str,
                time_col: str | None = None, bucket_us: int | None = None, bucket: Column | None = None,
                total: str | None = None) -> DataFrame:
    """``out`` = running sum of ``value`` per ``part`` in ``order`` (inclusive).

    Rows are cut by ``time_col`` (the leading order column unless given) into
    equally filled buckets, or into ``bucket_us`` wide ones, or by any
    ``bucket`` expression that is non-decreasing along ``order`` (e.g. a
    prefix of the sort key). ``total`` names a column for the sum of the key.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = materialised(df.withColumn("_v", v.cast("long")), "running-sum")
    b = _bucketed(rows, time_col or order[0], bucket_us, bucket)
    w = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (_join_buckets(b, _bucket_offsets(b, part, total).drop("_s"), part)
            .withColumn(out, (F.col("_off") + F.sum("_v").over(w)).cast("long"))
            .drop("_bkt", "_v", "_off"))


def global_rank(df: DataFrame, part: list[str], order: list[str], out: str, time_col: str | None = None,
                bucket_us: int | None = None, bucket: Column | None = None,
                total: str | None = None) -> DataFrame:
    """``out`` = 1-based position of the row in ``order`` within ``part``
    (``part`` may be empty: a global position without a single-task sort);
    ``total`` names a column for the number of rows of the key."""
    return running_sum(df, part, order, F.lit(1), out, time_col, bucket_us, bucket, total)


def sliding_frame(df: DataFrame, part: list[str], order: list[str], width: int, aggs: dict[str, Column],
                  time_col: str, bucket_us: int | None = None, chunk_rows: int = 1 << 16,
                  rank_col: str = "_pos") -> DataFrame:
    """Add ``aggs`` evaluated over the ``width`` rows ending at each row.

    Equivalent to ``agg.over(Window.partitionBy(part).orderBy(order)
    .rowsBetween(-(width - 1), 0))`` and also adds the 1-based position
    ``rank_col``; no task holds more than ``chunk_rows + width`` rows of a key.
    """
    if chunk_rows < width:
        raise ValueError("chunk_rows must be at least the frame width")
    ranked = global_rank(df, part, order, rank_col, time_col, bucket_us)
    chunk = F.floor((F.col(rank_col) - 1) / chunk_rows).cast("long")
    tail = ((F.col(rank_col) - 1) % chunk_rows) >= chunk_rows - (width - 1)
    both = (ranked.withColumn("_own", chunk)
            .withColumn("_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
            .withColumn("_ctx", F.col("_chunk") != F.col("_own")).drop("_own"))
    w = Window.partitionBy(*part, "_chunk").orderBy(rank_col).rowsBetween(-(width - 1), 0)
    out = both.withColumns({k: v.over(w) for k, v in aggs.items()})
    return out.filter(~F.col("_ctx")).drop("_chunk", "_ctx")



def last_before(df: DataFrame, part: list[str], order: list[str], values: dict[str, Column],
                time_col: str, bucket_us: int | None = None) -> DataFrame:
    """For each ``out -> value``: the last non-null ``value`` strictly before
    each row (per ``part``, in ``order``), all in one pass.

    Inside a (key, bucket) a running ``last(ignorenulls)`` frame; the first
    rows of a bucket fall back to the last value of earlier buckets, carried
    by a small table with one row per (key, bucket).
    """
    names = list(values)
    rows = materialised(df.withColumns({f"_val{i}": values[n] for i, n in enumerate(names)}), "last-before")
    b = _bucketed(rows, time_col, bucket_us, None)
    okey = [F.col(c).alias(f"_o{j}") for j, c in enumerate(order)]
    per = b.groupBy(*part, "_bkt").agg(*[
        F.max(F.when(F.col(f"_val{i}").isNotNull(), F.struct(*okey, F.col(f"_val{i}").alias("v"))))
        .alias(f"_m{i}") for i in range(len(names))])
    wb = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*part, "_bkt", *[F.last(F.col(f"_m{i}.v"), ignorenulls=True).over(wb).alias(f"_carry{i}")
                                      for i in range(len(names))])
    w = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({f"_inner{i}": F.last(f"_val{i}", ignorenulls=True).over(w) for i in range(len(names))})
    out = _join_buckets(b, per, part).withColumns(
        {n: F.coalesce(f"_inner{i}", f"_carry{i}") for i, n in enumerate(names)})
    drop = ["_bkt"] + [f"_{p}{i}" for i in range(len(names)) for p in ("val", "inner", "carry")]
    return out.drop(*drop)


def positions(df: DataFrame, part: list[str], order: list[str], prefix: str) -> DataFrame:
    """Add ``<prefix>_no`` (1-based place in ``order``), ``<prefix>_prev`` (``order[0]`` of the row before, or null) and
    ``<prefix>_first`` (``order[0]`` of the first row) per ``part``: one pass over the rows, one table of buckets."""
    rows = size_buckets(materialised(df, "positions"), order[0])
    at = F.col(order[0])
    per = rows.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    w = Window.partitionBy(*part).orderBy("_bkt")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*part, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                     F.lag("_hi").over(w).alias("_carry"), F.min("_lo").over(Window.partitionBy(*part)).alias(f"{prefix}_first"))
    inner = Window.partitionBy(*part, "_bkt").orderBy(*order)
    out = _join_buckets(rows, per, part).withColumns({
        f"{prefix}_no": (F.col("_off") + F.row_number().over(inner)).cast("long"),
        f"{prefix}_prev": F.coalesce(F.lag(at).over(inner), F.col("_carry"))})
    return out.drop("_bkt", "_off", "_carry")


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group_col: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``).

    Rows collapse to (value, count), written once; equally filled buckets of
    values give each wanted position ``(n - 1) * p`` its bucket, and only the
    values of those buckets are ranked. No task holds all values; a frequent
    value is one row. Output: ``[group_col,] p, value``.
    """
    part = [group_col] if group_col else []
    v = df.select(*part, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    counts = size_buckets(materialised(v.groupBy(*part, "_x").agg(F.count(F.lit(1)).alias("_v")), "quantiles"), "_x")
    per = _bucket_offsets(counts, part, "_n")
    # the wanted positions lie in at most two buckets for each probability
    h = (F.col("_n") - 1) * F.col("p")
    want = (per.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("_h", h).withColumn("_i", F.floor("_h").cast("long"))
            .withColumn("_j", F.least(F.col("_i") + 1, F.col("_n") - 1))
            .withColumn("_pos", F.explode(F.array_distinct(F.array("_i", "_j"))))
            .filter((F.col("_off") <= F.col("_pos")) & (F.col("_pos") < F.col("_off") + F.col("_s"))))
    hit = _join_buckets(counts, want.select(*part, "_bkt", "_off").distinct(), part)
    w = Window.partitionBy(*part, "_bkt").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_cum", F.col("_off") + F.sum("_v").over(w)).drop("_off")
    both = (_join_buckets(hit, want.select(*part, "_bkt", "p", "_h", "_i", "_j", "_pos"), part)
            .filter((F.col("_pos") < F.col("_cum")) & (F.col("_pos") >= F.col("_cum") - F.col("_v")))
            .groupBy(*part, "p", "_h", "_i").agg(
                F.max(F.when(F.col("_pos") == F.col("_i"), F.col("_x"))).alias("_a"),
                F.max(F.when(F.col("_pos") == F.col("_j"), F.col("_x"))).alias("_b")))
    value = F.col("_a") + (F.col("_h") - F.col("_i")) * (F.col("_b") - F.col("_a"))
    return both.select(*part, "p", value.alias("value"))
