"""Sequences of flows per host (W2), legacy packet windows (W3), flatten.

Windows are built by assigning each row to the (at most ceil(len/stride))
windows that contain it and grouping by (host, window start): every group
holds exactly ``seq_len`` rows, so no task collects a whole host. Positions
come from the bucketed :func:`global_rank`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, LABEL
from .scoring import EMIT_ORDER
from .windows import global_rank


def sequence_members(df: DataFrame, seq_len: int = 16, stride: int = 4, group_col: str = "src_ip",
                     order_cols: list[str] | None = None, drop_last: bool = False, pad_short: bool = True,
                     time_col: str | None = None, bucket_us: int | None = None) -> DataFrame:
    """Long form: one row per (group, window start, slot) with the row's position.

    ``pos`` is 0-based in group order; window starts are 0, stride, ... up to
    ``n - seq_len`` (``drop_last``: strictly below, the legacy range). Groups
    shorter than ``seq_len`` give one window, left-padded (``slot`` offset by
    the padding) when ``pad_short``.
    """
    order = order_cols or EMIT_ORDER
    tcol = time_col or order[0]
    r = (global_rank(df, [group_col], order, "_pos1", tcol, bucket_us, total="_n")
         .withColumn("pos", F.col("_pos1") - 1))
    last_start = (F.col("_n") - seq_len - (1 if drop_last else 0))
    k = math.ceil(seq_len / stride)
    # candidate starts containing pos: the multiples of stride in [pos - len + 1, pos]
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - seq_len + 1) / stride).cast("long"))
    cands = F.sequence(first, first + (k - 1))
    full = (r.filter(F.col("_n") >= seq_len)
            .withColumn("_w", F.explode(cands))
            .withColumn("start_pos", F.col("_w") * stride)
            .filter((F.col("start_pos") <= F.col("pos")) & (F.col("pos") < F.col("start_pos") + seq_len)
                    & (F.col("start_pos") <= last_start))
            .withColumn("slot", (F.col("pos") - F.col("start_pos")).cast("int")))
    parts = [full]
    if pad_short and not drop_last:
        short = (r.filter(F.col("_n") < seq_len)
                 .withColumn("start_pos", F.lit(0).cast("long"))
                 .withColumn("slot", (F.col("pos") + seq_len - F.col("_n")).cast("int")))
        parts.append(short)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return (out.withColumn("seq_no", (F.col("start_pos") / stride).cast("long"))
            .drop("_w", "_n", "_pos1"))


def build_sequences(df: DataFrame, seq_len: int = 16, stride: int = 4, group_col: str = "src_ip",
                    order_cols: list[str] | None = None, feature_cols: list[str] | None = None,
                    label_col: str = LABEL, drop_last: bool = False, pad_short: bool = True,
                    time_col: str | None = None) -> DataFrame:
    """``host, seq_no, start_pos, window ARRAY<ARRAY<DOUBLE>>, label``.

    ``label`` is 1 if any row in the window is an attack; padding rows are zeros.
    """
    feats = feature_cols or FEATURES
    m = sequence_members(df, seq_len, stride, group_col, order_cols, drop_last, pad_short, time_col)
    m = m.withColumn("_row", F.array(*[F.col(f"`{c}`").cast("double") for c in feats]))
    g = m.groupBy(group_col, "seq_no", "start_pos").agg(
        F.sort_array(F.collect_list(F.struct("slot", "_row"))).alias("_rows"),
        F.max(F.col(label_col).cast("int")).alias("label"))
    # the rows of a window are contiguous and end at its last slot: short groups are padded on the left
    zero = F.array_repeat(F.lit(0.0), len(feats))
    window = F.concat(F.array_repeat(zero, seq_len - F.size("_rows")), F.transform("_rows", lambda x: x["_row"]))
    return g.select(F.col(group_col).alias("host"), "seq_no", "start_pos", window.alias("window"), "label")


def flatten_sequences(seqs: DataFrame, seq_len: int = 16, n_features: int = len(FEATURES)) -> DataFrame:
    """S4 write side: ``window`` -> columns ``0 .. seq_len*n_features-1`` + ``label``."""
    flat = F.flatten("window")
    return seqs.select(*[flat[i].alias(str(i)) for i in range(seq_len * n_features)], "label")


def unflatten_sequences(flat: DataFrame, n_features: int = len(FEATURES), label_col: str = LABEL) -> DataFrame:
    """S4 read side: columns ``0..`` -> ``window`` (length inferred from the width)."""
    cols = [c for c in flat.columns if c != label_col]
    seq_len = len(cols) // n_features
    arr = F.array(*[F.col(f"`{c}`").cast("double") for c in cols[: seq_len * n_features]])
    window = F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)),
                         lambda i: F.slice(arr, i * n_features + 1, n_features))
    return flat.select(window.alias("window"), F.col(label_col).cast("int").alias("label"))


def fit_sequence_standardizer(seqs: DataFrame, mask_padding: bool = False, min_sd: float = 1e-6) -> DataFrame:
    """M15 (sequences): per-feature mean and population std (+``min_sd``) over
    every row of every window. Padding rows count (as in the reference) unless
    ``mask_padding``. One aggregate over the exploded rows; 52 rows out."""
    rows = seqs.select(F.explode("window").alias("r"))
    if mask_padding:
        rows = rows.filter(F.exists("r", lambda x: x != 0))
    n = len(FEATURES)
    aggs = []
    for i in range(n):
        aggs += [F.avg(F.col("r")[i]).alias(f"m{i}"), (F.stddev_pop(F.col("r")[i]) + min_sd).alias(f"s{i}")]
    wide = rows.agg(*aggs)
    body = ", ".join(f"'{f}', m{i}, s{i}" for i, f in enumerate(FEATURES))
    return wide.selectExpr(f"stack({n}, {body}) AS (feature, mean, sd)")


def standardize_sequences(seqs: DataFrame, stats: DataFrame) -> DataFrame:
    """Apply fitted (mean, sd) per feature to every row of ``window``."""
    st = {r["feature"]: (float(r["mean"]), float(r["sd"])) for r in stats.collect()}   # 52 rows
    mu = F.array(*[F.lit(st[f][0]) for f in FEATURES])
    sd = F.array(*[F.lit(st[f][1]) for f in FEATURES])
    return seqs.withColumn("window", F.transform(
        "window", lambda r: F.transform(r, lambda x, i: (x - mu[i]) / sd[i])))
