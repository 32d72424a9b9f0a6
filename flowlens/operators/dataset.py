"""Dataset building: merge, replay selection, split, weights.

A seeded shuffle is an order by ``md5('<seed>:<row id>')``; the same digest
exists in SQL engines, so the order is reproducible. Positions in that order
come from :func:`global_rank` bucketed by the digest's first two hex digits,
so no single task sorts the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES, LABEL
from .windows import global_rank

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def shuffle_key(seed: int, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def fill_missing(df: DataFrame, text_cols: tuple[str, ...] = ("attack_type",)) -> DataFrame:
    """Null -> 0 on numeric columns, null -> '' on the given text columns (Q13)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    out = df.na.fill(0, subset=num) if num else df
    txt = [c for c in text_cols if c in df.columns]
    return out.na.fill("", subset=txt) if txt else out


def merge_flows(dfs: list[DataFrame], seed: int = 42, row_id: Column | None = None,
                required: list[str] | None = None) -> DataFrame:
    """Concatenate by name, check required columns, fill nulls, add
    ``shuffle_key`` (seeded md5 order; sort by it to get the shuffled file)."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    need = required if required is not None else FEATURES + [LABEL]
    missing = [c for c in need if c not in merged.columns]
    if missing:
        raise ValueError(f"merged data missing columns: {missing}")
    rid = row_id if row_id is not None else F.concat_ws("|", *[F.col(c).cast("string") for c in merged.columns])
    return fill_missing(merged).withColumn("shuffle_key", shuffle_key(seed, rid))


def select_profile(df: DataFrame, profile: str = "mixed", limit: int | None = None, seed: int = 42,
                   row_id: Column | None = None, label_col: str = LABEL, digits: int = 4) -> DataFrame:
    """Replay selection. ``attack`` / ``normal`` keep one class, ``mixed``
    keeps both; rows come in seeded shuffled order (``replay_pos`` from 0),
    cut to ``limit``. A missing source host becomes
    ``10.10.{1 if attack else 2}.{pos % 8 + 10}``.
    """
    out = fill_missing(df)
    if profile == "attack":
        out = out.filter(F.col(label_col) == 1)
    elif profile == "normal":
        out = out.filter(F.col(label_col) == 0)
    rid = row_id if row_id is not None else F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    out = out.withColumn("shuffle_key", shuffle_key(seed, rid))
    if limit is not None:
        out = out.orderBy("shuffle_key").limit(limit)
    ranked = global_rank(out, [], ["shuffle_key"], "_pos", bucket=F.substring("shuffle_key", 1, digits))
    pos = F.col("_pos") - 1
    fallback = F.concat(F.lit("10.10."), F.when(F.col(label_col) == 1, F.lit("1")).otherwise(F.lit("2")),
                        F.lit("."), (pos % 8 + 10).cast("string"))
    src = F.col("src_ip") if "src_ip" in out.columns else F.lit(None).cast("string")
    return (ranked.withColumn("src_ip", F.when(src.isNull() | (src == ""), fallback).otherwise(src))
            .withColumn("replay_pos", pos.cast("long")).drop("_pos"))


def stratified_split(df: DataFrame, test_frac: float, seed: int = 42, row_id: Column | None = None,
                     label_col: str = LABEL, digits: int = 4) -> DataFrame:
    """Exact stratified split; adds ``is_test``.

    Per class, the first ``round(frac * n_class)`` rows in seeded md5 order go
    to the test side; rows without a label are a class of their own. Ranks and
    class counts are taken in ranges of the first ``digits`` hex digits of the
    order key, so rows are never dealt by their class alone.
    """
    rid = row_id if row_id is not None else F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    keyed = df.withColumn("_k", shuffle_key(seed, rid))
    out = global_rank(keyed, [label_col], ["_k"], "_r", bucket=F.substring("_k", 1, digits), total="_n")
    cut = F.floor(F.col("_n") * F.lit(float(test_frac)) + F.lit(0.5))
    return out.withColumn("is_test", F.col("_r") <= cut).drop("_k", "_r", "_n")


def class_weights(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Negatives, positives and ``scale_pos_weight`` = neg / max(pos, 1)."""
    return (df.agg(F.count_if(F.col(label_col) == 0).alias("negatives"),
                   F.count_if(F.col(label_col) == 1).alias("positives"))
            .withColumn("scale_pos_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))))
