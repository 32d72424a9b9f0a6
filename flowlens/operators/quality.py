"""Data-quality profiling (D1-D9). Every check is one or a few aggregates;
results are small long-form tables (one row per column or per pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import round_sql
from .dataset import NUMERIC
from .windows import exact_quantiles

PROBS = (0.25, 0.5, 0.75)


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _stack(names: list[str], exprs: list[str], cols: str) -> str:
    body = ", ".join(f"'{n}', {e}" for n, e in zip(names, exprs))
    return f"stack({len(names)}, {body}) AS ({cols})"


# -- D1 ---------------------------------------------------------------------
def profile_schema(df: DataFrame) -> DataFrame:
    """Column position, name and Spark type, with the row count."""
    rows = df.count()
    spark = df.sparkSession
    data = [(i, f.name, f.dataType.simpleString(), rows) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(data, "position int, column_name string, type string, rows long")


# -- D2 ---------------------------------------------------------------------
def missing(df: DataFrame) -> DataFrame:
    """Nulls per column and their percentage of all rows."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(_q(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = wide.selectExpr("_rows", _stack(cols, [f"_m{i}" for i in range(len(cols))], "column_name, missing"))
    pct = f"CASE WHEN _rows > 0 THEN missing * 100.0e0 / _rows ELSE 0e0 END"
    return long.select("column_name", F.col("missing").cast("long").alias("missing"),
                       F.expr(round_sql(pct, 4)).alias("missing_pct"))


# -- D3 ---------------------------------------------------------------------
def duplicates(df: DataFrame) -> DataFrame:
    """Second and later copies of identical rows (nulls compare equal)."""
    groups = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


# -- D4 ---------------------------------------------------------------------
def describe(df: DataFrame, digits: int = 4) -> DataFrame:
    """count / mean / std (sample) / min / 25% / 50% / 75% / max per numeric
    column (exact linear quartiles), count / unique / top / freq per text column.
    Long form: ``column, stat, value`` (value as text for text stats).
    """
    nums = numeric_cols(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = []
    if nums:
        aggs = []
        for i, c in enumerate(nums):
            x = _q(c).cast("double")
            aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        wide = df.agg(*aggs)
        stats = ["count", "mean", "std", "min", "max"]
        names, exprs = [], []
        for i, c in enumerate(nums):
            for s, col in zip(stats, (f"c{i}", f"m{i}", f"s{i}", f"lo{i}", f"hi{i}")):
                names.append(f"{c}\u0001{s}")
                exprs.append(f"CAST({col} AS DOUBLE)")
        long = wide.selectExpr(_stack(names, exprs, "key, value"))
        parts.append(long.select(F.split("key", "\u0001")[0].alias("column_name"), F.split("key", "\u0001")[1].alias("stat"),
                                 F.expr(round_sql("value", digits)).alias("num")))
        long_vals = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), _q(c).cast("double").alias("v")) for c in nums])).alias("_p")
        ).select("_p.*")
        q = exact_quantiles(long_vals, "v", list(PROBS), group_col="column_name")
        parts.append(q.select("column_name",
                              F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"),
                              F.expr(round_sql("value", digits)).alias("num")))
    out = None
    for p in parts:
        p = p.select("column_name", "stat", F.col("num").cast("string").alias("value"), F.col("num"))
        out = p if out is None else out.unionByName(p)
    for c in texts:
        vc = df.groupBy(_q(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("v").isNotNull())
        top = vc.orderBy(F.col("n").desc(), F.col("v")).limit(1)
        summ = vc.agg(F.sum("n").cast("double").alias("count"), F.count(F.lit(1)).cast("double").alias("unique"))
        t1 = summ.selectExpr(f"'{c}' AS column_name", "stack(2, 'count', count, 'unique', unique) AS (stat, num)")
        t2 = top.select(F.lit(c).alias("column_name"), F.lit("top").alias("stat"), F.col("v").alias("value"),
                        F.lit(None).cast("double").alias("num"))
        t3 = top.select(F.lit(c).alias("column_name"), F.lit("freq").alias("stat"), F.col("n").cast("double").alias("num"))
        for p in (t1, t2, t3):
            if "value" not in p.columns:
                p = p.withColumn("value", F.col("num").cast("string"))
            p = p.select("column_name", "stat", "value", "num")
            out = p if out is None else out.unionByName(p)
    return out.select("column_name", "stat", "num", F.when(F.col("num").isNull(), F.col("value")).alias("text"))


# -- D5 / D7 ----------------------------------------------------------------
def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (exact by default: one unpivot,
    one distinct, one count; ``approx`` uses HyperLogLog per column)."""
    cols = df.columns
    if approx:
        wide = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        long = wide.selectExpr(_stack(cols, [f"d{i}" for i in range(len(cols))], "column_name, distinct_values"))
        return long.withColumn("distinct_values", F.col("distinct_values").cast("long"))
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v"))
                                          for c in cols])).alias("_p")).select("_p.*")
    counted = (pairs.filter(F.col("v").isNotNull()).distinct()
               .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return (names.join(counted, "column_name", "left")
            .select("column_name", F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values")))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value: one aggregate of each column's smallest and largest.

    A column whose type has no order (a map) is compared as text.
    """
    def value(f):
        return _q(f.name) if not isinstance(f.dataType, (T.MapType, T.VariantType)) else _q(f.name).cast("string")

    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string")
    # null where a column holds no value
    wide = df.agg(*[(F.min(value(f)) == F.max(value(f))).alias(f"c{i}") for i, f in enumerate(fields)])
    long = wide.selectExpr(_stack([f.name for f in fields], [f"c{i}" for i in range(len(fields))], "column_name, one"))
    return long.filter("one").select("column_name")


# -- D6 ---------------------------------------------------------------------
def infinities(df: DataFrame) -> DataFrame:
    """+/-inf per numeric column (columns with at least one)."""
    nums = [c for c in numeric_cols(df) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    if not nums:
        return df.sparkSession.createDataFrame([], "column_name string, infinities long")
    wide = df.agg(*[F.count_if(F.abs(_q(c)) == float("inf")).alias(f"i{i}") for i, c in enumerate(nums)])
    long = wide.selectExpr(_stack(nums, [f"i{i}" for i in range(len(nums))], "column_name, infinities"))
    return long.withColumn("infinities", F.col("infinities").cast("long")).filter(F.col("infinities") > 0)


# -- D8 ---------------------------------------------------------------------
def _gram_blocks(names: list[str], means: list[float]):
    """Per partition: masked, centred moment matrices (numpy BLAS); one row out."""
    k = len(names)

    def fn(batches):
        import numpy as np
        import pyarrow as pa

        mu = np.asarray(means, dtype=float)
        acc = np.zeros((4, k, k))
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            m = (~np.isnan(x)).astype(float)
            xf = np.where(m > 0, x - mu, 0.0)
            acc[0] += m.T @ m            # n_ab
            acc[1] += xf.T @ m           # sum of a where b present
            acc[2] += (xf * xf).T @ m    # sum of a^2 where b present
            acc[3] += xf.T @ xf          # sum of a*b
        yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()], type=pa.list_(pa.float64()))],
                                         names=["s"])
    return fn


def correlated_pairs(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs (i < j, in column order) of numeric columns with |Pearson r| >
    ``threshold`` over pairwise-complete rows; NaN (constant / infinite) pairs
    are skipped.

    Two distributed passes: column means, then per-partition masked moment
    matrices (numpy BLAS inside each task) summed by ``Summarizer``. Only the
    4 x k x k sums reach the driver, where r is computed per pair.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    spark = df.sparkSession
    nums = numeric_cols(df)
    k = len(nums)
    # NaN marks "missing" inside the tasks; infinities stay and poison their pairs
    x = df.select(*[F.coalesce(_q(c).cast("double"), F.lit(float("nan"))).alias(c) for c in nums])
    means = x.agg(*[F.avg(F.when(~F.isnan(_q(c)) & (F.abs(_q(c)) != float("inf")), _q(c))).alias(c)
                    for c in nums]).first()
    mu = [means[c] if means[c] is not None else 0.0 for c in nums]
    parts = x.mapInArrow(_gram_blocks(nums, mu), "s array<double>")
    total = (parts.select(Summarizer.sum(array_to_vector("s")).alias("t")).first()["t"]
             .toArray().reshape(4, k, k))
    n, sa, saa, sab = total
    rows = []
    with np.errstate(all="ignore"):
        for i in range(k):
            for j in range(i + 1, k):
                nn = n[i, j]
                cov = nn * sab[i, j] - sa[i, j] * sa[j, i]
                den = np.sqrt((nn * saa[i, j] - sa[i, j] ** 2) * (nn * saa[j, i] - sa[j, i] ** 2))
                r = cov / den if den > 0 else float("nan")
                if np.isfinite(r) and abs(r) > threshold:
                    rows.append((nums[i], nums[j], float(np.floor(r * 1e3 + 0.5) / 1e3)))
    return spark.createDataFrame(rows, "column_a string, column_b string, corr double")


# -- D9 ---------------------------------------------------------------------
def dataset_gate(flows: DataFrame, label_col: str = "label", normal_share: tuple[float, float] = (0.6, 0.8),
                 min_per_class: int = 2000, min_distinct: int = 10) -> DataFrame:
    """Checklist: normal share in range, flows per class, diversity of normal
    (distinct destination ports and packet sizes). ``check, value, passed``."""
    normal = F.col(label_col) == 0
    agg = flows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(normal).alias("normal"),
        F.count_if(~normal).alias("attack"),
        F.count_distinct(F.when(normal, F.col("dst_port"))).alias("ports"),
        F.count_distinct(F.when(normal, F.round("avg_pkt_size", 0))).alias("sizes"))
    lo, hi = normal_share
    share = f"normal / greatest(rows, 1)"
    return agg.selectExpr(
        "stack(5, "
        f"'normal_share', {round_sql(share, 4)}, {share} >= {lo} AND {share} <= {hi}, "
        f"'normal_flows', CAST(normal AS DOUBLE), normal >= {min_per_class}, "
        f"'attack_flows', CAST(attack AS DOUBLE), attack >= {min_per_class}, "
        f"'normal_distinct_ports', CAST(ports AS DOUBLE), ports >= {min_distinct}, "
        f"'normal_distinct_sizes', CAST(sizes AS DOUBLE), sizes >= {min_distinct}"
        ") AS (check, value, passed)")
