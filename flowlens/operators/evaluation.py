"""Thresholds, scaling and evaluation.

All statistics are aggregates (partial/final); exact percentiles and AUC
ranks use the bucketed running counts of :mod:`windows`, never a sort in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_sql
from ..schema import LABEL
from .windows import exact_quantiles, running_sum


# -- M11 / M12 --------------------------------------------------------------
def fit_threshold(df: DataFrame, score_col: str, label_col: str = LABEL,
                  probs: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Percentiles (linear interpolation) of the score over normal rows."""
    normal = df.filter(F.col(label_col) == 0) if label_col in df.columns else df
    return exact_quantiles(normal, score_col, list(probs))


def detection_rate(df: DataFrame, score_col: str, threshold, label_col: str = LABEL) -> DataFrame:
    """Share of attack rows with score >= threshold, and their mean score."""
    thr = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    att = df.filter(F.col(label_col) == 1)
    return att.agg(F.count(F.lit(1)).alias("attacks"),
                   F.avg((F.col(score_col) >= thr).cast("double")).alias("detected_share"),
                   F.avg(F.col(score_col)).alias("mean_attack_score"))


# -- M15 --------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """Fit (shift, scale) per column: standard = (mean, population std, 1 if 0);
    minmax = (min, max - min, 1 if 0). One aggregate; 2 numbers per column."""
    if kind == "standard":
        aggs = [e for c in cols for e in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"b_{c}"))]
    elif kind == "minmax":
        aggs = [e for c in cols for e in (F.min(c).alias(f"a_{c}"), (F.max(c) - F.min(c)).alias(f"b_{c}"))]
    else:
        raise ValueError(kind)
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        a, b = float(row[f"a_{c}"] or 0.0), float(row[f"b_{c}"] or 0.0)
        out[c] = (a, b if b != 0 else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in params.items()})


def scale(df: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """Standard or min-max scaling with statistics fitted on ``df``."""
    return apply_scaler(df, fit_scaler(df, cols, kind))


# -- M16 --------------------------------------------------------------------
def roc_auc(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """ROC AUC by the rank-sum statistic with average ranks for ties.

    Rows collapse to (score, positives, negatives); a bucketed running count
    of negatives below each score gives the pairs won (ties count half).
    """
    per = (df.groupBy(F.col(score_col).cast("double").alias("_s"))
           .agg(F.count_if(F.col(label_col) == 1).alias("_p"), F.count_if(F.col(label_col) != 1).alias("_n")))
    cum = running_sum(per, [], ["_s"], "_n", "_cn")
    won = F.col("_p") * (F.col("_cn") - F.col("_n") + F.col("_n") * 0.5)
    return cum.agg(F.try_divide(F.sum(won), F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def evaluate(df: DataFrame, label_col: str = LABEL, pred_col: str = "pred", score_col: str | None = None,
             digits: int = 4) -> DataFrame:
    """Confusion counts, per-class precision / recall / F1 / support, accuracy,
    macro and weighted averages and (with scores) ROC AUC, in long form
    ``metric, value``."""
    y, p = F.col(label_col).cast("int"), F.col(pred_col).cast("int")
    c = df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    e = {
        "p1": "try_divide(tp, tp + fp)", "r1": "try_divide(tp, tp + fn)",
        "p0": "try_divide(tn, tn + fn)", "r0": "try_divide(tn, tn + fp)",
        "s1": "tp + fn", "s0": "tn + fp", "acc": "try_divide(tp + tn, tp + tn + fp + fn)",
    }
    m = c.selectExpr("*", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in e.items()])
    f1 = "try_divide(2 * {p} * {r}, {p} + {r})"
    m = m.selectExpr("*", f"COALESCE({f1.format(p='p1', r='r1')}, 0e0) AS f1_1",
                     f"COALESCE({f1.format(p='p0', r='r0')}, 0e0) AS f1_0")
    rows = {
        "tn": "tn", "fp": "fp", "fn": "fn", "tp": "tp",
        "precision_0": "COALESCE(p0, 0e0)", "recall_0": "COALESCE(r0, 0e0)", "f1_0": "f1_0", "support_0": "s0",
        "precision_1": "COALESCE(p1, 0e0)", "recall_1": "COALESCE(r1, 0e0)", "f1_1": "f1_1", "support_1": "s1",
        "accuracy": "COALESCE(acc, 0e0)",
        "macro_precision": "(COALESCE(p0, 0e0) + COALESCE(p1, 0e0)) / 2",
        "macro_recall": "(COALESCE(r0, 0e0) + COALESCE(r1, 0e0)) / 2",
        "macro_f1": "(f1_0 + f1_1) / 2",
        "weighted_precision": "try_divide(COALESCE(p0, 0e0) * s0 + COALESCE(p1, 0e0) * s1, s0 + s1)",
        "weighted_recall": "try_divide(COALESCE(r0, 0e0) * s0 + COALESCE(r1, 0e0) * s1, s0 + s1)",
        "weighted_f1": "try_divide(f1_0 * s0 + f1_1 * s1, s0 + s1)",
    }
    stack = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in rows.items())
    out = m.selectExpr(f"stack({len(rows)}, {stack}) AS (metric, value)")
    if score_col:
        auc = roc_auc(df, label_col, score_col).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
        out = out.unionByName(auc)
    return out.select("metric", F.expr(round_sql("value", digits)).alias("value"))
