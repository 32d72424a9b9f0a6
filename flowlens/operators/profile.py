"""Normal-traffic profile (mean and population std per feature).

``fit_profile`` is an estimator: one aggregate over the normal flows
(partial aggregation on every executor, 105 numbers reach the driver).
``profile_table`` is the same statistic as a 52-row DataFrame, never leaving
Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES

MIN_SD = 1e-6


@dataclass(frozen=True)
class Profile:
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    rows: int

    def as_dict(self) -> dict[str, tuple[float, float]]:
        return {f: (m, s) for f, m, s in zip(FEATURES, self.mean, self.sd)}


def normal_rows(flows: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows whose label is null, empty or 0 (the normal class)."""
    lab = F.col(label_col).cast("string")
    return flows.filter(lab.isNull() | (F.trim(lab) == "") | (lab.try_cast("double") == 0))


def _profile_aggs(min_sd: float) -> list:
    out = [F.count(F.lit(1)).alias("_rows")]
    for f in FEATURES:
        out.append(F.avg(F.col(f)).alias(f"m__{f}"))
        out.append((F.stddev_pop(F.col(f)) + F.lit(min_sd)).alias(f"s__{f}"))
    return out


def fit_profile(flows: DataFrame, label_col: str = "label", min_rows: int = 50,
                max_rows: int | None = None, min_sd: float = MIN_SD,
                order_cols: list[str] | None = None) -> Profile:
    """Fit the profile on normal rows; ``max_rows`` keeps the earliest rows."""
    normal = normal_rows(flows, label_col) if label_col in flows.columns else flows
    normal = normal.select(*FEATURES, *(order_cols or []))
    if max_rows is not None:
        normal = normal.orderBy(*(order_cols or FEATURES)).limit(max_rows)
    row = normal.agg(*_profile_aggs(min_sd)).first()
    n = int(row["_rows"])
    if n < min_rows:
        raise ValueError(f"normal profile needs at least {min_rows} rows, got {n}")
    return Profile(tuple(float(row[f"m__{f}"]) for f in FEATURES),
                   tuple(float(row[f"s__{f}"]) for f in FEATURES), n)


def profile_table(flows: DataFrame, label_col: str = "label", min_sd: float = MIN_SD) -> DataFrame:
    """52 rows ``feature, mean, sd`` computed in Spark (sd = std_pop + min_sd)."""
    normal = normal_rows(flows, label_col) if label_col in flows.columns else flows
    wide = normal.agg(*_profile_aggs(min_sd)[1:])
    stack = ", ".join(f"'{f}', `m__{f}`, `s__{f}`" for f in FEATURES)
    return wide.selectExpr(f"stack({len(FEATURES)}, {stack}) AS (feature, mean, sd)")


def profile_from_table(table: DataFrame) -> Profile:
    """Collect a 52-row profile table (bounded: one row per feature)."""
    rows = {r["feature"]: (float(r["mean"]), float(r["sd"])) for r in table.collect()}
    return Profile(tuple(rows[f][0] for f in FEATURES), tuple(rows[f][1] for f in FEATURES), -1)
