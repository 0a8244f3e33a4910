"""Daily series: gap filling, k-day deltas, climatology, thresholds, block de-duplication, detection.

Every window here is partitioned by series.  A series holds one row per day by
contract, so a partition is bounded by the length of the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S


def fill_days(df: DataFrame, key: str = "series_id", date: str = "date", value: str = "value") -> DataFrame:
    """WIN-02: one row per calendar day, linear in time between known days, flat at both ends."""
    w = W.partitionBy(key)
    ends = df.select(key, date, value, F.min(date).over(w).alias("_lo"), F.max(date).over(w).alias("_hi")).filter(F.col(value).isNotNull())
    o = w.orderBy(date)
    seg = ends.select(
        key, F.col(date).alias("_d0"), F.col(value).alias("_v0"),
        F.lead(date).over(o).alias("_d1"), F.lead(value).over(o).alias("_v1"),
        F.when(F.lag(date).over(o).isNull(), F.col("_lo")).otherwise(F.col(date)).alias("_from"),
        F.coalesce(F.date_sub(F.lead(date).over(o), 1), F.col("_hi")).alias("_to"),
    )
    step = F.datediff(F.col(date), F.col("_d0"))
    slope = (F.col("_v1") - F.col("_v0")) / F.datediff("_d1", "_d0")
    return seg.withColumn(date, F.explode(F.sequence("_from", "_to"))).select(
        key, date, F.when(step <= 0, F.col("_v0")).otherwise(F.coalesce(slope * step + F.col("_v0"), F.col("_v0"))).alias(value)
    )


def fill_positions(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """WIN-03: replace null values linearly by row position; flat at both ends."""
    o = W.partitionBy(key).orderBy(date)
    back = o.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = o.rowsBetween(W.currentRow, W.unboundedFollowing)
    at = df.withColumn("_p", F.row_number().over(o))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    both = at.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    a, b = F.col("_a"), F.col("_b")
    inner = (b["v"] - a["v"]) / (b["p"] - a["p"]) * (F.col("_p") - a["p"]) + a["v"]
    filled = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.coalesce(inner, a["v"], b["v"]))
    return both.withColumn(value, filled).drop("_p", "_a", "_b")


def k_day_delta(df: DataFrame, k: int = 3, key: str = "series_id", date: str = "date", value: str = "value", out: str = "delta") -> DataFrame:
    """WIN-01: change over k days by position; the edges repeat the nearest computed change."""
    if k not in (1, 2, 3):
        raise ValueError("k must be 1, 2 or 3")
    o = W.partitionBy(key).orderBy(date)
    raw = F.lead(value, 1).over(o) - (F.lag(value, k - 1).over(o) if k > 1 else F.col(value))
    step = df.withColumn("_raw", raw)
    near = F.coalesce(
        F.col("_raw"),
        F.last("_raw", True).over(o.rowsBetween(W.unboundedPreceding, -1)),
        F.first("_raw", True).over(o.rowsBetween(1, W.unboundedFollowing)),
    )
    return step.withColumn(out, near).drop("_raw")


def day_climatology(df: DataFrame, key="series_id", date="date", value="value", delta="delta") -> DataFrame:
    """AGG-01: means, 5th and 95th percentiles and count per calendar day (a group holds one row per year)."""
    return df.groupBy(key, F.month(date).alias("month"), F.dayofmonth(date).alias("day")).agg(
        F.avg(value).alias("value_climo"), F.avg(delta).alias("delta_climo"),
        F.percentile(delta, 0.05).alias("delta_p05"), F.percentile(delta, 0.95).alias("delta_p95"),
        F.count(delta).alias("n"),
    )


def month_percentiles(df: DataFrame, percentile: float = 5.0, key="series_id", date="date", delta="delta") -> DataFrame:
    """AGG-02: monthly percentiles (a group holds at most 31 rows per year)."""
    q = F.percentile(delta, F.array(*[F.lit(v) for v in (0.05, 0.10, 0.95, percentile / 100)]))
    return df.groupBy(key, F.month(date).alias("month")).agg(q.alias("q"), F.count(delta).alias("n")).select(
        key, "month", F.col("q")[0].alias("delta_month_p05"), F.col("q")[1].alias("delta_month_p10"),
        F.col("q")[2].alias("delta_month_p95"), F.col("q")[3].alias("delta_month_custom"), "n",
    )


def series_threshold(df: DataFrame, value: str, percentile: float, mask: Column | None = None, key="series_id", out="threshold") -> DataFrame:
    """AGG-03: percentile per series over all rows, or over the masked rows only."""
    v = F.col(value) if mask is None else F.when(mask, F.col(value))
    return df.groupBy(key).agg(F.percentile(v, percentile / 100).alias(out))


def mean_removed_delta(df: DataFrame, climatology: DataFrame, k: int = 3, key="series_id", date="date", value="value") -> DataFrame:
    """WIN-04: delta of the value minus its calendar-day mean; missing means are filled by position first."""
    clim = climatology.select(key, "month", "day", "value_climo")
    anomaly = (
        df.withColumn("month", F.month(date)).withColumn("day", F.dayofmonth(date))
        .join(clim, [key, "month", "day"], "left")
        .withColumn("anomaly", F.col(value) - F.col("value_climo")).drop("value_climo")
    )
    return k_day_delta(fill_positions(anomaly, key, date, "anomaly"), k, key, date, "anomaly", "delta_mean_removed")


def keep_last_of_block(df: DataFrame, gap_days: int, key: Sequence[str] = ("series_id",), date: str = "date", order: Sequence[str] = ("method",)) -> DataFrame:
    """WIN-09: rows whose steps stay within ``gap_days`` form a block; the last row of each block is kept."""
    if gap_days <= 0:
        return df
    o = W.partitionBy(*key).orderBy(date, *order)
    return (
        df.withColumn("_next", F.lead(date).over(o))
        .filter(F.col("_next").isNull() | (F.datediff("_next", F.col(date)) > gap_days))
        .drop("_next")
    )


# ---- zero-phase high-pass ------------------------------------------------

def highpass_coefficients(cutoff_days: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth high-pass as numerator and denominator polynomials (daily sampling)."""
    warped = 4.0 * np.tan(np.pi / cutoff_days)
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    analog = warped / prototype
    poles = (4.0 + analog) / (4.0 - analog)
    a = np.poly(poles).real
    b = np.poly(np.ones(order))
    gain = np.polyval(a, -1.0) / np.polyval(b, -1.0)
    return b * gain, a


def _recursion(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    z, out = state.copy(), np.empty_like(x)
    for i, value in enumerate(x):
        y = b[0] * value + z[0]
        z[:-1] = z[1:] + b[1:-1] * value - a[1:-1] * y
        z[-1] = b[-1] * value - a[-1] * y
        out[i] = y
    return out


def zero_phase(values: np.ndarray, cutoff_days: float, order: int) -> np.ndarray:
    """Forward and backward pass with odd end padding of three filter lengths."""
    x = np.asarray(values, dtype=float)
    bad = ~np.isfinite(x)
    if bad.any():
        if (~bad).sum() < 3 * order:
            raise ValueError("too few finite values for the filter")
        pos = np.arange(x.size)
        x = np.interp(pos, pos[~bad], x[~bad])
    pad = 3 * (order + 1)
    if x.size <= pad:
        raise ValueError(f"series of {x.size} days is too short, more than {pad} are needed")
    b, a = highpass_coefficients(cutoff_days, order)
    companion = np.eye(order, k=1)
    companion[:, 0] = -a[1:]
    rest = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    ahead = _recursion(b, a, wide, rest * wide[0])
    back = _recursion(b, a, ahead[::-1], rest * ahead[-1])[::-1]
    return back[pad:-pad]


def highpass(df: DataFrame, cutoff_days: float = 18.0, order: int = 12, key="series_id", date="date", value="delta", out="delta_highpass") -> DataFrame:
    """SEQ-04: one task per series (a series is bounded by its calendar); series run side by side."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        return pd.DataFrame({key: pdf[key], date: pdf[date], out: zero_phase(pdf[value].to_numpy(float), cutoff_days, order)})

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{key} {types[key]}, {date} {types[date]}, {out} double"
    return df.join(df.select(key, date, value).groupBy(key).applyInPandas(run, schema), [key, date], "left")


# ---- detection -----------------------------------------------------------

@dataclass(frozen=True)
class DetectionSettings:
    first_year: int = 1989
    last_year: int = 2023
    climatology_first: int = 1990
    climatology_last: int = 2018
    k: int = 3
    percentile: float = 5.0
    cutoff_days: float = 18.0
    order: int = 12
    gap_days: int = 1
    months: object = "annual"
    drop_month_edges: bool = True


def prepared(df: DataFrame, st: DetectionSettings) -> DataFrame:
    """Fill, delta on every day, then drop 29 February and years outside the range; ``candidate`` marks usable days."""
    base = k_day_delta(fill_days(df), st.k)
    base = base.filter(S.keep_year_range_without_leap_day("date", st.first_year, st.last_year))
    usable = S.in_months("date", st.months)
    if st.drop_month_edges:
        usable = usable & ~S.month_edge("date")
    return base.withColumn("candidate", usable)


def climatology_rows(base: DataFrame, st: DetectionSettings) -> DataFrame:
    rows = base.filter(F.year("date").between(st.climatology_first, st.climatology_last))
    return rows.filter(~S.month_edge("date")) if st.drop_month_edges else rows


def detect(df: DataFrame, st: DetectionSettings = DetectionSettings(), method: str = "both") -> DataFrame:
    """SEQ-05: events of the high-pass branch, the mean-removed branch, or both, de-duplicated."""
    base = prepared(df, st)
    branches = []
    if method in ("butterworth", "both"):
        hp = highpass(base, st.cutoff_days, st.order)
        branches.append((hp, "delta_highpass", None, "butterworth"))
    if method in ("mean_removed", "both"):
        mr = mean_removed_delta(base, day_climatology(climatology_rows(base, st)), st.k)
        branches.append((mr, "delta_mean_removed", F.col("candidate"), "mean_removed"))
    found = None
    for rows, value, mask, label in branches:
        # a percentile over the series window: no second pass, one row per day by contract
        pick = F.col(value) if mask is None else F.when(mask, F.col(value))
        cut = F.percentile(pick, F.lit(st.percentile / 100)).over(W.partitionBy("series_id"))
        hit = rows.withColumn("threshold", cut).filter(F.col("candidate") & (F.col(value) <= F.col("threshold"))).select(
            "series_id", "date", "value", "delta", F.year("date").alias("year"), F.month("date").alias("month"),
            F.dayofmonth("date").alias("day"), F.lit(label).alias("method"), F.col(value).alias("event_value"), "threshold",
        )
        found = hit if found is None else found.unionByName(hit)
    return keep_last_of_block(found, st.gap_days)
