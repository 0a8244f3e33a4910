"""Ranks, running totals and exact quantiles without a single-task window.

A plain ``Window.orderBy`` without a selective partition key, or Spark's
``percentile`` on a hot key, gathers the whole group in one task.  Here rows are
range-partitioned on (keys, order); each range bucket computes its local running
total and a small per-bucket table (at most one row per key and bucket) supplies
the offsets.  Values are pre-aggregated to (key, value, count) first, so repeated
values never make a bucket hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import scalar as S
from ..session import durable, shuffle_width


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    amount: Column,
    before: str = "n_before",
    total: str = "n_total",
    buckets: int | None = None,
) -> DataFrame:
    """Add the sum of ``amount`` over strictly earlier rows of the key, and the key total.

    ``order`` must be unique within a key.
    """
    keys = list(keys)
    n = buckets or shuffle_width(df)
    placed = durable(
        df.withColumn("_amount", amount)
        .repartitionByRange(n, *[F.col(k) for k in keys], *order)
        .withColumn("_bucket", F.spark_partition_id())
    )
    per_bucket = placed.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_sum").over(wk.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_sum").over(wk).alias(total),
    )
    wl = W.partitionBy("_bucket", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_amount").over(wl), F.lit(0)))
    cond = F.col("_bucket") == F.col("_o_bucket")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    drop = [f"_o_{k}" for k in keys] + ["_o_bucket", "_off", "_local", "_bucket", "_amount"]
    return local.join(offsets, cond).withColumn(before, F.col("_off") + F.col("_local")).drop(*drop)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Distributed ``row_number()``; also leaves the key size in ``n_total``."""
    out = running_total(df, keys, order, F.lit(1).cast("long"))
    return out.withColumn(name, (F.col("n_before") + 1).cast("long")).drop("n_before")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """One row per (keys, distinct value): n_equal, n_before, n_total. Nulls are left out.

    With ``count`` the rows are distinct values already and bring how often they occur.
    """
    seen = df.filter(F.col(value).isNotNull())
    counts = seen.select(*keys, value, F.col(count).alias("n_equal")) if count else seen.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    return running_total(counts, keys, [F.col(value)], F.col("n_equal"))


def average_rank_pct(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """WIN-05: average rank of ties divided by the group size; null values stay null."""
    keys = list(keys)
    table = value_ranks(df, keys, value).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col(value).alias("_r_value"),
        ((F.col("n_before") + (F.col("n_equal") + 1) / 2) / F.col("n_total")).alias(name),
    )
    cond = F.col(value) == F.col("_r_value")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(table, cond, "left").drop("_r_value", *[f"_r_{k}" for k in keys])


def between(lo: float | None, hi: float | None, frac: float | None) -> float | None:
    """Interpolated value as the SQL has it: ``lo * (1 - frac) + hi * frac`` with one rounding after the first product.

    A position that should be whole may be off by a last bit; then the rounding decides whether the value at it counts as above the quantile.
    """
    if lo is None or hi is None or lo == hi or frac == 0:
        return lo
    if not (math.isfinite(lo) and math.isfinite(hi)):
        return lo + (hi - lo) * frac
    return math.fma(lo, 1.0 - frac, hi * frac)


@F.arrow_udf(T.DoubleType())
def _between(lo: pa.Array, hi: pa.Array, frac: pa.Array) -> pa.Array:
    return pa.array(map(between, lo.to_pylist(), hi.to_pylist(), frac.to_pylist()), pa.float64())


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of ``probs``, plus ``n_values``."""
    keys = list(keys)
    table = value_ranks(df, keys, value, count)
    aggs = [F.max("n_total").alias("n_values")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n_equal"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{tag}"))
    wide = (table.groupBy(*keys) if keys else table).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col("n_values")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_values") - 1)
        frac = pos - F.floor(pos)
        out.append(_between(F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double"), frac).alias(name))
    return wide.select(*out)


def broadcast_quantile(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """WIN-06: attach per-group quantiles to every row (groups are few; Spark picks the join)."""
    keys = list(keys)
    q = quantiles(df, keys, value, probs).drop("n_values")
    if keys:
        return df.join(q, keys, "left")
    one = q.select(F.struct(*probs).alias("q")).scalar()
    return df.withColumn("_q", one).select(df["*"], *[F.col("_q")[name].alias(name) for name in probs])


def suffix_min(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Smallest ``value`` over this and all later rows of the key, from bucket minima and a window inside each bucket."""
    keys = list(keys)
    placed = durable(df.repartitionByRange(buckets or shuffle_width(df), *[F.col(k) for k in keys], *order).withColumn("_bucket", F.spark_partition_id()))
    low = placed.groupBy(*keys, "_bucket").agg(F.min(value).alias("_m"))
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    later = low.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_bucket").alias("_o_bucket"),
        F.min("_m").over(wk.orderBy("_bucket").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    # read backwards: a frame that ends at the last row is computed anew for every row, one that starts at the first row grows
    back = [S.col(o).desc() for o in order]
    local = placed.withColumn("_local", F.min(value).over(W.partitionBy("_bucket", *keys).orderBy(*back).rowsBetween(W.unboundedPreceding, 0)))
    cond = F.col("_bucket") == F.col("_o_bucket")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return local.join(later, cond).withColumn(out, F.least("_local", "_later")).drop("_local", "_later", "_bucket", "_o_bucket", *[f"_o_{k}" for k in keys])
