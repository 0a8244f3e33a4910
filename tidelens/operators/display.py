"""Display tables (EVI-09): ranked points, reference deltas, long matrices.  Output is data only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from . import ordered


def effect_points(df: DataFrame, keys: Sequence[str], value: str, unit: str, lanes: int = 9) -> DataFrame:
    """Ranked effects with a lane offset, the mean and median lines and the side of zero."""
    keys = list(keys)
    n = ordered.row_numbers(df.select(*keys, unit, value), keys, [value, unit])
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean_line"))
    med = ordered.quantiles(df, keys, value, {"median_line": 0.5}).drop("n_values")
    lane = (F.col("rn") % lanes - lanes // 2) / 10.0
    side = S.ladder([(F.col(value) > 0, "above"), (F.col(value) < 0, "below")], "at")
    return n.join(mean, keys).join(med, keys).withColumn("offset_y", lane).withColumn("side", side)


def delta_to_reference(df: DataFrame, keys: Sequence[str], is_reference: Column, value: str, out: str = "delta_to_reference") -> DataFrame:
    """Each row minus the reference row that shares its keys."""
    ref = df.filter(is_reference).select(*keys, F.col(value).alias("_ref"))
    return df.join(ref, list(keys)).withColumn(out, F.col(value) - F.col("_ref")).drop("_ref")


def long_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide status or value matrix to rows (keys, column, value)."""
    return df.unpivot(list(keys), list(columns), "column", "value")
