"""Where an event happened: the largest patch of its date, for all events in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import raster as RA


def locate_events(events: DataFrame, field: DataFrame, grid: DataFrame, days: int = 5, threshold: float = -0.1, min_cells: int = 4,
                  codes: Sequence[int] | None = None, id_col="pan_event_id", date="event_date") -> DataFrame:
    """TOP-01 / TOP-07: 4-neighbour patches below the threshold after a 3 x 3 closing, strictly larger than ``min_cells``.

    The work depends on the date only, so it runs once per distinct date and joins back
    to the events; an event without a patch keeps its row with ``found`` false.
    """
    dates = events.select(F.col(date).alias("date")).distinct()
    delta = RA.window_difference(field, days, dates)
    if codes is not None:
        delta = delta.join(grid.filter(F.col("region_code").isin(*codes)).select("y", "x"), ["y", "x"], "left_semi")
    cells = RA.detect_patches(delta, grid, threshold, min_cells, closing=True, connectivity=4, strict_size=True, strict_threshold=True)
    sizes = cells.groupBy("date").agg(F.max_by("component", F.struct("cell_count", -F.col("component"))).alias("component"))
    obj = cells.join(sizes, ["date", "component"])
    stats = RA.component_stats(obj, ["date"]).withColumnRenamed("cell_count", "n_grid_cells")
    reg = RA.region_of_object(obj, ["date"])
    out = events.join(stats.join(reg, "date"), events[date] == F.col("date"), "left")
    return out.withColumn("found", F.col("date").isNotNull()).drop("date")


def strongest(objects: DataFrame, keys=("region", "date", "window_days", "threshold"), loss="cumulative_sic_loss", id_col="object_id") -> DataFrame:
    """TOP-02: strongest object per key; a grouped maximum, combined before the exchange."""
    rest = [c for c in objects.columns if c not in keys]
    best = objects.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(loss), F.col(id_col))).alias("_b"))
    return best.select(*keys, "_b.*")
