"""Whole catalogues under a floor on the start value: the scenario is one more key from the cells to the tiers (RAS-18, RAS-20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..session import durable
from ..sources.catalog import with_floors
from . import joins as J, ordered, raster as RA, severity as SV, tracking as T

KEYS = ["scenario", "date", "component"]


def region_name(code) -> Column:
    """Text key of a region code; empty where a patch touches no named region."""
    return F.coalesce(F.lpad(S.col(code).cast("string"), 2, "0"), F.lit(""))


def floor_cells(change: DataFrame, grid: DataFrame, threshold: float, floors: Sequence[float | None], min_cells: int, start: str = "start_value", delta: str = "delta") -> DataFrame:
    """Patch cells (scenario, date, component, y, x, delta, grid attributes) of every floor, labelled in one pass."""
    held = with_floors(change.filter(F.col(delta) <= threshold), start, floors).select("scenario", "date", "y", "x", delta)
    return RA.detect_patches(held, grid, threshold, min_cells, ["scenario", "date"])


def floor_patches(cells: DataFrame, days: int, threshold: float, cell_km2: float = 625.0) -> DataFrame:
    """One row per patch: id numbered in (date, raster) order within the scenario, region of most loss, centroid by longitude class."""
    c = cells.withColumn("w", F.greatest(-F.col("delta"), F.lit(0.0)))
    base = c.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("object_area_cells"), F.avg("delta").alias("mean_sic_change"), F.min("delta").alias("min_sic_change"),
                                F.sum("w").alias("cumulative_sic_loss"), F.sum(F.col("w") * F.col("area_km2")).alias("area_weighted_loss"))
    place = RA.weighted_centroid(c, KEYS, "w").select(*KEYS, "centroid_lon", "centroid_lat", "geometry_class")
    region = RA.region_of_object(c, KEYS).select(*KEYS, region_name("region_code").alias("region"))
    p = ordered.row_numbers(base.join(place, KEYS).join(region, KEYS), ["scenario"], ["date", "component"], "_no").drop("n_total")
    return p.select("*", F.concat(F.lit("ROB_"), "scenario", F.lit("_"), S.numbered_id("", "_no", 8)).alias("object_id"), F.date_sub("date", days).alias("start_date"), F.lit(days).alias("window_days"),
                    F.lit(threshold).alias("threshold"), (F.col("object_area_cells") * cell_km2).alias("object_area_km2"), F.lit(False).alias("overlap_with_series_event"),
                    F.lit(False).alias("overlap_with_regional_event")).drop("_no")


def floor_catalogues(patches: DataFrame, days: int = 2, km: float = 300.0, min_cells: int = 100, min_days: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(linked patches, events with ``is_severe_primary``, major events) of every scenario.

    Patches are linked, rolled up, marked and ranked with the scenario as a key; no scenario sees another's rows.
    """
    linked = durable(T.track_patches(patches, days, km, ["scenario", "region"]))
    events = durable(SV.mark_severe(T.roll_up(linked, ["scenario", "unique_local_event_id"], distributed="flag"), min_cells=min_cells, min_days=min_days, by=["scenario"]))
    major, _ = SV.select_major(events.filter("is_severe_primary"), by=["scenario"])
    return linked, events, major


def tiers(events: DataFrame, major: DataFrame) -> DataFrame:
    """(scenario, event, region, start, level): 1 broad, 2 severe, 3 major."""
    top = major.select("scenario", "unique_local_event_id", "major_definition")
    level = F.when(F.col("major_definition").isNotNull(), 3).when(F.col("is_severe_primary"), 2).otherwise(1)
    return events.join(top, ["scenario", "unique_local_event_id"], "left").withColumn("level", level)


LEVELS = ("broad", "severe", "major_severe")


def catalogue_counts(tiered: DataFrame, scenarios: Sequence[str], regions: Sequence[str], primary: str = "none") -> DataFrame:
    """Events and distinct start dates per scenario, level and region (``all`` too), zeros kept, with the change against ``primary``."""
    nested = tiered.withColumn("_l", F.explode(F.sequence(F.lit(1), F.col("level"))))
    scope = F.explode(F.array(F.lit("all"), F.col("dominant_region"))).alias("region")
    n = nested.select("scenario", "_l", "event_start", scope).groupBy("scenario", "_l", "region").agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("event_start").alias("unique_start_dates"))
    spark = tiered.sparkSession
    want = spark.createDataFrame([(s, i + 1, level, r) for s in scenarios for i, level in enumerate(LEVELS) for r in ("all", *regions)], "scenario string, _l int, severity_level string, region string")
    out = want.join(n, ["scenario", "_l", "region"], "left").fillna(0, ["event_count", "unique_start_dates"])
    base = out.filter((F.col("region") == "all") & (F.col("scenario") == primary)).select("_l", F.col("event_count").alias("_primary"))
    change = F.when(F.col("region") == "all", F.col("event_count") - F.col("_primary"))
    return out.join(base, "_l").select("scenario", "severity_level", "region", "event_count", "unique_start_dates", change.alias("absolute_change_vs_primary"),
                                       S.ratio(change, "_primary").alias("relative_change_vs_primary"))


def nesting_gates(events: DataFrame, major: DataFrame) -> DataFrame:
    """Per scenario: is every severe event a broad one, and every major event a severe one?  Ids are compared, levels are not trusted."""
    key = ["scenario", "unique_local_event_id"]
    severe = events.filter("is_severe_primary").select(*key)
    gate = lambda name, inner, outer: inner.select(*key).withColumn("_in", F.lit(1)).join(outer.select(*key).withColumn("_out", F.lit(1)), key, "full").groupBy("scenario").agg(
        (F.count_if(F.col("_in").isNotNull() & F.col("_out").isNull()) == 0).alias("holds")).select("scenario", F.lit(name).alias("gate"), "holds")
    return gate("severe_subset_broad", severe, events).unionByName(gate("major_subset_severe", major, severe))


def event_footprints(linked: DataFrame, cells: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """(scenario, date, event, y, x): cells of patches that ended in the window before each date; nothing later is looked at."""
    m = linked.select("scenario", "unique_local_event_id", "component", F.col("date").alias("_seen"))
    near = dates.select("date").distinct().withColumn("_seen", F.explode(F.sequence(F.date_sub("date", window), F.col("date"))))
    hit = m.join(near, "_seen")
    c = cells.select("scenario", F.col("date").alias("_seen"), "component", "y", "x")
    return hit.join(c, ["scenario", "_seen", "component"]).select("scenario", "date", "unique_local_event_id", "y", "x").distinct()


def overlap_pairs(prints: DataFrame, components: DataFrame, weighed: DataFrame) -> DataFrame:
    """RAS-20: event footprints against the components of the field under the same floor, per scenario and date.

    ``components`` (scenario, date, component, y, x), ``weighed`` (date, y, x, area_km2, lw).  Both sides meet once on their cells.
    """
    at = ["scenario", "date", "y", "x"]
    comp = components.select(*at, "component").join(weighed, ["date", "y", "x"])
    total = comp.groupBy("scenario", "date", "component").agg(F.sum("area_km2").alias("component_area_km2"), F.sum("lw").alias("component_loss"))
    own = prints.join(weighed, ["date", "y", "x"])
    size = own.groupBy("scenario", "date", "unique_local_event_id").agg(F.sum("area_km2").alias("local_area_km2"))
    met = own.join(comp.select(*at, "component"), at).groupBy("scenario", "date", "unique_local_event_id", "component").agg(
        F.count(F.lit(1)).alias("intersection_cells"), F.sum("area_km2").alias("intersection_area_km2"), F.sum("lw").alias("intersection_loss"))
    r = met.join(size, ["scenario", "date", "unique_local_event_id"]).join(total, ["scenario", "date", "component"])
    i = F.col("intersection_area_km2")
    return r.withColumn("iou", S.ratio(i, F.col("local_area_km2") + F.col("component_area_km2") - i)).withColumn("local_capture", S.ratio(i, "local_area_km2")).withColumn(
        "component_capture", S.ratio(i, "component_area_km2"))


def class_composition(prints: DataFrame, tiered: DataFrame, change: DataFrame, floors: Sequence[float | None]) -> DataFrame:
    """RAS-20: loss of every date and scenario by the highest level that a cell belongs to (0: no event), closed against the total.

    The cells of the field are read once and repeated per floor only as sums over classes.
    """
    level = prints.join(tiered.select("scenario", "unique_local_event_id", "level"), ["scenario", "unique_local_event_id"]).groupBy("scenario", "date", "y", "x").agg(F.max("level").alias("class"))
    field = with_floors(change, "start_value", floors).select("scenario", "date", "y", "x", (F.col("loss") * F.col("area_km2")).alias("lw"))
    k = F.coalesce("class", F.lit(0))
    part = lambda n: F.sum(F.when(k == n, F.col("lw")).otherwise(0.0))
    names = ("residual", "broad_only", "severe_only", "major_severe")
    b = field.join(level, ["scenario", "date", "y", "x"], "left").groupBy("scenario", "date").agg(F.sum("lw").alias("gross_loss"), *[part(n).alias(f"loss_{m}") for n, m in enumerate(names)])
    for m in names:
        b = b.withColumn(f"loss_fraction_{m}", S.ratio(f"loss_{m}", "gross_loss"))
    error = F.col("gross_loss") - sum((F.col(f"loss_{m}") for m in names[1:]), F.col("loss_residual"))
    return b.withColumn("closure_status", F.when(S.is_close(error, F.lit(0.0), 1e-12, 1e-6), "PASS").otherwise("FAIL"))


def paired(table: DataFrame, keys: Sequence[str], columns: Sequence[str], primary: str, other: str) -> DataFrame:
    """One row per key with ``primary_`` and ``floor_`` columns and their difference; a key that one side lacks has nulls there."""
    side = lambda s, p: table.filter(F.col("scenario") == s).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in columns])
    both = side(primary, "primary").join(side(other, "floor"), list(keys), "full")
    return both.select("*", *[(F.col(f"floor_{c}") - F.col(f"primary_{c}")).alias(f"change_{c}") for c in columns])


def event_points(linked: DataFrame, cells: DataFrame) -> DataFrame:
    """(scenario, event, event_date, px_m, py_m): loss-weighted place of all of an event's cells on the projected plane, at its first day."""
    key = ["scenario", "unique_local_event_id"]
    c = cells.select("scenario", "date", "component", "x_m", "y_m", F.greatest(-F.col("delta"), F.lit(0.0)).alias("w"))
    a = linked.select(*key, "date", "component").join(c, ["scenario", "date", "component"]).groupBy(*key).agg(
        F.min("date").alias("event_date"), F.sum("w").alias("_w"), *[F.sum(F.col("w") * F.col(v)).alias(f"_{v}") for v in ("x_m", "y_m")])
    return a.select(*key, "event_date", (F.col("_x_m") / F.col("_w")).alias("px_m"), (F.col("_y_m") / F.col("_w")).alias("py_m"))


def event_samples(points: DataFrame, grid: DataFrame, field: DataFrame, lags: Sequence[int], radii: Sequence[int], change_days: int = 5) -> DataFrame:
    """EVI-10: the field around every event of every scenario, at each lag and radius, with its change.

    A place is paired with the grid once, whatever the lags; scenarios are told apart by the event only.
    """
    p = points.withColumn("point_id", F.struct("scenario", "unique_local_event_id"))
    out = J.lag_buffers(p, J.plane_pairs(p, grid, float(max(radii))), field, lags, radii, change_days)
    return out.select("point_id.scenario", "point_id.unique_local_event_id", "event_date", "lag", "buffer_km", "mean_buffer", "change_buffer")
