"""Front extraction: the edge between high and low values near a point, its oriented normals, and quality grades.

Edge cells, slopes and coast belong to a date, not to an event, so they are computed
once per distinct date; an event only selects the cells around its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, geometry as G, scalar as S
from ..session import shuffled
from . import joins as J, raster as RA


@dataclass(frozen=True)
class FrontSettings:
    threshold: float = 0.15
    search_km: float = 750.0
    coastal_cells: int = 2
    min_cells: int = 8
    component_fraction: float = 0.45
    sample_m: float = 50_000.0
    min_difference: float = 0.05
    ok_fraction: float = 0.80
    degraded_fraction: float = 0.50
    step_m: float = 25_000.0
    tile: int = RA.TILE


def dense_field(field: DataFrame, grid: DataFrame) -> DataFrame:
    """Every grid cell of every date; a cell without a value is null, so it can block a slope."""
    days = field.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("d")).scalar()
    cells = grid.withColumn("date", F.explode(days))
    return cells.join(shuffled(field.select("date", "y", "x", "value")), ["date", "y", "x"], "left")


def edge_cells(field: DataFrame, grid: DataFrame, st: FrontSettings, ny: int, nx: int) -> DataFrame:
    """Cells at or above the threshold on the ocean, next to an ocean cell below it, away from the coast, with their slope."""
    g = grid.withColumn("ocean", F.col("region_code").isin(*fixed.OCEAN_CODES))
    coast = RA.expand_mask(g.filter(~F.col("ocean")), [], st.coastal_cells, ny, nx)
    d = dense_field(field, g)
    low = d.filter(F.col("ocean") & (F.col("value") < st.threshold))
    near = RA.neighbour_count(low, ["date"], ny, nx).filter("n_near > 0").select("date", "y", "x")
    high = d.filter(F.col("ocean") & (F.col("value") >= st.threshold)).select("date", "y", "x")
    edge = high.join(shuffled(near), ["date", "y", "x"], "left_semi").join(shuffled(coast), ["y", "x"], "left_anti")
    slope = RA.gradient(d.select("date", "y", "x", "value", "x_m", "y_m", "lon", "lat"), ["date"], "value")
    return slope.join(shuffled(edge), ["date", "y", "x"], "left_semi")


def extract(asks: DataFrame, field: DataFrame, grid: DataFrame, st: FrontSettings, ny: int, nx: int, x0: float, y0: float, step_x: float, step_y: float) -> tuple[DataFrame, DataFrame]:
    """RAS-10 / TOP-04: (edge rows, quality rows) per (point_id, date).

    asks holds (point_id, px_m, py_m, date).  Only the dominant component is kept; normals
    point from the high to the low side, flipped where two samples say so.
    """
    keys = ["point_id", "date"]
    edges = edge_cells(field.join(asks.select("date").distinct(), "date", "left_semi"), grid, st, ny, nx)
    pairs = J.plane_pairs(asks.select("point_id", "px_m", "py_m").distinct(), grid, st.search_km)
    mine = asks.select(*keys).distinct().join(shuffled(pairs.select("point_id", "y", "x")), "point_id").join(shuffled(edges), ["date", "y", "x"])
    lab = RA.label(mine, keys, 8, tile=st.tile)
    sizes = lab.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    dom = sizes.groupBy(*keys).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"), F.max("n").alias("dominant_cells"), F.sum("n").alias("total_edge_cells"))
    main = lab.join(shuffled(dom.select(*keys, "component")), [*keys, "component"], "left_semi").select(*keys, "y", "x").join(shuffled(mine), [*keys, "y", "x"])
    norm = F.hypot("grad_x", "grad_y")
    main = main.withColumn("_n", norm).filter(F.col("_n") > 0).withColumn("nx", -F.col("grad_x") / F.col("_n")).withColumn("ny", -F.col("grad_y") / F.col("_n"))

    values = field.join(shuffled(grid.select("y", "x", "region_code")), ["y", "x"]).filter(F.col("region_code").isin(*fixed.OCEAN_CODES) & F.col("value").isNotNull()).select("date", "y", "x", "value")
    out = main
    for side, sign in (("plus", 1), ("minus", -1)):
        yy, xx = J.nearest_projected_cell(F.col("x_m") + sign * st.sample_m * F.col("nx"), F.col("y_m") + sign * st.sample_m * F.col("ny"), x0, y0, step_x, step_y)
        v = values.select(F.col("date").alias("_d"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("value").alias(f"v_{side}"))
        out = out.withColumn("_yy", yy).withColumn("_xx", xx).join(shuffled(v), (F.col("date") == F.col("_d")) & (F.col("_yy") == F.col("_y")) & (F.col("_xx") == F.col("_x")), "left").drop("_d", "_y", "_x", "_yy", "_xx")
    diff = F.col("v_minus") - F.col("v_plus")
    out = out.withColumn("orientation_diff", diff).withColumn("oriented", diff.isNotNull())
    flip = F.coalesce(F.col("orientation_diff") < 0, F.lit(False))
    out = out.withColumn("flip", flip)
    for c in ("nx", "ny"):
        out = out.withColumn(c, F.when(F.col("flip"), -F.col(c)).otherwise(F.col(c)))
    contrast = F.abs("orientation_diff")
    lon2, lat2 = G.stereographic_inverse(F.col("x_m") + F.col("nx") * st.step_m, F.col("y_m") + F.col("ny") * st.step_m)
    out = out.withColumn("_lon2", lon2).withColumn("_lat2", lat2)
    out = out.withColumn("_e", F.radians(F.col("_lon2") - F.col("lon")) * F.cos(F.radians("lat"))).withColumn("_o", F.radians(F.col("_lat2") - F.col("lat"))).withColumn("_l", F.hypot("_e", "_o"))
    good = F.col("oriented") & (F.col("_l") > 0)

    high_side, low_side = F.greatest("v_plus", "v_minus"), F.least("v_plus", "v_minus")
    per = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("orientation_total_cells"), F.count_if("oriented").alias("orientation_valid_cells"), F.count_if(F.coalesce(contrast >= st.min_difference, F.lit(False))).alias("orientation_strong_cells"),
                                 F.count_if("flip").alias("orientation_flip_cells"), F.count_if(F.coalesce(good, F.lit(False))).alias("edge_cells"),
                                 F.avg(F.when(F.col("oriented"), high_side)).alias("mean_high_side"), F.avg(F.when(F.col("oriented"), low_side)).alias("mean_low_side"), F.avg(contrast).alias("mean_contrast"))
    qa = asks.select(*keys).distinct().join(shuffled(dom.drop("component")), keys, "left").join(shuffled(per), keys, "left")
    qa = qa.withColumn("component_fraction", S.ratio("dominant_cells", "total_edge_cells")).withColumn("valid_orientation_fraction", S.ratio("orientation_valid_cells", "orientation_total_cells"))
    qa = qa.withColumn("strong_orientation_fraction", S.ratio("orientation_strong_cells", "orientation_valid_cells")).withColumn("flip_fraction", S.ratio("orientation_flip_cells", "orientation_valid_cells"))
    broken = F.col("component_fraction") < st.component_fraction
    vf, sf = F.col("valid_orientation_fraction"), F.col("strong_orientation_fraction")
    orient = S.ladder([((vf < st.degraded_fraction) | (sf < st.degraded_fraction), "reject"), (sf >= st.ok_fraction, "ok")], "degraded")
    topo = F.when(broken, "degraded").otherwise("ok")
    qa = qa.withColumn("_topo", topo).withColumn("_orient", orient)
    few = F.coalesce(F.col("orientation_total_cells"), F.lit(0)) < st.min_cells
    early = [(F.col("dominant_cells").isNull(), "no_stable_edge_after_ocean_coastal_mask"), (F.col("dominant_cells") < st.min_cells, "dominant_edge_component_too_small"),
             (few, "normal_orientation_failed"), (F.col("orientation_valid_cells") == 0, "normal_orientation_failed:no_valid_bilateral_sic_samples")]
    text = F.concat(F.when(F.col("_topo") == "ok", "dominant_main_edge").otherwise("fragmented_edge_topology_dominant_component_used"), F.lit(";"),
                    S.ladder([(F.col("_orient") == "ok", "orientation_ok"), (F.col("_orient") == "degraded", "orientation_degraded")], "weak_orientation_contrast"))
    late = [(F.col("_orient") == "reject", text), (F.col("edge_cells") < st.min_cells, F.lit("normal_orientation_failed"))]
    qa = qa.withColumn("qa_reason", S.ladder([*early, *late], text))
    stop = F.lit(False)
    for c, _ in [*early, *late]:
        stop = stop | F.coalesce(c, F.lit(False))
    qa = qa.withColumn("qa_status", F.when(stop, "reject").otherwise(S.worst_status("_topo", "_orient"))).drop("_topo", "_orient")
    rows = out.filter(good).join(shuffled(qa.filter("qa_status <> 'reject'").select(*keys, "qa_status")), keys)
    rows = rows.select(*keys, "y", "x", F.col("lon").alias("edge_lon"), F.col("lat").alias("edge_lat"), F.col("value").alias("edge_value"), (F.col("_e") / F.col("_l")).alias("normal_east"), (F.col("_o") / F.col("_l")).alias("normal_north"), "qa_status")
    return rows, qa


def relative_wind(rows: DataFrame, met: DataFrame, lon0: float, lat0: float, lon_step: float, lat_step: float, n_lon: int, n_lat: int) -> DataFrame:
    """RAS-11: wind across and along the front at its nearest met nodes, averaged per (point, date)."""
    i, j = J.nearest_latlon_cell("edge_lon", "edge_lat", lon0, lat0, lon_step, lat_step, n_lon, n_lat)
    w = rows.withColumn("i", i).withColumn("j", j).join(met.select("date", "i", "j", "u10", "v10"), ["date", "i", "j"], "left")
    r = S.rotate_wind("u10", "v10", "normal_east", "normal_north")
    return w.groupBy("point_id", "date", "qa_status").agg(
        F.count(F.lit(1)).alias("edge_cells"), F.avg(r["normal"]).alias("outward_edge_normal_wind_ms"), F.avg(r["abs_normal"]).alias("abs_edge_normal_wind_ms"),
        F.avg(r["tangential"]).alias("edge_tangential_wind_ms"), F.avg(r["speed"]).alias("wind_speed_ms"))
