"""Pressure-centre candidates, thinning, daily metrics and proximity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..session import durable
from . import joins as J, raster as R


def candidates(field: DataFrame, lat_min: float, max_hpa: float, min_depth: float, ring: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    """RAS-08 before thinning: strict minima that are deep enough and far enough north.

    The cheap predicates run first, so the ring is fanned out for few cells only.
    """
    f = field.withColumn("hpa", S.pa_to_hpa("msl"))
    low = R.strict_minima(f, keys, "hpa", "i", "j").filter((F.col("lat") >= lat_min) & (F.col("hpa") <= max_hpa))
    deep = R.ring_mean(low, f, keys, "hpa", ring, "i", "j").withColumn("depth_hpa", F.col("ring_mean") - F.col("hpa"))
    return deep.filter(F.col("depth_hpa") >= min_depth).select(*keys, "i", "j", "lat", S.lon180("lon").alias("lon"), F.col("hpa").alias("center_pressure_hpa"), "depth_hpa")


def _km(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def thin(df: DataFrame, min_km: float, max_count: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    """TOP-03: lowest pressure first, keep a centre when it is far enough from all kept ones, up to ``max_count`` per time.

    A centre can be decided as soon as none before it within ``min_km`` is undecided, so every round keeps
    all centres of all times that are lower than their undecided neighbours and drops those around them.
    What is kept of one time lies ``min_km`` apart and is few.
    """
    keys, order = list(keys), F.struct("center_pressure_hpa", "i", "j")
    rows = durable(df.withColumn("_o", order))
    later = rows.select(*keys, "_o", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    first = rows.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col("_o").alias("_first"), F.col("lon").alias("_flon"), F.col("lat").alias("_flat"))
    near = J.radius_pairs(later, first, min_km, ("_lon", "_lat"), ("_flon", "_flat"), [(k, f"_f_{k}") for k in keys], "_km")
    near = durable(near.filter((F.col("_first") < F.col("_o")) & (F.col("_km") < min_km)).select(*keys, "_first", "_o"))
    ahead = lambda t: t.withColumnRenamed("_o", "_first")
    open_, kept = rows.select(*keys, "_o"), None
    while True:
        now = open_.join(near.select(*keys, "_o").distinct(), [*keys, "_o"], "left_anti")
        kept = now if kept is None else kept.unionByName(now)
        beaten = near.join(ahead(now), [*keys, "_first"], "left_semi").select(*keys, "_o").distinct()
        open_ = durable(near.select(*keys, "_o").distinct().join(beaten, [*keys, "_o"], "left_anti"))
        if open_.isEmpty():
            break
        near = durable(near.join(ahead(open_), [*keys, "_first"], "left_semi").join(open_, [*keys, "_o"], "left_semi"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_o"))
    best = kept.withColumn("_place", place).filter(F.col("_place") <= max_count)
    return rows.join(best.select(*keys, "_o"), [*keys, "_o"], "left_semi").drop("_o")


def nearest_centre(asks: DataFrame, points: DataFrame, radii=(500, 1000), id_cols: Sequence[str] = ("event_id", "lag"), day="sample_date") -> DataFrame:
    """JOI-20: nearest centre of the day with its pressure, and counts within radii.

    A day without centres keeps the row: nearest columns null, counts 0.  Places and days
    are collapsed before pairing.  Counts need the widest radius only; places without a centre in
    it look twice as far each round, up to the antipode, and the first round that finds any has found the nearest.
    """
    places = asks.select(day, F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).filter("lon is not null and lat is not null").distinct()
    p = points.select(F.col("date").alias("_pday"), F.col("lon").alias("_plon"), F.col("lat").alias("_plat"), "center_pressure_hpa")
    at = [day, "_lon", "_lat"]

    def within(t: DataFrame, reach: float) -> DataFrame:
        d = J.radius_pairs(t, p, reach, ("_lon", "_lat"), ("_plon", "_plat"), [(day, "_pday")], "km")
        return d.groupBy(*at).agg(
            F.min("km").alias("nearest_cyclone_distance_km"),
            F.min_by("center_pressure_hpa", F.struct("km", "center_pressure_hpa")).alias("nearest_cyclone_pressure_hpa"),
            *[F.count_if(F.col("km") <= r).alias(f"cyclone_count_{r}km") for r in radii])

    reach = float(max(radii))
    m = durable(within(places, reach))
    rest = durable(places.join(p.select(F.col("_pday").alias(day)).distinct(), day, "left_semi").join(m, at, "left_anti"))
    while reach < math.pi * S.EARTH_KM and not rest.isEmpty():
        reach = min(2 * reach, math.pi * S.EARTH_KM + 1)
        found = durable(within(rest, reach))
        m, rest = m.unionByName(found), durable(rest.join(found, at, "left_anti"))
    out = asks.join(m.withColumnRenamed(day, "_day"), (F.col(day) == F.col("_day")) & (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), "left")
    return out.drop("_day", "_lon", "_lat").fillna(0, [f"cyclone_count_{r}km" for r in radii])


def region_centre(bounds) -> tuple[float, float]:
    """Plan-time centre of a box that may cross the date line."""
    lo, hi, south, north = bounds
    if abs(hi - lo) >= 360:
        lon = 0.0
    else:
        a, b = lo % 360, hi % 360
        lon = (a + b) / 2 if a <= b else ((a + b + 360) / 2) % 360
    return (lon + 180) % 360 - 180, (south + north) / 2


def daily_metrics(points: DataFrame, first_year: int, last_year: int, months, bounds, radius_km: float) -> DataFrame:
    """JOI-21: one row per calendar day: counts (0 when none) and the nearest centre (null when none)."""
    lon, lat = region_centre(bounds)
    cal = points.sparkSession.range(1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"))).alias("date")).filter(S.in_months("date", months))
    d = points.withColumn("km", S.haversine_km(F.lit(lon), F.lit(lat), "lon", "lat"))
    near = F.min_by(F.struct(F.col("km").alias("nearest_cyclone_distance_km"), F.col("center_pressure_hpa").alias("nearest_cyclone_pressure_hpa"),
                             F.col("lat").alias("nearest_cyclone_lat"), F.col("lon").alias("nearest_cyclone_lon")), F.struct("km", "center_pressure_hpa"))
    per = d.groupBy("date").agg(F.count(F.lit(1)).alias("cyclone_count"), F.count_if(F.col("km") <= radius_km).alias("cyclone_count_near"), near.alias("n"))
    out = cal.join(per, "date", "left").select("date", "cyclone_count", "cyclone_count_near", "n.*").fillna(0, ["cyclone_count", "cyclone_count_near"])
    return out.withColumn("cyclone_near", (F.col("cyclone_count_near") > 0).cast("int"))
