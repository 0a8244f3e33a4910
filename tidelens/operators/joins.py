"""Range, region, radius, nearest, interval and buffer joins as bucketed equi-joins.

No join here plans as a nested loop: days are exploded into equality keys, places
are hashed to cubes on the sphere or tiles on the projected plane, and the exact
predicate runs on the candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..session import durable
from . import ordered


# ---- time ---------------------------------------------------------------

def near_days(date: str | Column, tolerance: int) -> Column:
    d = S.col(date)
    return F.explode(F.sequence(F.date_sub(d, tolerance), F.date_add(d, tolerance)))


def flag_near_day(src: DataFrame, tgt: DataFrame, tolerance: int, name: str, keys: Sequence[str] = (),
                  date: str = "event_date", tgt_date: str = "event_date") -> DataFrame:
    """JOI-07: does a target lie within ``tolerance`` days (and share ``keys``)?

    Targets are reduced to distinct (day, keys) and widened to their neighbour days,
    so the joined side is bounded by the calendar and no pairs are produced.
    """
    keys = list(keys)
    days = tgt.select(*keys, near_days(tgt_date, tolerance).alias("_day")).distinct().withColumn(name, F.lit(True))
    cond = (F.col(date) == F.col("_day"))
    days = days.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_day", name)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    out = src.join(days, cond, "left").drop("_day", *[f"_k_{k}" for k in keys])
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def with_neighbour_regions(tgt: DataFrame, adjacent: DataFrame, region: str = "region") -> DataFrame:
    """Target rows repeated for their own region and for each region that lists it as a neighbour (one hop)."""
    hop = tgt.join(adjacent.select(F.col("b").alias(region), F.col("a").alias("_from")), region).withColumn(region, F.col("_from")).drop("_from")
    return tgt.unionByName(hop)


def flag_near_day_region(src, tgt, adjacent, tolerance: int, name: str, region="region", date="event_date") -> DataFrame:
    """JOI-08: as JOI-07 with the target region equal or adjacent to the source region."""
    reach = with_neighbour_regions(tgt.select(region, date).distinct(), adjacent, region)
    return flag_near_day(src, reach, tolerance, name, [region], date, date)


def missing_near_day(src, tgt, tolerance: int, date="event_date") -> DataFrame:
    """JOI-05: source rows with no target within the tolerance."""
    days = tgt.select(near_days(date, tolerance).alias(date)).distinct()
    return src.join(days, date, "left_anti")


def nearest_day_map(wanted: DataFrame, have: DataFrame, date: str = "date") -> DataFrame:
    """JOI-11: (date, nearest) for each wanted day; ties go to the earlier day.

    Both sides are distinct calendar days, so the single ordering is bounded by the calendar.
    """
    a = wanted.select(F.col(date).alias("d")).distinct().withColumn("h", F.lit(None).cast("date"))
    b = have.select(F.col(date).alias("d")).distinct().withColumn("h", F.col("d"))
    all_days = a.unionByName(b).groupBy("d").agg(F.max("h").alias("h"), F.max(F.col("h").isNull()).alias("asked"))
    o = W.partitionBy(F.lit(0)).orderBy("d")
    near = all_days.withColumn("p", F.last("h", True).over(o.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.first("h", True).over(o.rowsBetween(0, W.unboundedFollowing)))
    pick = F.when(F.col("n").isNull() | (F.datediff("d", "p") <= F.datediff("n", "d")), F.col("p")).otherwise(F.coalesce("n", "p"))
    return near.filter("asked").select(F.col("d").alias(date), pick.alias("nearest"))


def interval_members(windows: DataFrame, rows: DataFrame, start="window_start", end="window_end", date="date", row_start="start_date") -> DataFrame:
    """JOI-14: rows whose date falls inside the window and whose own start is not after its end.

    Windows are few days long: they are exploded to days and equi-joined, the second
    bound stays as a residual predicate.  Rows after the window end never match.
    """
    days = windows.withColumn(date, F.explode(F.sequence(start, end)))
    return days.join(rows, date).filter(F.col(row_start) <= F.col(end))


def covered_days(windows: DataFrame, start: str, end: str) -> DataFrame:
    return windows.select(F.explode(F.sequence(start, end)).alias("_day")).distinct()


def flag_overlap_any(rows: DataFrame, windows: DataFrame, name: str, start="window_start", end="window_end", w_start="window_start", w_end="window_end") -> DataFrame:
    """JOI-15: does the row's interval touch any window?  Both sides are compared through day sets."""
    busy = covered_days(windows, w_start, w_end)
    spans = rows.select(start, end).distinct().withColumn("_day", F.explode(F.sequence(start, end)))
    hit = spans.join(busy, "_day", "left_semi").select(start, end).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, [start, end], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flag_membership(rows: DataFrame, table: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """JOI-24: is the row's key among the distinct keys of another table?"""
    t = table.select(*[F.col(b).alias(f"_m_{a}") for a, b in keys.items()]).distinct().withColumn(name, F.lit(True))
    cond = None
    for a in keys:
        c = F.col(a) == F.col(f"_m_{a}")
        cond = c if cond is None else cond & c
    return rows.join(t, cond, "left").drop(*[f"_m_{a}" for a in keys]).withColumn(name, F.coalesce(name, F.lit(False)))


# ---- place --------------------------------------------------------------

def cube(lon, lat, side_km: float, shift: float = 0.0) -> list[Column]:
    """Cell of a point in a cube lattice around the globe; points within ``side_km`` differ by at most one step per axis.
    ``shift`` moves the lattice by that part of a side.

    Works across the pole and the date line without special cases: a chord is never longer than its arc.
    """
    p, q = F.radians(S.col(lat)), F.radians(S.col(lon))
    return [F.floor(c * S.EARTH_KM / side_km + shift).cast("int") for c in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))]


def cube_key(parts: Sequence[Column]) -> Column:
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("cx", "cy", "cz"))])


def around(parts: Sequence[Column], reach: int = 1) -> Column:
    """Array of the 27 cells around a cell."""
    step = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    grid = F.flatten(F.transform(step, lambda a: F.flatten(F.transform(step, lambda b: F.transform(step, lambda c: F.struct(
        (parts[0] + a).alias("cx"), (parts[1] + b).alias("cy"), (parts[2] + c).alias("cz")))))))
    return grid


def reachable(lon, lat, km: float) -> Column:
    """Array of the cubes of side ``km`` that a ball of radius ``km`` around a point touches: its own and some of the 26 around it."""
    p, q = F.radians(S.col(lat)), F.radians(S.col(lon))
    axes = []
    for c in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)):
        u = c * S.EARTH_KM / km
        at, part = F.floor(u).cast("int"), u - F.floor(u)
        axes.append(F.array(*[F.struct((at + step).alias("c"), gap.alias("g")) for step, gap in ((-1, part * part), (0, F.lit(0.0)), (1, (1 - part) * (1 - part)))]))
    box = lambda a, b, c: F.struct(a["c"].alias("cx"), b["c"].alias("cy"), c["c"].alias("cz"), (a["g"] + b["g"] + c["g"]).alias("g"))
    boxes = F.flatten(F.transform(axes[0], lambda a: F.flatten(F.transform(axes[1], lambda b: F.transform(axes[2], lambda c: box(a, b, c))))))
    return F.transform(F.filter(boxes, lambda s: s["g"] <= 1 + 1e-9), lambda s: F.struct(s["cx"].alias("cx"), s["cy"].alias("cy"), s["cz"].alias("cz")))


def radius_pairs(src: DataFrame, tgt: DataFrame, km: float, src_lonlat=("lon", "lat"), tgt_lonlat=("lon", "lat"),
                 on: Sequence[tuple[str, str]] = (), dist: str = "distance_km") -> DataFrame:
    """JOI-09 core: pairs within ``km`` that also agree on ``on``; column names of the sides must differ."""
    s = src.withColumn("_cell", F.explode(reachable(*src_lonlat, km)))
    t = tgt.withColumn("_tcell", cube_key(cube(*tgt_lonlat, km)))
    cond = F.col("_cell") == F.col("_tcell")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    d = S.haversine_km(*src_lonlat, *tgt_lonlat)
    return s.join(t, cond).withColumn(dist, d).filter(F.col(dist) <= km).drop("_cell", "_tcell")


def nearest_within(src: DataFrame, tgt: DataFrame, tolerance: int, km: float, id_col="event_id", date="event_date", lon="centroid_lon", lat="centroid_lat",
                   split_days: Sequence[int] | None = None) -> DataFrame:
    """JOI-09: smallest distance per source within the day tolerance, one column per entry of ``split_days``.

    Equal places on equal days are collapsed on both sides before pairing, so repeated
    copies of one place add no work; the result joins back to every copy.
    """
    split_days = list(split_days or [tolerance])
    s = src.select(F.col(date).alias("_sd"), F.col(lon).alias("_slon"), F.col(lat).alias("_slat")).distinct()
    t = tgt.select(F.col(date).alias("_td"), F.col(lon).alias("_tlon"), F.col(lat).alias("_tlat")).distinct()
    # slots of days as wide as the tolerance: a source looks into three at most
    wide = max(int(tolerance), 1)
    slot = lambda d: F.floor(d / wide).cast("int")
    probe = s.filter("_slon is not null and _slat is not null").withColumn("_slot", F.explode(F.sequence(slot(S.day_number("_sd") - tolerance), slot(S.day_number("_sd") + tolerance))))
    there = t.filter("_tlon is not null and _tlat is not null").withColumn("_tslot", slot(S.day_number("_td")))
    gap = F.abs(F.datediff("_sd", "_td"))
    pairs = radius_pairs(probe, there, km, ("_slon", "_slat"), ("_tlon", "_tlat"), [("_slot", "_tslot")]).filter(gap <= tolerance)
    near = pairs.groupBy("_sd", "_slon", "_slat").agg(*[F.min(F.when(gap <= k, F.col("distance_km"))).alias(f"nearest_km_{k}d") for k in split_days])
    cond = (F.col(date) == F.col("_sd")) & (F.col(lon) == F.col("_slon")) & (F.col(lat) == F.col("_slat"))
    return src.join(near, cond, "left").drop("_sd", "_slon", "_slat")


def nearest_gap(src: DataFrame, tgt: DataFrame, widest: int, name: str, keys: Sequence[str] = (), date: str = "event_date") -> DataFrame:
    """Smallest day gap to a target (sharing ``keys``) up to ``widest``; null when none.  One join serves every tolerance.

    Targets shrink to one row per (day, keys) before the join.
    """
    keys = list(keys)
    offs = F.explode(F.sequence(F.lit(-widest), F.lit(widest)))
    days = tgt.select(*keys, date).distinct().withColumn("_o", offs).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.date_add(date, F.col("_o")).alias("_day")).agg(F.min(F.abs("_o")).alias(name))
    cond = F.col(date) == F.col("_day")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return src.join(days, cond, "left").drop("_day", *[f"_k_{k}" for k in keys])


def match_matrix(pairs: Sequence[tuple[str, DataFrame, str, DataFrame]], adjacent: DataFrame, tolerances=(0, 1, 3), radii=(300, 500)) -> DataFrame:
    """JOI-10: share of source events with a match under every rule and tolerance, with distance quantiles."""
    rows = None
    widest = max(tolerances)
    cols = ["event_id", "region", "event_date", "centroid_lon", "centroid_lat"]
    for s_name, s, t_name, t in pairs:
        x = nearest_within(s.select(cols), t.select(cols), widest, max(radii), split_days=tolerances)
        x = nearest_gap(x, t, widest, "_any")
        x = nearest_gap(x, with_neighbour_regions(t.select("region", "event_date").distinct(), adjacent), widest, "_reg", ["region"])
        options = []
        hit = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
        for k in tolerances:
            none = F.lit(None).cast("double")
            options.append(F.struct(F.lit(f"time-only_pm{k}d").alias("rule"), hit("_any", k).alias("hit"), none.alias("km")))
            options.append(F.struct(F.lit(f"time+region_pm{k}d").alias("rule"), hit("_reg", k).alias("hit"), none.alias("km")))
            for r in radii:
                km = F.when(F.col(f"nearest_km_{k}d") <= r, F.col(f"nearest_km_{k}d"))
                options.append(F.struct(F.lit(f"time+centroid_{r}km_pm{k}d").alias("rule"), km.isNotNull().alias("hit"), km.alias("km")))
        flat = x.select(F.lit(s_name).alias("source"), F.lit(t_name).alias("target"), F.inline(F.array(*options)))
        rows = flat if rows is None else rows.unionByName(flat)
    keys = ["source", "target", "rule"]
    rows = durable(rows)
    counts = rows.groupBy(*keys).agg(F.count_if("hit").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    q = ordered.quantiles(rows.filter("km is not null"), keys, "km", {"median_km": 0.5, "p90_km": 0.9}).drop("n_values")
    return counts.join(q, keys, "left").withColumn("ratio", S.ratio("numerator", "denominator"))


# ---- regular grids --------------------------------------------------------

def nearest_latlon_cell(lon, lat, lon0: float, lat0: float, lon_step: float, lat_step: float, n_lon: int, n_lat: int) -> tuple[Column, Column]:
    """JOI-12: (row, column) of the nearest node of a regular grid; longitudes wrap, latitudes clip."""
    i = F.rint((S.col(lat) - lat0) / lat_step)
    j = F.pmod(F.rint(F.pmod(S.col(lon) - lon0, F.lit(360.0)) / lon_step), F.lit(float(n_lon)))
    return F.least(F.greatest(i, F.lit(0.0)), F.lit(float(n_lat - 1))).cast("int"), j.cast("int")


def nearest_projected_cell(px, py, x0: float, y0: float, step_x: float, step_y: float) -> tuple[Column, Column]:
    """JOI-13 / FLT-07: (y, x) indices by rounding; callers equi-join and read a miss as outside."""
    return F.rint((S.col(py) - y0) / step_y).cast("int"), F.rint((S.col(px) - x0) / step_x).cast("int")


def plane_pairs(points: DataFrame, grid: DataFrame, max_km: float, px="px_m", py="py_m", keep: Sequence[str] = ("point_id",), grid_cols: Sequence[str] = ()) -> DataFrame:
    """JOI-16 core: cells of a projected grid within ``max_km`` of a point, with the distance.

    The pairing depends on place only, so it is made once and reused for every day and radius.
    """
    side = max_km * 1000.0
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    p = points.select(*keep, px, py).withColumn("_dx", near).withColumn("_dy", near).withColumn("_tx", tile(px) + F.col("_dx")).withColumn("_ty", tile(py) + F.col("_dy"))
    g = grid.select("y", "x", "x_m", "y_m", *grid_cols).withColumn("_tx", tile("x_m")).withColumn("_ty", tile("y_m"))
    km = F.sqrt(F.pow(F.col("x_m") - F.col(px), 2) + F.pow(F.col("y_m") - F.col(py), 2)) / 1000.0
    return p.join(g, ["_tx", "_ty"]).withColumn("km", km).filter(F.col("km") <= max_km).select(*keep, "y", "x", "km", *grid_cols)


def buffer_means(pairs: DataFrame, asks: DataFrame, field: DataFrame, radii: Sequence[int], id_col="point_id", date="sample_date", value="value") -> DataFrame:
    """JOI-16: mean and count of present values per (point, day, radius); an empty buffer gives a null mean and count 0.

    ``asks`` lists distinct (point, day).  All radii come from one pass over the widest pairing.
    """
    days = asks.select(F.col(date).alias("date")).distinct()
    seen = asks.join(pairs, id_col).join(field.join(days, "date", "left_semi").select(F.col("date").alias(date), "y", "x", value), [date, "y", "x"])
    aggs = []
    for r in radii:
        inside = F.when(F.col("km") <= r, F.col(value))
        aggs += [F.avg(inside).alias(f"mean_{r}"), F.count(inside).alias(f"n_{r}")]
    wide = asks.join(seen.groupBy(id_col, date).agg(*aggs), [id_col, date], "left")
    each = F.inline(F.array(*[F.struct(F.lit(int(r)).alias("buffer_km"), F.col(f"mean_{r}").alias("mean"), F.coalesce(F.col(f"n_{r}"), F.lit(0)).alias("n_cells")) for r in radii]))
    return wide.select(id_col, date, each)


def lag_buffers(events: DataFrame, pairs: DataFrame, field: DataFrame, lags: Sequence[int], radii: Sequence[int], change_days: int = 5, id_col="point_id", date="event_date", value="value") -> DataFrame:
    """JOI-18: buffer mean per event, lag and radius with its change over ``change_days``; every needed (event, day) is read once."""
    want = events.select(id_col, date, F.explode(F.array(*[F.lit(v) for v in lags])).alias("lag")).withColumn("sample_date", F.date_add(date, F.col("lag")))
    asks = want.select(id_col, "sample_date").unionByName(want.select(id_col, F.date_sub("sample_date", change_days).alias("sample_date"))).distinct()
    means = buffer_means(pairs, asks, field, radii, id_col, "sample_date", value)
    now = means.select(id_col, "sample_date", "buffer_km", F.col("mean").alias("mean_buffer"), F.col("n_cells").alias("valid_cells"))
    before = means.select(id_col, F.date_add("sample_date", change_days).alias("sample_date"), "buffer_km", F.col("mean").alias("_before"))
    keys = [id_col, "sample_date"]
    return (want.join(now, keys).join(before, [*keys, "buffer_km"], "left")
            .withColumn("change_buffer", F.col("mean_buffer") - F.col("_before")).drop("_before"))


def displaced_points(events: DataFrame, references: DataFrame, region="region") -> DataFrame:
    """JOI-19: every event repeated at the reference point of every other region (references: a handful of rows)."""
    refs = references.select(F.col("region").alias("sample_region"), "ref_lon", "ref_lat").agg(F.collect_list(F.struct("sample_region", "ref_lon", "ref_lat")).alias("refs"))
    return (events.withColumn("_r", F.explode(refs.scalar())).select(events["*"], "_r.*").filter(F.col("sample_region") != F.col(region)))


def sphere_buffer_means(points: DataFrame, met: DataFrame, radii: Sequence[int], id_col="point_id", date="sample_date", lon="lon", lat="lat") -> DataFrame:
    """JOI-17: mean pressure (hPa), wind parts and speed of the mean wind within a great-circle radius.

    The speed belongs to the mean vector, not to the mean of speeds; a variable without a value in reach stays null.
    """
    nodes = met.select(F.col("lat").alias("_glat"), F.col("lon").alias("_glon")).distinct()
    places = points.select(F.col(lon).alias("_plon"), F.col(lat).alias("_plat")).distinct()
    pairs = radius_pairs(places, nodes, max(radii), ("_plon", "_plat"), ("_glon", "_glat"), dist="km")
    m = met.select(F.col("date").alias(date), F.col("lat").alias("_glat"), F.col("lon").alias("_glon"), "msl", "u10", "v10")
    located = points.select(id_col, date, F.col(lon).alias("_plon"), F.col(lat).alias("_plat"))
    rows = located.join(pairs, ["_plon", "_plat"]).join(m, [date, "_glat", "_glon"])
    aggs = []
    for r in radii:
        near = F.col("km") <= r
        aggs += [F.avg(F.when(near, F.col(v))).alias(f"{v}_{r}") for v in ("msl", "u10", "v10")]
    wide = points.select(id_col, date).join(rows.groupBy(id_col, date).agg(*aggs), [id_col, date], "left")
    each = F.inline(F.array(*[F.struct(
        F.lit(int(r)).alias("buffer_km"), S.pa_to_hpa(f"msl_{r}").alias("msl_hpa"), F.col(f"u10_{r}").alias("u10"), F.col(f"v10_{r}").alias("v10"),
        F.hypot(F.col(f"u10_{r}"), F.col(f"v10_{r}")).alias("wspd10")) for r in radii]))
    return wide.select(id_col, date, each)


# ---- contracts and pairings -------------------------------------------------

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], contract: str = "many_to_one", how: str = "inner") -> DataFrame:
    """JOI-02: join that raises when a side promised to be unique is not.

    Uniqueness is tested where the rows already meet: the promised side is aggregated by
    key, and a duplicate makes ``raise_error`` fire in the task that sees it.
    """
    def unique(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_r"))
        safe = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit(f"duplicate join key {list(keys)}")))
        g = g.withColumn("_r", safe)
        return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else g.select(*keys)

    r = unique(right)
    l = unique(left) if contract == "one_to_one" else left
    return l.join(r, list(keys), how)


def paired_tables(primary: DataFrame, other: DataFrame, keys: Sequence[str], tags=("primary", "floor")) -> DataFrame:
    """JOI-03: full outer pairing with prefixed columns and the side each key was seen on."""
    def side(df, tag):
        return df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"_in_{tag}"))
    both = side(primary, tags[0]).join(side(other, tags[1]), list(keys), "full_outer")
    a, b = (F.coalesce(F.col(f"_in_{t}"), F.lit(False)) for t in tags)
    where = F.when(a & b, "both").when(a, tags[0]).otherwise(tags[1])
    return both.withColumn("seen_in", where).drop(*[f"_in_{t}" for t in tags])


def count_comparison(primary: DataFrame, other: DataFrame, keys: Sequence[str], count="n", tags=("primary", "floor")) -> DataFrame:
    """JOI-04: counts side by side with zero for an absent key, difference and relative change."""
    p = primary.select(*keys, F.col(count).alias(tags[0])).join(other.select(*keys, F.col(count).alias(tags[1])), list(keys), "full_outer").fillna(0, list(tags))
    diff = F.col(tags[1]) - F.col(tags[0])
    return p.withColumn("difference", diff).withColumn("relative_change", S.ratio(diff, tags[0]))
