"""Area-weighted budgets, class partitions, footprint overlap and composition.

Budgets never expand events against the grid.  A window budget depends on its dates
only, so it is computed once per distinct window and region code; an event then adds or
subtracts the sums over its own sparse footprint cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, geometry as G, scalar as S
from ..session import durable, shuffle_width, shuffled
from ..sources.catalog import first_per_group
from . import joins as J, ordered, raster as RA


def ocean(code: str = "region_code") -> Column:
    return F.col(code).isin(*fixed.OCEAN_CODES)


def extent_by_date(field: DataFrame, grid: DataFrame, inside: Column, out: str) -> DataFrame:
    """AGG-44: area of the cells that satisfy ``inside``, in million km2 per date."""
    f = field.join(shuffled(grid.select("y", "x", "area_km2", "region_code")), ["y", "x"])
    return f.groupBy("date").agg((F.sum(F.when(inside, F.col("area_km2")).otherwise(0.0)) / 1e6).alias(out))


# ---- window budgets -----------------------------------------------------------

def change_cells(field: DataFrame, grid: DataFrame, days: int, dates: DataFrame | None = None, stored_as_float: bool = False) -> DataFrame:
    """Ocean cells with their change, loss and gain over the window that ends at ``date``.

    ``stored_as_float`` repeats the rounding of a float32 store before anything is summed.
    """
    d = RA.window_difference(field, days, dates)
    c = d.join(shuffled(grid.select("y", "x", "area_km2", "region_code")), ["y", "x"]).filter(ocean())
    if stored_as_float:
        c = c.withColumn("delta", F.col("delta").cast("float").cast("double"))
    return c.withColumn("loss", F.greatest(-F.col("delta"), F.lit(0.0))).withColumn("gain", F.greatest(F.col("delta"), F.lit(0.0)))


def region_window_budget(cells: DataFrame) -> DataFrame:
    """AGG-17: loss, gain, valid area and initial amount per (date, region code): days x 19 rows at most."""
    a = F.col("area_km2")
    return cells.groupBy("date", "region_code").agg(
        F.sum(F.col("loss") * a).alias("loss"), F.sum(F.col("gain") * a).alias("gain"), F.sum(F.col("delta") * a).alias("signed"),
        F.sum(a).alias("valid_area"), F.sum(F.col("start_value") * a).alias("initial"), F.count(F.lit(1)).alias("cells"))


def field_budget(region_budget: DataFrame) -> DataFrame:
    """AGG-19: signed, loss and gain integrals per window with the closure of gain - loss - signed."""
    g = region_budget.groupBy("date").agg(F.sum("loss").alias("gross_loss"), F.sum("gain").alias("gross_gain"), F.sum("signed").alias("signed_change"))
    err = F.col("gross_gain") - F.col("gross_loss") - F.col("signed_change")
    return g.withColumn("closure_error", err).withColumn("closure_status", F.when(S.is_close(err, F.lit(0.0), 1e-12, 1e-6), "PASS").otherwise("FAIL"))


def domain_budgets(events: DataFrame, region_budget: DataFrame, own_cells: DataFrame, cells: DataFrame, source_codes: DataFrame, id_col: str, date: str = "date") -> DataFrame:
    """AGG-16 / AGG-41 / RAS-14 / STA-21: metrics of the global, local, residual and other-region domains per event.

    events (id, date); own_cells (id, date, y, x): the footprint that leaves the residual;
    source_codes (id, region_code): regions left out of the other-region domain.
    residual = global - local and other = named regions - source regions, so the work per
    event is its footprint plus 19 numbers.
    """
    rb = region_budget.groupBy("date").agg(
        *[F.sum(c).alias(f"global_{c}") for c in ("loss", "gain", "valid_area", "initial")],
        *[F.sum(F.when(F.col("region_code").between(1, 18), F.col(c)).otherwise(0.0)).alias(f"named_{c}") for c in ("loss", "gain", "valid_area", "initial")])
    a = F.col("area_km2")
    own = own_cells.select(id_col, "date", "y", "x").distinct().join(shuffled(cells.select("date", "y", "x", "loss", "gain", "start_value", "area_km2")), ["date", "y", "x"])
    local = own.groupBy(id_col).agg(F.sum(F.col("loss") * a).alias("local_loss"), F.sum(F.col("gain") * a).alias("local_gain"), F.sum(a).alias("local_valid_area"), F.sum(F.col("start_value") * a).alias("local_initial"))
    src = events.select(id_col, F.col(date).alias("date")).join(source_codes.select(id_col, "region_code").distinct(), id_col)
    src = src.join(region_budget, ["date", "region_code"]).groupBy(id_col).agg(*[F.sum(c).alias(f"source_{c}") for c in ("loss", "gain", "valid_area", "initial")])
    e = events.select(id_col, F.col(date).alias("date")).join(rb, "date").join(local, id_col, "left").join(src, id_col, "left")
    e = e.fillna(0.0, [c for c in e.columns if c.startswith(("local_", "source_"))])
    for c in ("loss", "gain", "valid_area", "initial"):
        e = e.withColumn(f"residual_{c}", F.col(f"global_{c}") - F.col(f"local_{c}")).withColumn(f"other_region_{c}", F.col(f"named_{c}") - F.col(f"source_{c}"))
    for d in ("global", "local", "residual", "other_region"):
        e = e.withColumn(f"{d}_net_loss", F.col(f"{d}_loss") - F.col(f"{d}_gain")).withColumn(f"{d}_compensation_ratio", S.ratio(f"{d}_gain", f"{d}_loss"))
        e = e.withColumn(f"{d}_loss_fraction", S.ratio(f"{d}_loss", f"{d}_initial")).withColumn(f"{d}_mean_loss", S.ratio(f"{d}_loss", f"{d}_valid_area"))
    return e.drop(*[c for c in e.columns if c.startswith(("named_", "source_"))])


# ---- coded raster ---------------------------------------------------------------

def code_transitions(coded: DataFrame, grid: DataFrame, before: int, after: int, dates: DataFrame | None = None) -> DataFrame:
    """Start and end code of every cell for the window [T - before, T + after]; ``date`` is T."""
    w = W.partitionBy("y", "x").orderBy(S.day_number("date"))
    at = lambda k: F.first("code").over(w.rangeBetween(k, k))
    src = coded
    if dates is not None:
        d = dates.select("date").distinct()
        src = coded.join(d.select(F.date_sub("date", before).alias("date")).unionByName(d.select(F.date_add("date", after).alias("date"))).distinct(), "date", "left_semi")
    ends = src.withColumn("start_code", at(-(before + after))).filter(F.col("start_code").isNotNull()).withColumnRenamed("code", "end_code").withColumn("date", F.date_sub("date", after))
    ends = ends.join(dates.select("date").distinct(), "date", "left_semi") if dates is not None else ends
    s, e = F.col("start_code"), F.col("end_code")
    physical = s.isin(0, 1) & e.isin(0, 1)
    return ends.join(shuffled(grid.select("y", "x", "area_km2", "region_code")), ["y", "x"]).select(
        "date", "y", "x", "start_code", "end_code", "area_km2", "region_code",
        (physical & (s == 1) & (e == 0)).alias("is_loss"), (physical & (s == 0) & (e == 1)).alias("is_gain"),
        (~physical & (s == 1) & (e != 1)).alias("status_loss"), (~physical & (s != 1) & (e == 1)).alias("status_gain"))


def transition_budget(tr: DataFrame) -> DataFrame:
    """AGG-18: areas of loss, gain and status changes per date with their closure against the coded extent change."""
    total = lambda c, n: F.sum(F.when(c, F.col("area_km2")).otherwise(0.0)).alias(n)
    s, e = F.col("start_code"), F.col("end_code")
    b = tr.groupBy("date").agg(
        total(F.col("is_loss"), "gross_loss"), total(F.col("is_gain"), "gross_gain"), total(F.col("status_loss"), "status_loss"), total(F.col("status_gain"), "status_gain"),
        total(e == 1, "_e"), total(s == 1, "_s"), total((s == 255) | (e == 255), "missing_touch"), total(s.isin(253, 254) | e.isin(253, 254), "other_touch"))
    act = F.col("status_loss") + F.col("status_gain")
    b = b.withColumn("extent_delta", F.col("_e") - F.col("_s")).withColumn("status_activity_fraction", S.ratio(act, F.col("gross_loss") + F.col("gross_gain") + act))
    err = F.col("gross_gain") - F.col("gross_loss") + F.col("status_gain") - F.col("status_loss") - F.col("extent_delta")
    return b.withColumn("closure_error", err).withColumn("status", F.when(S.is_close(err, F.lit(0.0), 1e-12, 1e-6), "PASS").otherwise("FAIL")).drop("_e", "_s")


# ---- class partition ----------------------------------------------------------------

def track_windows(dates: DataFrame, track: str) -> DataFrame:
    before, after = fixed.TRACKS[track]
    d = dates.select("date").distinct()
    return d.select(F.col("date").alias("window_date"), F.date_sub("date", before).alias("window_start"), F.date_add("date", after).alias("window_end"))


def aligned_members(dates: DataFrame, members: DataFrame, track: str) -> DataFrame:
    """Members inside the window of each distinct event date (JOI-14); ``window_date`` is the event date."""
    # distinct days only: bounded by the calendar, so a crowded day is not shuffled to one task
    return J.interval_members(track_windows(dates, track), members)


def class_cells(dates: DataFrame, members: DataFrame, patch_cells: DataFrame, track: str) -> DataFrame:
    """RAS-12 / RAS-13: highest level per (event date, cell), with a flag per level for the overlap audit.

    Objects are reduced to one row per (date, object) before their cells are read; an
    absent cell is class 0 and is never stored.
    """
    objects = aligned_members(dates, members, track).groupBy(F.col("window_date").alias("event_day"), "object_id").agg(F.max("level").alias("level"), *[F.bool_or(F.col("level") == k).alias(f"_l{k}") for k in (1, 2, 3)])
    hit = objects.join(shuffled(patch_cells.select("object_id", "y", "x")), "object_id")
    return hit.groupBy(F.col("event_day").alias("date"), "y", "x").agg(F.max("level").alias("class"), F.bool_or("_l1").alias("has_broad"), F.bool_or("_l2").alias("has_severe"), F.bool_or("_l3").alias("has_major"))


def class_overlap_audit(cells: DataFrame, n_grid_cells: int | Column) -> DataFrame:
    """RAS-13: raw and exclusive cells per level, pairwise and triple overlaps, and the expected-partition check."""
    b, s, m = F.col("has_broad"), F.col("has_severe"), F.col("has_major")
    n = lambda c, a: F.count_if(c).alias(a)
    expected = F.when(m, 3).when(s, 2).when(b, 1)
    a = cells.groupBy("date").agg(n(m, "raw_major"), n(s, "raw_severe"), n(b, "raw_broad"), n(m & s, "major_severe_overlap"), n(m & b, "major_broad_overlap"), n(s & b, "severe_broad_overlap"),
                                  n(m & s & b, "triple_overlap"), n((m & s) | (m & b) | (s & b), "cross_overlap"), F.count(F.lit(1)).alias("union_cells"),
                                  n(F.col("class") == 3, "class_3"), n(F.col("class") == 2, "class_2"), n(F.col("class") == 1, "class_1"), n(F.col("class") != expected, "_bad"))
    total = n_grid_cells if isinstance(n_grid_cells, Column) else F.lit(n_grid_cells)
    return a.withColumn("class_0", total - F.col("union_cells")).withColumn("cross_fraction", S.ratio("cross_overlap", "union_cells")).withColumn("status", F.when(F.col("_bad") == 0, "PASS").otherwise("FAIL")).drop("_bad")


def class_budget(cells: DataFrame, classes: DataFrame, loss: str | Column = "loss", gain: str | Column = "gain") -> DataFrame:
    """AGG-20: loss and gain per exclusive class and date, fractions, closure and net efficiency.

    ``cells`` carries date, y, x, area and loss/gain weights in km2.  One left join on the
    sparse classes; class 0 is every cell without one.
    """
    c = cells.join(classes.select("date", "y", "x", "class"), ["date", "y", "x"], "left").withColumn("class", F.coalesce("class", F.lit(0)))
    lw, gw = S.col(loss), S.col(gain)
    # per (date, class) first: at most four rows per date meet in the final step
    per = c.groupBy("date", "class").agg(F.sum(lw).alias("l"), F.sum(gw).alias("g"))
    aggs = [F.sum("l").alias("gross_loss"), F.sum("g").alias("gross_gain")]
    for k, name in fixed.CLASS_NAMES.items():
        aggs += [F.sum(F.when(F.col("class") == k, F.col("l")).otherwise(0.0)).alias(f"loss_{name}"), F.sum(F.when(F.col("class") == k, F.col("g")).otherwise(0.0)).alias(f"gain_{name}")]
    b = per.groupBy("date").agg(*aggs)
    names = list(fixed.CLASS_NAMES.values())
    for name in names:
        b = b.withColumn(f"loss_fraction_{name}", S.ratio(f"loss_{name}", "gross_loss"))
    add = lambda p: sum((F.col(f"{p}_{n}") for n in names[1:]), F.col(f"{p}_{names[0]}"))
    b = b.withColumn("loss_closure_error", add("loss") - F.col("gross_loss")).withColumn("gain_closure_error", add("gain") - F.col("gross_gain"))
    ok = S.is_close("loss_closure_error", F.lit(0.0), 1e-12, 1e-6) & S.is_close("gain_closure_error", F.lit(0.0), 1e-12, 1e-6)
    return (b.withColumn("closure_status", F.when(ok, "PASS").otherwise("FAIL")).withColumn("compensation_ratio", S.ratio("gross_gain", "gross_loss"))
            .withColumn("net_loss_efficiency", S.ratio(F.col("gross_loss") - F.col("gross_gain"), "gross_loss")))


def dense_region_budget(events: DataFrame, region_budget: DataFrame, codes: Sequence[int] = range(0, 19), id_col="pan_event_id", date="event_date") -> DataFrame:
    """AGG-21: every event against every region code, zero rows kept."""
    e = events.select(id_col, F.col(date).alias("date")).withColumn("region_code", F.explode(F.array(*[F.lit(c) for c in codes])))
    return e.join(region_budget.select("date", "region_code", "loss", "gain"), ["date", "region_code"], "left").fillna(0.0, ["loss", "gain"])


def budget_accounting(totals: DataFrame, by_region: DataFrame, id_col="pan_event_id") -> DataFrame:
    """AGG-22: loss outside the listed codes, as amount and fraction."""
    r = by_region.groupBy(id_col).agg(F.sum("loss").alias("codes_loss"))
    return totals.join(r, id_col, "left").withColumn("unassigned_loss", F.col("gross_loss") - F.col("codes_loss")).withColumn("unassigned_fraction", S.ratio("unassigned_loss", "gross_loss"))


# ---- composition ----------------------------------------------------------------------

def composition(df: DataFrame, keys: Sequence[str], value: str, top: int = 3) -> DataFrame:
    """AGG-23: effective number, largest share, top-n share over the positive values of a group."""
    pos = df.filter(F.col(value) > 0)
    v = F.col(value)
    a = pos.groupBy(*keys).agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("n_parts"), F.sum(v * v).alias("_sq"), F.max(v).alias("_mx"))
    tops = first_per_group(pos.select(*keys, value), list(keys), [F.col(value).desc()], top).groupBy(*keys).agg(F.sum(value).alias("_top"))
    return a.join(tops, list(keys)).select(*keys, "n_parts", "total", (F.pow("total", 2) / F.col("_sq")).alias("effective_number"), S.ratio("_mx", "total").alias("largest_share"), S.ratio("_top", "total").alias("top_share"))


def component_spread(components: DataFrame, keys: Sequence[str], loss="loss", lon="lon", lat="lat", id_col="component", ellipsoid: bool = True) -> DataFrame:
    """AGG-24: distance between the two largest components and the weighted spread about the spherical centroid."""
    keys = list(keys)
    dist = (lambda a, b, c, d: G.geodesic_km(a, b, c, d)) if ellipsoid else (lambda a, b, c, d: S.haversine_km(a, b, c, d))
    p = components.filter((F.col(loss) > 0) & F.col(lon).isNotNull() & F.col(lat).isNotNull())
    w, q, f = F.col(loss), F.radians(lon), F.radians(lat)
    cen = p.groupBy(*keys).agg(F.sum(w).alias("_t"), F.count(F.lit(1)).alias("n_components"), F.sum(w * F.cos(f) * F.cos(q)).alias("_x"), F.sum(w * F.cos(f) * F.sin(q)).alias("_y"), F.sum(w * F.sin(f)).alias("_z"))
    cen = cen.withColumn("_clon", F.degrees(F.atan2("_y", "_x"))).withColumn("_clat", F.degrees(F.atan2(F.col("_z"), F.hypot("_x", "_y"))))
    far = p.join(cen, keys).withColumn("_d", dist(F.col("_clon"), F.col("_clat"), F.col(lon), F.col(lat)))
    spread = far.groupBy(*keys).agg(F.sqrt(F.sum(w * F.pow("_d", 2)) / F.max("_t")).alias("weighted_spread_km"), F.max("n_components").alias("n_components"))
    two = first_per_group(p.select(*keys, id_col, loss, lon, lat), keys, [F.col(loss).desc(), id_col], 2)
    # the two largest rows per key
    pair = two.groupBy(*keys).agg(F.max_by(F.struct(lon, lat), F.struct(F.col(loss), -F.col(id_col))).alias("a"), F.min_by(F.struct(lon, lat), F.struct(F.col(loss), -F.col(id_col))).alias("b"))
    pair = pair.select(*keys, F.col(f"a.{lon}").alias("_alon"), F.col(f"a.{lat}").alias("_alat"), F.col(f"b.{lon}").alias("_blon"), F.col(f"b.{lat}").alias("_blat"))
    pair = pair.withColumn("_two", dist(F.col("_alon"), F.col("_alat"), F.col("_blon"), F.col("_blat")))
    many = F.col("n_components") >= 2
    return spread.join(pair, keys).select(*keys, "n_components", F.when(many, F.col("_two")).alias("top2_distance_km"), F.when(many, F.col("weighted_spread_km")).alias("weighted_spread_km"))


def region_composition(by_region: DataFrame, keys: Sequence[str], value="loss") -> DataFrame:
    """AGG-25: composition over the named regions and the share outside them."""
    named = composition(by_region.filter(F.col("region_code").between(1, 18)), keys, value).drop("total", "n_parts")
    out = by_region.groupBy(*keys).agg(F.sum(value).alias("_t"), F.sum(F.when(F.col("region_code") == 0, F.col(value)).otherwise(0.0)).alias("_o"))
    return out.join(named, list(keys), "left").withColumn("non_region_fraction", S.ratio("_o", "_t")).drop("_t", "_o")


# ---- footprint overlap -----------------------------------------------------------------

def footprints(dates: DataFrame, members: DataFrame, patch_cells: DataFrame, track: str = "cdr") -> DataFrame:
    """Distinct cells of each (event date, local event), with its level."""
    m = aligned_members(dates, members, track).select(F.col("window_date").alias("event_day"), "unique_local_event_id", "level", "object_id")
    return m.join(shuffled(patch_cells.select("object_id", "y", "x")), "object_id").groupBy(F.col("event_day").alias("date"), "unique_local_event_id", "y", "x").agg(F.max("level").alias("level"))


def footprint_sums(prints: DataFrame, cells: DataFrame, grid: DataFrame, keys: Sequence[str], transitions: DataFrame | None = None) -> DataFrame:
    """AGG-26: cells, area, loss and gain (and coded loss/gain) of a footprint; cells are counted once per key."""
    p = prints.select(*keys, "y", "x").distinct().join(shuffled(grid.select("y", "x", "area_km2")), ["y", "x"]).join(cells.select("date", "y", "x", "loss", "gain"), ["date", "y", "x"], "left")
    a = F.col("area_km2")
    aggs = [F.count(F.lit(1)).alias("cells"), F.sum(a).alias("area_km2"), F.sum(F.coalesce(F.col("loss") * a, F.lit(0.0))).alias("loss"), F.sum(F.coalesce(F.col("gain") * a, F.lit(0.0))).alias("gain")]
    if transitions is not None:
        p = p.join(transitions.select("date", "y", "x", "is_loss", "is_gain"), ["date", "y", "x"], "left")
        aggs += [F.sum(F.when(F.col("is_loss"), a).otherwise(0.0)).alias("coded_loss"), F.sum(F.when(F.col("is_gain"), a).otherwise(0.0)).alias("coded_gain")]
    return p.groupBy(*keys).agg(*aggs)


def footprint_components(prints: DataFrame, components: DataFrame, cells: DataFrame | None, grid: DataFrame) -> DataFrame:
    """JOI-22 / AGG-27: intersection of footprints with components: area, IoU, capture fractions, loss-weighted overlap.

    Without ``cells`` the components bring ``loss`` and ``area_km2`` of their own.
    """
    g = shuffled(grid.select("y", "x", "area_km2"))
    if cells is None:
        comp = components.select("date", "component", "y", "x", "area_km2", (F.col("loss") * F.col("area_km2")).alias("lw"))
    else:
        weighed = cells.select("date", "y", "x", (F.col("loss") * F.col("area_km2")).alias("lw"))
        comp = components.select("date", "component", "y", "x").join(g, ["y", "x"]).join(weighed, ["date", "y", "x"], "left")
    ctot = comp.groupBy("date", "component").agg(F.sum("area_km2").alias("comp_area"), F.sum(F.coalesce("lw", F.lit(0.0))).alias("comp_loss"))
    # footprint cells are read once: cells outside every component keep a null component and count for the own area
    p = prints.select("date", "unique_local_event_id", "y", "x").join(g, ["y", "x"]).join(comp.select("date", "y", "x", "component", "lw"), ["date", "y", "x"], "left")
    a = p.groupBy("date", "unique_local_event_id", "component").agg(F.count(F.lit(1)).alias("intersection_cells"), F.sum("area_km2").alias("intersection_area_km2"), F.sum(F.coalesce("lw", F.lit(0.0))).alias("intersection_loss"))
    a = a.withColumn("own_area", F.sum("intersection_area_km2").over(W.partitionBy("date", "unique_local_event_id")))
    return overlaps(a, ctot)


def overlaps(a: DataFrame, ctot: DataFrame) -> DataFrame:
    """IoU, capture fractions and loss-weighted overlap of each (date, local event, component)."""
    r = a.filter("component is not null").join(ctot, ["date", "component"])
    i = F.col("intersection_area_km2")
    return r.select("date", "unique_local_event_id", "component", "intersection_cells", "intersection_area_km2", "intersection_loss",
                    S.ratio(i, F.col("own_area") + F.col("comp_area") - i).alias("iou"), S.ratio(i, "own_area").alias("local_capture"), S.ratio(i, "comp_area").alias("component_capture"),
                    S.ratio("intersection_loss", "comp_loss").alias("loss_weighted_overlap"))


#: Cells along a side of a tile whose 64 cells are the bits of one number.
SIDE = 8


def on_tile() -> list[Column]:
    """Tile of a cell and the cell's bit in it."""
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    place = F.pmod(y, F.lit(SIDE)) * SIDE + F.pmod(x, F.lit(SIDE))
    return [F.floor(y / SIDE).alias("_ty"), F.floor(x / SIDE).alias("_tx"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int")).alias("_bit")]


def footprint_tiles(dates: DataFrame, members: DataFrame, patch_cells: DataFrame, track: str = "cdr") -> DataFrame:
    """Cells of each (event date, local event) as a mask per tile: (date, unique_local_event_id, _ty, _tx, _mask).

    An object's cells become masks first, and its tiles go to their event before they are repeated for
    every window that holds them, so windows and cells are never exchanged.
    """
    before, after = fixed.TRACKS[track]
    # distinct event dates only: bounded by the calendar
    days = dates.select(F.array_sort(F.collect_set("date"))).scalar()
    masks = patch_cells.select("object_id", *on_tile()).groupBy("object_id", "_ty", "_tx").agg(F.bit_or("_bit").alias("_mask"))
    tiles = members.select("unique_local_event_id", "object_id", F.col("date").alias("_d"), F.col("start_date").alias("_s")).join(shuffled(masks), "object_id")
    tiles = tiles.select("unique_local_event_id", "_ty", "_tx", "_mask", "_d", "_s").repartition(shuffle_width(members), "unique_local_event_id", "_ty", "_tx")
    near = tiles.withColumn("date", F.explode(F.sequence(F.date_sub("_d", after), F.date_add("_d", before))))
    held = near.filter((F.col("_s") <= F.date_add("date", after)) & F.array_contains(days, F.col("date")))
    return held.groupBy("date", "unique_local_event_id", "_ty", "_tx").agg(F.bit_or("_mask").alias("_mask"))


def grid_tiles(grid: DataFrame, dates: DataFrame) -> DataFrame:
    """Areas of the grid's cells by tile, for every date: (date, _ty, _tx, _cells of (_bit, area, loss, gain)) without loss and gain."""
    none = F.lit(None).cast("double")
    days = dates.select(F.array_sort(F.collect_set("date"))).scalar()
    cell = F.struct("_bit", F.col("area_km2").cast("double").alias("area"), none.alias("loss"), none.alias("gain"))
    return grid.select("area_km2", *on_tile()).groupBy("_ty", "_tx").agg(F.collect_list(cell).alias("_cells")).withColumn("date", F.explode(days))


def on_cells_of(prints: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells of the tiles that lie in the footprints."""
    met = prints.join(shuffled(tiles), ["date", "_ty", "_tx"])
    return met.select("unique_local_event_id", "_mask", *[c for c in tiles.columns if c not in ("_ty", "_tx", "_cells")], F.inline("_cells")).filter(F.col("_mask").bitwiseAND(F.col("_bit")) != 0)


def tile_sums(prints: DataFrame, cells: DataFrame, grid: DataFrame, dates: DataFrame) -> DataFrame:
    """AGG-26 per (date, local event) from masks: cells, area, loss and gain of the footprint's grid cells."""
    a = F.col("area_km2")
    # a cell of the grid counts and has an area; its loss and gain come from the row of the change
    cell = F.struct("_bit", F.lit(None).cast("double").alias("area"), (F.col("loss") * a).alias("loss"), (F.col("gain") * a).alias("gain"))
    change = cells.select("date", "loss", "gain", "area_km2", *on_tile()).groupBy("date", "_ty", "_tx").agg(F.collect_list(cell).alias("_cells"))
    hit = on_cells_of(prints, grid_tiles(grid, dates).unionByName(change))
    s = hit.groupBy("date", "unique_local_event_id").agg(F.count("area").alias("cells"), F.sum("area").alias("area_km2"), F.sum("loss").alias("loss"), F.sum("gain").alias("gain"))
    return s.filter("cells > 0").fillna(0.0, ["loss", "gain"])


def tile_components(prints: DataFrame, components: DataFrame, grid: DataFrame, dates: DataFrame) -> DataFrame:
    """JOI-22 / AGG-27 from masks: intersection of footprints with components that bring ``loss`` and ``area_km2``."""
    comp = components.select("date", "component", "area_km2", (F.col("loss") * F.col("area_km2")).alias("lw"), *on_tile())
    ctot = comp.groupBy("date", "component").agg(F.sum("area_km2").alias("comp_area"), F.sum(F.coalesce("lw", F.lit(0.0))).alias("comp_loss"))
    cell = F.struct("_bit", F.col("area_km2").cast("double").alias("area"), F.col("lw").alias("loss"), F.lit(None).cast("double").alias("gain"))
    parts = comp.groupBy("date", "component", "_ty", "_tx").agg(F.collect_list(cell).alias("_cells"))
    # the grid is one more component, without a name: its share of a footprint is the footprint's own area
    whole = grid_tiles(grid, dates).withColumn("component", F.lit(None).cast(comp.schema["component"].dataType))
    a = on_cells_of(prints, parts.unionByName(whole)).groupBy("date", "unique_local_event_id", "component").agg(
        F.count(F.lit(1)).alias("intersection_cells"), F.sum("area").alias("intersection_area_km2"), F.sum(F.coalesce("loss", F.lit(0.0))).alias("intersection_loss"))
    own = F.max(F.when(F.col("component").isNull(), F.col("intersection_area_km2")))
    return overlaps(a.withColumn("own_area", own.over(W.partitionBy("date", "unique_local_event_id"))), ctot)


# ---- start-value bins and scenarios ---------------------------------------------------------

BINS = (("lt_0.15", None, 0.15), ("0.15_0.30", 0.15, 0.30), ("ge_0.30", 0.30, None))


def in_bin(start: Column, lo, hi) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (start >= lo)
    return ok & (start < hi) if hi is not None else ok & start.isNotNull()


def bin_fractions(df: DataFrame, keys: Sequence[str], start="start_value", weight="w") -> DataFrame:
    """AGG-28: share of cells and of loss per start-value bin."""
    s, w = F.col(start), F.col(weight)
    aggs = [F.count(s).alias("n_cells"), F.sum(F.when(s.isNotNull(), w).otherwise(0.0)).alias("total_loss")]
    for name, lo, hi in BINS:
        aggs += [F.count_if(in_bin(s, lo, hi)).alias(f"_n_{name}"), F.sum(F.when(in_bin(s, lo, hi), w).otherwise(0.0)).alias(f"loss_{name}")]
    a = df.groupBy(*keys).agg(*aggs)
    for name, *_ in BINS:
        a = a.withColumn(f"cell_fraction_{name}", S.ratio(F.col(f"`_n_{name}`"), "n_cells")).withColumn(f"loss_fraction_{name}", S.ratio(F.col(f"`loss_{name}`"), "total_loss")).drop(f"_n_{name}")
    return a


def start_state(patch_cells: DataFrame, field: DataFrame, grid: DataFrame) -> DataFrame:
    """JOI-26: start value and weighted loss of every patch cell, each at its own patch's start date."""
    f = field.select(F.col("date").alias("start_date"), "y", "x", F.col("value").alias("start_value"))
    p = patch_cells.join(shuffled(f), ["start_date", "y", "x"], "left").join(shuffled(grid.select("y", "x", "area_km2")), ["y", "x"])
    return p.withColumn("w", F.greatest(-F.col("delta"), F.lit(0.0)) * F.col("area_km2"))


def start_diagnostics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-29: five quantiles, weighted mean and bins of the start value per event.

    Everything follows from how often a start value occurs in an event and the loss at it, so cells are exchanged once.
    """
    keys = list(keys)
    per = durable(cells.groupBy(*keys, "start_value").agg(F.count(F.lit(1)).alias("_n"), F.sum("w").alias("w")))
    q = ordered.quantiles(per, keys, "start_value", {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}, "_n").drop("n_values")
    s, w, n = F.col("start_value"), F.col("w"), F.col("_n")
    aggs = [F.sum(n).alias("observations"), F.sum(w).alias("_t"), F.sum(s * w).alias("_s"), F.coalesce(F.sum(F.when(s.isNotNull(), n)), F.lit(0)).alias("_seen"), F.sum(F.when(s.isNotNull(), w).otherwise(0.0)).alias("total_loss")]
    for name, lo, hi in BINS:
        aggs += [F.sum(F.when(in_bin(s, lo, hi), n).otherwise(0)).alias(f"_n_{name}"), F.sum(F.when(in_bin(s, lo, hi), w).otherwise(0.0)).alias(f"loss_{name}")]
    m = per.groupBy(*keys).agg(*aggs)
    for name, *_ in BINS:
        m = m.withColumn(f"cell_fraction_{name}", S.ratio(F.col(f"`_n_{name}`"), "_seen")).withColumn(f"loss_fraction_{name}", S.ratio(F.col(f"`loss_{name}`"), "total_loss")).drop(f"_n_{name}")
    return m.withColumn("weighted_mean_start", S.ratio("_s", "_t")).drop("_t", "_s", "_seen").join(q, keys, "left")


def start_summary(event_level: DataFrame, regions: Sequence[int], level="level") -> DataFrame:
    """AGG-29: by nested level and region, every region present (level 3 counts in all three)."""
    losses = [f"loss_{n}" for n, *_ in BINS]
    nested = event_level.withColumn("tier", F.explode(F.sequence(F.lit(1), F.col(level))))
    a = nested.groupBy("tier", "region_code").agg(F.count(F.lit(1)).alias("event_count"), F.sum("total_loss").alias("total_loss"), *[F.sum(F.col(f"`{c}`")).alias(c) for c in losses])
    want = event_level.sparkSession.createDataFrame([(t, r) for t in (1, 2, 3) for r in regions], "tier int, region_code int")
    out = want.join(a, ["tier", "region_code"], "left").fillna(0, ["event_count"]).fillna(0.0, ["total_loss"])
    for c in losses:
        out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).withColumn(c.replace("loss_", "fraction_"), S.ratio(F.col(f"`{c}`"), "total_loss"))
    return out


def floor_components(field: DataFrame, grid: DataFrame, days: int, threshold: float, floors: Sequence[float | None], sizes: Sequence[int], dates: DataFrame | None = None) -> DataFrame:
    """RAS-18 / RAS-19: components per (date, scenario) under every start floor, and metrics for every minimum size.

    A floor is one more key of the same labelling; sizes never change a label, so they are
    filters on the component table.  Dates without components keep a row.
    """
    from ..sources.catalog import with_floors
    d = with_floors(change_cells(field, grid, days, dates), "start_value", floors).withColumn("w", F.col("loss") * F.col("area_km2"))
    keys = ["date", "scenario"]
    w = d
    cells = RA.label(RA.closed_mask(d.filter(F.col("delta") <= threshold), d, keys, grid=grid, carry=["w"]), keys, carry=["w"])
    comp = cells.groupBy("date", "scenario", "component").agg(F.count(F.lit(1)).alias("cell_count"), F.sum("w").alias("loss"))
    fits = F.explode(F.array_compact(F.array(*[F.when(F.col("cell_count") > n, F.lit(n)) for n in sizes])))
    each = comp.withColumn("min_cells", fits)
    m = composition(each, ["date", "scenario", "min_cells"], "loss").withColumnRenamed("total", "resolved_loss")
    elig = w.groupBy("date", "scenario").agg(F.sum("w").alias("eligible_loss"))
    base = elig.withColumn("min_cells", F.explode(F.array(*[F.lit(n) for n in sizes])))
    out = base.join(m, ["date", "scenario", "min_cells"], "left").fillna(0, ["n_parts"]).fillna(0.0, ["resolved_loss"])
    return out.withColumn("resolved_fraction", S.ratio("resolved_loss", "eligible_loss"))


def scenario_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], unit: str, primary: dict) -> DataFrame:
    """AGG-30: seven quantiles per scenario and metric, rank correlation of the first metric with the primary scenario, change of the median."""
    keys = list(keys)
    flat = rows.select(*keys, unit, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    flat = durable(flat)  # one row per scenario, unit and metric; read three times below, each time anew from the field otherwise
    probs = {"min": 0.0, "p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "max": 1.0}
    q = ordered.quantiles(flat, [*keys, "metric"], "v", probs)
    is_primary = F.lit(True)
    for k, v in primary.items():
        is_primary = is_primary & (F.col(k) == v)
    base = q.filter(is_primary).select("metric", F.col("median").alias("_base"))
    q = q.join(base, "metric", "left").withColumn("median_change", F.col("median") - F.col("_base")).withColumn("median_relative_change", F.try_divide(F.col("median") - F.col("_base"), F.when(F.col("_base") != 0, F.col("_base")))).drop("_base")
    ref = flat.filter(is_primary & (F.col("metric") == metrics[0])).select(unit, F.col("v").alias("_p"))
    pair = flat.filter(F.col("metric") == metrics[0]).join(ref, unit).filter("v is not null and _p is not null")
    rho = spearman(pair, keys, "v", "_p", "rank_correlation")
    return q.join(rho, keys, "left")


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "rho") -> DataFrame:
    """STA-12: correlation of average ranks per group, over rows where both values are present."""
    keys = list(keys)
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = ordered.average_rank_pct(ordered.average_rank_pct(both, keys, a, "_ra"), keys, b, "_rb")
    return (r.groupBy(*keys) if keys else r).agg(F.when(F.count(F.lit(1)) >= 2, F.corr("_ra", "_rb")).alias(out))


def concordance(pairs: DataFrame, a: str = "reported", b: str = "rebuilt", year: str = "year", split_year: int = 2025) -> DataFrame:
    """AGG-31: coverage, relative differences, sign agreement, rank correlation and bias, with the years before and at the split."""
    p = pairs.withColumn("_ok", F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != 0))
    rel = F.when(F.col("_ok"), F.abs(F.col(b) - F.col(a)) / F.abs(F.col(a)))
    p = p.withColumn("_rel", rel).withColumn("_sign", F.when(F.col("_ok"), (F.signum(a) == F.signum(b)).cast("int")))
    head = p.agg(F.count(F.lit(1)).alias("event_total"), F.count_if("_ok").alias("event_evaluable"), F.avg("_sign").alias("sign_agreement"), F.avg(F.when(F.col("_ok"), F.col(b) - F.col(a))).alias("signed_bias"),
                 F.count_if(F.col("_ok") & (F.col(year) < split_year)).alias("before_n"), F.count_if(F.col("_ok") & (F.col(year) == split_year)).alias("split_n"))
    q = ordered.quantiles(p, [], "_rel", {"median_rel": 0.5, "p90_rel": 0.9})
    ok = p.filter("_ok")
    part = ok.withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col(year) < split_year, F.lit("before")).when(F.col(year) == split_year, F.lit("split"))))))
    rho = spearman(part, ["part"], a, b).agg(*[F.max(F.when(F.col("part") == k, F.col("rho"))).alias(f"rho_{k}") for k in ("all", "before", "split")])
    out = head.withColumn("_q", q.select(F.struct("median_rel", "p90_rel")).scalar()).withColumn("_r", rho.select(F.struct("*")).scalar())
    return out.select(*head.columns, S.ratio("event_evaluable", "event_total").alias("coverage"), "_q.median_rel", "_q.p90_rel", "_r.rho_all", "_r.rho_before", "_r.rho_split")


# Fixed values: (pass, stop) limits of coverage, median and p90 relative difference, sign agreement, rank correlation.
GATE_LIMITS = {"coverage": (0.95, 0.95), "median_rel": (0.15, 0.20), "p90_rel": (0.30, 0.40), "sign_agreement": (0.95, 0.90), "rho_all": (0.90, 0.80)}


def closure_gate(df: DataFrame, area_ok: Column | bool = True, other_coverage: Column | float = 1.0, unavailable: Column | bool = False) -> DataFrame:
    """EVI-08: PASS, WARN, STOP or unavailable from the agreement of two sources, the reasons to stop, and the route that follows."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    smaller_is_better = ("median_rel", "p90_rel")
    ok, reasons = F.lit(True), []
    for c, (good, stop) in GATE_LIMITS.items():
        v = F.col(c)
        ok = ok & F.coalesce(v <= good if c in smaller_is_better else v >= good, F.lit(False))
        bad = v > stop if c in smaller_is_better else v < stop
        reasons.append(F.when(bad, F.lit(c)))
    why = F.array_compact(F.array(*reasons))
    gate = S.ladder([(as_col(unavailable), "unavailable"), (ok, "PASS"), (F.size(why) > 0, "STOP")], "WARN")
    out = df.withColumn("gate", gate).withColumn("stop_reasons", F.concat_ws(";", why))
    route = S.ladder([(F.col("gate") == "PASS", "exact_detector_attribution"),
                      ((F.col("gate") == "unavailable") & as_col(area_ok) & (as_col(other_coverage) >= 0.95), "cdr_based_spatial_decomposition")], "detector_source_diagnose_first")
    return out.withColumn("route", route)


def nearest_to_median(df: DataFrame, columns: Sequence[str], id_col: str, date: str) -> DataFrame:
    """AGG-40: the row with the smallest IQR-scaled distance to the medians; ties by date, then id."""
    out = df
    for c in columns:
        q = ordered.quantiles(df, [], c, {"m": 0.5, "a": 0.25, "b": 0.75}).select(F.struct("m", F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0).alias("s"))).scalar()
        out = out.withColumn(f"_q_{c}", q)
    d = sum((F.pow((F.col(c) - F.col(f"_q_{c}")["m"]) / F.col(f"_q_{c}")["s"], 2) for c in columns[1:]), F.pow((F.col(columns[0]) - F.col(f"_q_{columns[0]}")["m"]) / F.col(f"_q_{columns[0]}")["s"], 2))
    return out.withColumn("distance", F.sqrt(d)).agg(F.min_by(F.struct(id_col, date, "distance"), F.struct(F.round("distance", 9), F.col(date), F.col(id_col))).alias("r")).select("r.*")


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """AGG-43: share of values at or below each distinct value, from distributed ranks."""
    t = ordered.value_ranks(df, keys, value)
    return t.select(*keys, value, ((F.col("n_before") + F.col("n_equal")) / F.col("n_total")).alias("cume_dist"))
