"""Raster operators on cell tables: differences, stencils, labelling, patches, geometry.

A raster is a long table (frame keys, y, x, value).  Stencils cut the plane into
tiles with a one-sided halo, so one exchange serves any neighbourhood and no task
ever holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, geometry as G, scalar as S
from ..session import durable, shuffle_width, shuffled
from . import graph, ordered

TILE = 128
SPREAD = 8


# ---- differences ----------------------------------------------------------

def window_difference(field: DataFrame, days: int, dates: DataFrame | None = None, value="value", out="delta") -> DataFrame:
    """RAS-01: end minus start over ``days``, only where both are present; ``date`` is the end.

    The start is read by an exact-offset range frame over the calendar of one cell, so
    the field is exchanged once.  With ``dates`` only the frames that are needed are read.
    """
    src = field
    if dates is not None:
        need = dates.select("date").unionByName(dates.select(F.date_sub("date", days).alias("date"))).distinct()
        src = field.join(need, "date", "left_semi")
    w = W.partitionBy("y", "x").orderBy(S.day_number("date")).rangeBetween(-days, -days)
    out_df = src.withColumn("start_value", F.first(value).over(w)).withColumn(out, F.col(value) - F.col("start_value"))
    out_df = out_df.filter(F.col(out).isNotNull())
    return out_df.join(dates.select("date").distinct(), "date", "left_semi") if dates is not None else out_df


# ---- stencils ---------------------------------------------------------------

def with_halo(df: DataFrame, keys: Sequence[str], reach: int, y="y", x="x", tile: int = TILE) -> DataFrame:
    """Copy each cell to every tile it can influence within ``reach``; ``_core`` marks the owner's copy.

    Tiles are many and small, and every window over them sorts what its task holds, so they are dealt over ``SPREAD`` times the usual tasks.
    """
    def tiles(c):
        at = F.col(c)
        lo, hi = F.floor((at - reach) / tile), F.floor((at + reach) / tile)
        return F.sequence(lo, hi)

    spread = df.withColumn("_ty", F.explode(tiles(y))).withColumn("_tx", F.explode(tiles(x)))
    core = (F.floor(F.col(y) / tile) == F.col("_ty")) & (F.floor(F.col(x) / tile) == F.col("_tx"))
    return spread.withColumn("_core", core).repartition(SPREAD * shuffle_width(df), *keys, "_ty", "_tx")


def _row(keys, y, x, lo, hi):
    return W.partitionBy(*keys, "_ty", "_tx", y).orderBy(x).rangeBetween(lo, hi)


def _column(keys, y, x, lo, hi):
    return W.partitionBy(*keys, "_ty", "_tx", x).orderBy(y).rangeBetween(lo, hi)


def _filled(df: DataFrame, keys, reach: int, y, x, value: str) -> DataFrame:
    """Halo tiles with one row for every cell that has a neighbour, so empty cells can receive counts."""
    step = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    spots = F.flatten(F.transform(step, lambda a: F.transform(step, lambda b: F.struct(
        (F.col(y) + a).alias(y), (F.col(x) + b).alias(x), ((a == 0) & (b == 0)).alias("_self")))))
    return df.select(*keys, F.inline(spots)).groupBy(*keys, y, x).agg(F.count_if(~F.col("_self")).alias("n_near"), F.bool_or("_self").alias(value))


def neighbour_count(mask: DataFrame, keys: Sequence[str], ny: int, nx: int, y="y", x="x") -> DataFrame:
    """RAS-05: how many of the 8 neighbours are set, for every cell with at least one; the grid border is forced to 0."""
    n = _filled(mask.select(*keys, y, x), keys, 1, y, x, "is_set")
    inner = F.col(y).between(1, ny - 2) & F.col(x).between(1, nx - 2)
    return n.filter(F.col(y).between(0, ny - 1) & F.col(x).between(0, nx - 1)).select(*keys, y, x, F.when(inner, F.col("n_near")).otherwise(0).alias("n_near"), "is_set")


def expand_mask(mask: DataFrame, keys: Sequence[str], steps: int, ny: int, nx: int, y="y", x="x") -> DataFrame:
    """RAS-05: grow a cell set by 8-neighbour steps (border cells are never added)."""
    out = mask.select(*keys, y, x)
    for _ in range(max(int(steps), 0)):
        out = neighbour_count(out, keys, ny, nx, y, x).filter("is_set or n_near > 0").select(*keys, y, x)
    return out


#: Columns of a row in one word; the word also holds two columns on either side, as far as a closing reaches.
WORD = 56


def _packed(mask: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """(keys, y, ``_w``, ``_m``): the set cells of each word, bit 2 being its first column."""
    at = F.floor(F.col(x) / WORD)
    near = F.array_distinct(F.array(F.floor((F.col(x) - 2) / WORD), at, F.floor((F.col(x) + 2) / WORD)))
    bit = F.expr(f"shiftleft(1L, cast({x} - _w * {WORD} + 2 as int))")
    return mask.select(*keys, y, x, F.explode(near).alias("_w")).groupBy(*keys, y, "_w").agg(F.bit_or(bit).alias("_m"))


def _ones(n: Column) -> Column:
    """Word whose ``n`` lowest bits are set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - F.lit(1).cast("long")


def _to_rows_beside(words: DataFrame, y: str) -> DataFrame:
    """Every word in its own row and in the rows above and below."""
    return words.withColumn(y, F.explode(F.array(F.col(y) - 1, F.col(y), F.col(y) + 1)))


def closed_mask(mask: DataFrame, valid: DataFrame, keys: Sequence[str], y="y", x="x", grid: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """RAS-02: 3 x 3 closing of a cell set; outside the grid counts as unset, so the border erodes.

    ``valid`` holds the cells that may stay (finite and inside the domain) with the frame
    keys; ``carry`` names its columns to return.  The static ``grid`` gives the bounds
    without another pass over the field.

    Cells travel as words of ``WORD`` columns of a row, so both passes shuffle rows of words and not nine copies of every cell.
    """
    keys = list(keys)
    bounds = (valid if grid is None else grid).select(F.max(y).alias("my"), F.max(x).alias("mx")).select(F.struct("my", "mx")).scalar()
    first = (F.col("_w") * WORD - 2).cast("int")  # column of the lowest bit
    low = F.greatest(F.lit(0), F.least(F.lit(WORD + 4), -first))
    high = F.greatest(F.lit(0), F.least(F.lit(WORD + 4), F.col("_b.mx") - first + 1))
    inside = _ones(high).bitwiseAND(F.bitwise_not(_ones(low)))
    up, down = lambda v: F.shiftleft(v, 1), lambda v: F.shiftright(v, 1)
    bits = _packed(mask.select(*keys, y, x), keys, y, x)
    wide = bits.select(*keys, y, "_w", F.col("_m").bitwiseOR(up(F.col("_m"))).bitwiseOR(down(F.col("_m"))).alias("_m"))
    grown = _to_rows_beside(wide, y).groupBy(*keys, y, "_w").agg(F.bit_or("_m").alias("_m")).withColumn("_b", bounds)
    grown = grown.filter((F.col(y) >= 0) & (F.col(y) <= F.col("_b.my"))).withColumn("_m", F.col("_m").bitwiseAND(inside)).drop("_b")
    thin = grown.select(*keys, y, "_w", F.col("_m").bitwiseAND(up(F.col("_m"))).bitwiseAND(down(F.col("_m"))).alias("_m")).filter("_m <> 0")
    kept = _to_rows_beside(thin, y).groupBy(*keys, y, "_w").agg(F.bit_and("_m").alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n = 3")
    spots = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("_m", (i + 2).cast("int")) == 1)
    shrunk = kept.select(*keys, y, "_w", F.explode(spots).alias("_i")).select(*keys, y, (F.col("_w") * WORD + F.col("_i")).cast(mask.schema[x].dataType).alias(x))
    return shuffled(shrunk).join(valid.select(*keys, y, x, *carry), [*keys, y, x])


def strict_minima(df: DataFrame, keys: Sequence[str], value: str, y="y", x="x") -> DataFrame:
    """RAS-06: cells lower than all 8 neighbours; a missing neighbour inside the grid blocks, border cells never qualify.

    Separable: the lowest of three along a row, then along a column, in halo tiles.
    """
    t = with_halo(df.filter(F.col(value).isNotNull()), keys, 1, y, x)
    r = t.withColumn("_m3", F.min(value).over(_row(keys, y, x, -1, 1))).withColumn("_c3", F.count(value).over(_row(keys, y, x, -1, 1)))
    r = r.withColumn("_side", F.least(F.min(value).over(_row(keys, y, x, -1, -1)), F.min(value).over(_row(keys, y, x, 1, 1))))
    up, down = _column(keys, y, x, -1, -1), _column(keys, y, x, 1, 1)
    r = r.withColumn("_low", F.least("_side", F.min("_m3").over(up), F.min("_m3").over(down)))
    r = r.withColumn("_n", F.col("_c3") + F.sum("_c3").over(up) + F.sum("_c3").over(down))
    return r.filter(F.col("_core") & (F.col("_n") == 9) & (F.col(value) < F.col("_low"))).select(df.columns)


def ring_mean(centres: DataFrame, field: DataFrame, keys: Sequence[str], value: str, radius: int, y="y", x="x", out="ring_mean") -> DataFrame:
    """RAS-07: mean of the present field values at the 8 offsets of a square ring around each centre.

    Only the centres are fanned out, so the field itself is exchanged once.
    """
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-radius, 0, radius) for b in (-radius, 0, radius) if (a, b) != (0, 0)])
    fan = centres.select(*keys, F.col(y).alias("_y0"), F.col(x).alias("_x0"), F.explode(offs).alias("_o"))
    fan = fan.select(*keys, "_y0", "_x0", (F.col("_y0") + F.col("_o.a")).alias(y), (F.col("_x0") + F.col("_o.b")).alias(x))
    m = fan.join(field.select(*keys, y, x, F.col(value).alias("_v")), [*keys, y, x]).groupBy(*keys, F.col("_y0").alias(y), F.col("_x0").alias(x)).agg(F.avg("_v").alias(out))
    return centres.join(m, [*keys, y, x], "left")


def gradient(df: DataFrame, keys: Sequence[str], value: str, y="y", x="x", ycoord="y_m", xcoord="x_m") -> DataFrame:
    """RAS-09: d/dy and d/dx by second-order differences for uneven spacing, one-sided where a side has no cell.

    A cell with a null value still takes part as a neighbour and makes the slope null.
    """
    t = with_halo(df, keys, 1, y, x)

    def slope(win, coord):
        rec = F.struct(F.col(value).alias("v"), F.col(coord).alias("c"))
        a, b = F.first(rec).over(win(-1, -1)), F.first(rec).over(win(1, 1))
        v, c = F.col(value), F.col(coord)
        hs, hd = c - a["c"], b["c"] - c
        both = (hs * hs * b["v"] + (hd * hd - hs * hs) * v - hd * hd * a["v"]) / (hs * hd * (hs + hd))
        return F.when(a.isNotNull() & b.isNotNull(), both).when(b.isNotNull(), (b["v"] - v) / hd).when(a.isNotNull(), (v - a["v"]) / hs)

    gy = slope(lambda lo, hi: _column(keys, y, x, lo, hi), ycoord)
    gx = slope(lambda lo, hi: _row(keys, y, x, lo, hi), xcoord)
    return t.withColumn("grad_y", gy).withColumn("grad_x", gx).filter("_core").select(*df.columns, "grad_y", "grad_x")


# ---- labelling --------------------------------------------------------------

def _label_tile(ys: np.ndarray, xs: np.ndarray, offsets) -> np.ndarray:
    """Smallest cell index of each component among the cells of one tile (cells sorted by y, x)."""
    y0, x0 = ys.min() - 1, xs.min() - 1
    at = np.full((ys.max() - y0 + 2, xs.max() - x0 + 2), -1, dtype=np.int64)
    at[ys - y0, xs - x0] = np.arange(ys.size)
    links = []
    for dy, dx in offsets:
        other = at[ys - y0 + dy, xs - x0 + dx]
        here = np.flatnonzero(other >= 0)
        links.append(np.stack([here, other[here]]))
    a, b = np.concatenate(links, axis=1)
    root = np.arange(ys.size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def label(mask: DataFrame, keys: Sequence[str], connectivity: int = 8, y="y", x="x", tile: int = TILE, carry: Sequence[str] = ()) -> DataFrame:
    """RAS-03 / RAS-04: add ``component``, the raster position (y * 2^32 + x) of the component's first cell.

    Tiles are labelled on their own in grouped-map tasks of bounded size; only tile-border
    cells then enter a distributed component search that joins labels across tiles.
    ``carry`` names columns that ride along, so the field is not joined again.
    """
    keys, carry = list(keys), list(carry)
    ahead = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, -1), (1, 0), (1, 1)]
    types = {f.name: f.dataType.simpleString() for f in mask.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([y, x], kind="stable")
        ys, xs = pdf[y].to_numpy(np.int64), pdf[x].to_numpy(np.int64)
        first = _label_tile(ys, xs, ahead)
        out = pdf[[*keys, y, x, *carry]].copy()
        out["_part"] = (ys * (1 << 32) + xs)[first]
        return out

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{c} {types[c]}" for c in (y, x, *carry)], "_part bigint"])
    at = mask.select(*keys, y, x, *carry).withColumn("_ty", F.floor(F.col(y) / tile)).withColumn("_tx", F.floor(F.col(x) / tile))
    parts = durable(at.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema))
    inner = F.lit(tile - 1)
    my, mx = F.pmod(F.col(y), F.lit(tile)), F.pmod(F.col(x), F.lit(tile))
    edge = parts.filter((my == 0) | (my == inner) | (mx == 0) | (mx == inner))
    step = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ahead])
    hop = edge.select(*keys, F.col(y).alias("_ay"), F.col(x).alias("_ax"), F.col("_part").alias("_a"), F.explode(step).alias("_s"))
    hop = hop.select(*keys, (F.col("_ay") + F.col("_s.dy")).alias(y), (F.col("_ax") + F.col("_s.dx")).alias(x), "_a")
    links = hop.join(edge.withColumnRenamed("_part", "_b"), [*keys, y, x]).filter("_a <> _b").select(*keys, "_a", "_b").distinct()
    roots = graph.components(links, "_a", "_b", keys).withColumnRenamed("node", "_part")
    joined = parts.join(roots, [*keys, "_part"], "left")
    return joined.withColumn("component", F.coalesce("root", "_part")).drop("root", "_part")


def raster_numbers(cells: DataFrame, keys: Sequence[str], min_cells: int = 1, strict: bool = False) -> DataFrame:
    """Components of sufficient size with raster-order numbers from 1: (keys, component, cell_count, label_id).

    Numbers are given before the size filter, so a size never changes a label.
    """
    sizes = cells.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("cell_count"))
    numbered = ordered.row_numbers(sizes, keys, ["component"], "label_id").drop("n_total")
    keep = F.col("cell_count") > min_cells if strict else F.col("cell_count") >= min_cells
    return numbered.filter(keep)


# ---- geometry of an object ----------------------------------------------------

def circular_gaps(cells: DataFrame, keys: Sequence[str], lon: str = "lon", bins: int = 720) -> DataFrame:
    """WIN-12: class, raw span, covering arc, largest gap, arc start and tie count of the longitudes of an object.

    Distinct longitudes are ordered inside narrow longitude bins; only the bin bounds
    (at most ``bins`` per object) are ordered across bins.
    """
    keys = list(keys)
    spans = cells.filter(F.col(lon).isNotNull()).groupBy(*keys).agg((F.max(lon) - F.min(lon)).alias("raw_span_deg"))
    v = cells.filter(F.col(lon).isNotNull()).select(*keys, F.pmod(F.col(lon), F.lit(360.0)).alias("v")).distinct().withColumn("_bin", F.floor(F.col("v") * bins / 360))
    in_bin = W.partitionBy(*keys, "_bin").orderBy("v")
    v = v.withColumn("_next", F.lead("v").over(in_bin))
    low = v.groupBy(*keys, "_bin").agg(F.min("v").alias("_lo"))
    across = W.partitionBy(*keys).orderBy("_bin")
    low = low.withColumn("_after", F.lead("_lo").over(across)).withColumn("_first", F.min("_lo").over(W.partitionBy(*keys)))
    g = v.join(low, [*keys, "_bin"])
    nxt = F.coalesce("_next", "_after", F.col("_first") + 360.0)
    g = g.withColumn("_nx", nxt).withColumn("gap", F.col("_nx") - F.col("v")).select(*keys, "gap", "_nx")
    top = g.groupBy(*keys).agg(F.max("gap").alias("largest_gap_deg"))
    tied = g.join(top, keys).filter(F.col("gap") >= F.col("largest_gap_deg") - 1e-12)
    starts = tied.groupBy(*keys).agg(F.max("largest_gap_deg").alias("largest_gap_deg"), F.min(F.pmod(F.col("_nx"), F.lit(360.0))).alias("arc_start_deg"), F.count(F.lit(1)).cast("int").alias("tie_count"))
    arc = 360.0 - F.col("largest_gap_deg")
    kind = F.when(arc > 180.0, "LONGITUDE_DISTRIBUTED").when(F.col("raw_span_deg") > 180.0, "WRAP_ONLY").otherwise("ORDINARY")
    return starts.join(spans, keys).withColumn("covering_arc_deg", arc).withColumn("geometry_class", kind)


def weighted_centroid(cells: DataFrame, keys: Sequence[str], weight: str, lon="lon", lat="lat", x_m: str | None = "x_m", y_m: str | None = "y_m",
                      distributed: str = "project", geometry: DataFrame | None = None) -> DataFrame:
    """SCA-05 / SCA-04: weighted centroid by longitude class.

    Ordinary objects use the plain weighted mean, wrapped ones the mean on the unwrapped
    branch, distributed ones the projected barycentre (patch) or an error (event).
    Weights fall back to 1 when none is positive.
    """
    keys = list(keys)
    geo = geometry if geometry is not None else circular_gaps(cells, keys, lon)
    c = cells.join(geo, keys).withColumn("_w", F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0))
    c = c.withColumn("_u", S.unwrapped_longitude(lon, "arc_start_deg"))
    used = [lon, lat, "_u"] + ([x_m, y_m] if x_m else [])
    aggs = [F.sum("_w").alias("_sw")]
    for u in used:
        aggs += [F.sum(F.col("_w") * F.col(u)).alias(f"_s_{u}"), F.avg(u).alias(f"_m_{u}")]
    a = c.groupBy(*keys).agg(*aggs)
    mean = {u: F.when(F.col("_sw") > 0, F.col(f"_s_{u}") / F.col("_sw")).otherwise(F.col(f"_m_{u}")) for u in used}
    a = a.join(geo, keys)
    if distributed == "project":
        plon, plat = G.stereographic_inverse(mean[x_m], mean[y_m])
    else:
        plon = plat = F.raise_error(F.lit("an event whose longitudes spread over more than half the globe needs a method decision")).cast("double")
    kind = F.col("geometry_class")
    out_lon = F.when(kind == "LONGITUDE_DISTRIBUTED", plon).when(kind == "WRAP_ONLY", S.lon180(mean["_u"])).otherwise(mean[lon])
    out_lat = F.when(kind == "LONGITUDE_DISTRIBUTED", plat).otherwise(mean[lat])
    return a.select(*keys, out_lon.alias("centroid_lon"), out_lat.alias("centroid_lat"), "geometry_class", "raw_span_deg", "covering_arc_deg", "largest_gap_deg", "arc_start_deg", "tie_count")


def component_stats(cells: DataFrame, keys: Sequence[str], delta="delta", lon="lon", lat="lat") -> DataFrame:
    """AGG-04: size, mean, minimum, loss, plain loss-weighted centroid and place of the deepest cell (first in raster order on ties)."""
    loss = F.greatest(-F.col(delta), F.lit(0.0))
    deepest = F.min_by(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")), F.struct(delta, "y", "x"))
    a = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_count"), F.avg(delta).alias("mean_change"), F.min(delta).alias("min_change"), F.sum(loss).alias("loss"),
        F.sum(loss * F.col(lon)).alias("_wlon"), F.sum(loss * F.col(lat)).alias("_wlat"), F.avg(lon).alias("_mlon"), F.avg(lat).alias("_mlat"), deepest.alias("_deep"))
    pick = lambda w, m: F.when(F.col("loss") > 0, F.col(w) / F.col("loss")).otherwise(F.col(m))
    return a.select(*keys, "cell_count", "mean_change", "min_change", "loss", pick("_wlon", "_mlon").alias("center_lon"), pick("_wlat", "_mlat").alias("center_lat"),
                    F.col("_deep.lon").alias("max_loss_lon"), F.col("_deep.lat").alias("max_loss_lat"))


def region_of_object(cells: DataFrame, keys: Sequence[str], delta="delta", code="region_code", codes=range(1, 19)) -> DataFrame:
    """AGG-05: region with most loss, then most cells, then lowest position; fractions and the ordered list of regions touched."""
    loss = F.greatest(-F.col(delta), F.lit(0.0))
    per = cells.groupBy(*keys, code).agg(F.sum(loss).alias("_w"), F.count(F.lit(1)).alias("_n"))
    named = F.col(code).isin(*list(codes))
    return per.groupBy(*keys).agg(
        F.max_by(F.when(named, F.col(code)), F.when(named, F.struct("_w", "_n", -F.col(code)))).alias("region_code"),
        F.max(F.when(named, F.struct("_w", "_n", -F.col(code)))).alias("_best"),
        F.sum("_w").alias("_tw"), F.sum("_n").alias("_tn"),
        F.array_sort(F.collect_set(F.when(named, F.col(code)))).alias("_codes"),
    ).select(*keys, "region_code", S.ratio("_best._w", "_tw").alias("weight_fraction"), S.ratio("_best._n", "_tn").alias("cell_fraction"),
             F.concat_ws(";", F.transform("_codes", lambda v: v.cast("string"))).alias("memberships"))


def region_of_point(points: DataFrame, boxes: Sequence[tuple], lon="lon", lat="lat", out="region") -> DataFrame:
    """AGG-06: first region, in the given order, whose box holds the point; empty text when none does."""
    return points.withColumn(out, S.ladder([(S.in_box(lon, lat, *b), n) for n, *b in boxes], ""))


def detect_patches(delta: DataFrame, grid: DataFrame, threshold: float, min_cells: int, keys: Sequence[str] = ("date",), closing: bool = False,
                   connectivity: int = 8, strict_size: bool = False, strict_threshold: bool = False, value="delta") -> DataFrame:
    """Cells of every patch: mask, optional closing, labels, size filter; one row per patch cell with grid attributes.

    Footprints are therefore an output of detection and never have to be rebuilt.
    """
    keys = list(keys)
    hit = F.col(value) < threshold if strict_threshold else F.col(value) <= threshold
    mask = delta.filter(hit).select(*keys, "y", "x", value)
    if closing:
        mask = closed_mask(mask, delta, keys, grid=grid, carry=[value])
    cells = label(mask, keys, connectivity, carry=[value])
    return cells.join(raster_numbers(cells, keys, min_cells, strict_size), [*keys, "component"]).join(shuffled(grid), ["y", "x"])


# ---- medoid, perimeter -----------------------------------------------------------

def region_medoid(grid: DataFrame, code="region_code", codes: Sequence[int] | None = None) -> DataFrame:
    """TOP-05: the cell closest to the mean equal-area position of its region, first in raster order on ties."""
    g = grid if codes is None else grid.filter(F.col(code).isin(*codes))
    ex, ey = G.equal_area_forward("lon", "lat")
    g = g.withColumn("ex", ex).withColumn("ey", ey)
    centre = g.groupBy(code).agg(F.avg("ex").alias("_cx"), F.avg("ey").alias("_cy"), F.count(F.lit(1)).alias("cells"))
    d2 = F.pow(F.col("ex") - F.col("_cx"), 2) + F.pow(F.col("ey") - F.col("_cy"), 2)
    best = g.join(centre, code).groupBy(code).agg(F.min_by(F.struct("y", "x", "lon", "lat", "ex", "ey"), F.struct(F.round(d2 / 1e6, 3), F.col("y"), F.col("x"))).alias("m"), F.max("cells").alias("cells"))
    return best.select(code, "m.*", "cells")


def perimeter_edges(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RAS-15: cell sides that face a cell outside the set: (keys, y, x, side).  Each side joins one neighbour by equality."""
    keys = list(keys)
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for n, a, b in (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))])
    e = cells.select(*keys, "y", "x", F.inline(sides)).withColumn("_ny", F.col("y") + F.col("dy")).withColumn("_nx", F.col("x") + F.col("dx"))
    other = cells.select(*keys, F.col("y").alias("_ny"), F.col("x").alias("_nx"))
    return e.join(other, [*keys, "_ny", "_nx"], "left_anti").select(*keys, "y", "x", "side")
