"""Order-dependent linking: patches to events, events to clusters, centres to tracks.

Patches and centres follow one another, so their links are a matching made first come, first
served (``matching``); patches are linked so on request.  Otherwise, and for clusters, which move with all
their members, the rule is sequential: Spark cuts the rows into units that cannot influence each other,
sorts every unit and streams it through the rule; a task holds only the live objects, never a whole unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions import scalar as S
from ..session import durable
from . import graph, joins as J, matching as M, ordered, raster as RA


def time_islands(df: DataFrame, gap_days: int, keys: Sequence[str], date: str, out: str = "island") -> DataFrame:
    """Number the runs of days that are at most ``gap_days`` apart (per key; distinct days are bounded by the calendar)."""
    keys = list(keys)
    days = df.select(*keys, date).distinct()
    o = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(date)
    fresh = F.coalesce((F.datediff(F.col(date), F.lag(date).over(o)) > gap_days).cast("int"), F.lit(0))
    marked = days.withColumn("_f", fresh).withColumn(out, F.sum("_f").over(o)).drop("_f")
    return df.join(marked, [*keys, date])


def proximity_units(df: DataFrame, keys: Sequence[str], date: str, lon: str, lat: str, days: int, km: float, out: str = "unit") -> DataFrame:
    """Cut rows into units such that rows of different units are never within ``days`` and ``km`` of each other.

    Works on occupied space-time cells, not on pairs of rows: neighbouring occupied cells
    are linked and the components are the units.  A unit may be coarser than necessary
    (also when two cell hashes meet), which changes no result.
    """
    keys = list(keys)
    width = max(int(days), 1)
    slot = F.floor(S.day_number(date) / width).cast("int")
    parts = J.cube(lon, lat, km)
    node = lambda t, c: F.xxhash64(*[F.col(k) for k in keys], t, c["cx"], c["cy"], c["cz"])
    cells = df.withColumn("_slot", slot).withColumn("_cell", J.cube_key(parts)).withColumn("_node", node(F.col("_slot"), F.col("_cell")))
    seen = cells.groupBy("_node").agg(F.any_value(F.struct(*keys, "_slot", "_cell")).alias("c")).select("_node", "c.*")
    hops = seen.withColumn("_dt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_nb", F.explode(J.around([F.col("_cell.cx"), F.col("_cell.cy"), F.col("_cell.cz")])))
    to = hops.select("_node", node(F.col("_slot") + F.col("_dt"), F.col("_nb")).alias("_to"))
    links = to.join(seen.select(F.col("_node").alias("_to")), "_to", "left_semi")
    roots = graph.components(links, "_node", "_to").select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = cells.join(roots, "_node", "left").withColumn(out, F.coalesce("_root", "_node"))
    return joined.drop("_slot", "_cell", "_node", "_root")


def stream_units(df: DataFrame, unit: Sequence[str], order: Sequence, reads: Sequence[str], rule: Callable[[], Callable], new_columns: str) -> DataFrame:
    """Sort each unit and pass the columns ``reads`` of its rows, in order, through a fresh rule; the rule returns one tuple per row.

    Dates reach the rule as day numbers.  All other columns stay in Arrow.  The result is stored: numbering reads it
    three times, and the rule is the one step that cannot be spread further.
    """
    unit = list(unit)
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(new_columns).fields)
    added = schema.fields[len(df.schema.fields):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, step = None, None
        listed = lambda c: (c.cast(pa.int32()) if pa.types.is_date32(c.type) else c).to_pylist()
        for batch in batches:
            out = []
            for ident, row in zip(zip(*[listed(batch.column(u)) for u in unit]), zip(*[listed(batch.column(c)) for c in reads])):
                if ident != here:
                    here, step = ident, rule()
                out.append(step(*row))
            columns = zip(*out) if out else [[] for _ in added]
            fresh = [pa.array(list(c), pa.string() if isinstance(f.dataType, T.StringType) else pa.float64()) for f, c in zip(added, columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=[f.name for f in schema.fields])

    return durable(df.repartition(*unit).sortWithinPartitions(*unit, *order).mapInArrow(run, schema))


def _exact_km(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Great-circle distance by the C library, term by term as the SQL has it: two equally far places may differ in the last bit."""
    p, q = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    h = p ** 2.0 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * q ** 2.0
    return 2 * S.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def _unit_vector(lon: float | None, lat: float | None) -> tuple[float, float, float]:
    """Point on the unit sphere; a missing place lies at the centre, nearer to none than another place."""
    if lon is None or lat is None or not (math.isfinite(lon) and math.isfinite(lat)):
        return 0.0, 0.0, 0.0
    x, y = math.radians(lon), math.radians(lat)
    return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)


class _Live:
    """Places of the objects that can still be joined, in opening order, with a region number each.

    Unit vectors find the few places that can be nearest, only these are measured; a row costs one product over the live objects.
    """

    NEAR = 1e-12  # far above the error of a product of unit vectors

    def __init__(self):
        self.ids: list = []
        self.places: list[tuple] = []
        self._days = np.empty(64, dtype=np.int64)
        self._regions = np.empty(64, dtype=np.int64)
        self._at = np.empty((64, 3))

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def days(self) -> list[int]:
        return self._days[:len(self)].tolist()

    def drop_before(self, day: int) -> list[bool]:
        """Leave out objects last seen before ``day``; tells which stayed."""
        n = len(self)
        alive = self._days[:n] >= day
        stay = alive.tolist()
        if not alive.all():
            m = int(alive.sum())
            for a in (self._days, self._regions, self._at):
                a[:m] = a[:n][alive]
            self.ids = [v for v, ok in zip(self.ids, stay) if ok]
            self.places = [v for v, ok in zip(self.places, stay) if ok]
        return stay

    def open(self, ident, day: int, lon, lat, region: int = 0) -> None:
        n = len(self)
        if n == len(self._days):
            self._days, self._regions, self._at = (np.concatenate([a, np.empty_like(a)]) for a in (self._days, self._regions, self._at))
        self.ids.append(ident)
        self.places.append(None)
        self._regions[n] = region
        self.move(n, day, lon, lat)

    def move(self, n: int, day: int, lon, lat) -> None:
        self.places[n], self._days[n], self._at[n] = (lon, lat), day, _unit_vector(lon, lat)

    def nearest(self, lon, lat, km: float, regions: np.ndarray | None = None) -> int | None:
        """Number of the nearest object within ``km``, the first of equals; ``regions`` tells which region numbers count."""
        here = _unit_vector(lon, lat)
        if not self.ids or here == (0.0, 0.0, 0.0):
            return None
        dot = self._at[:len(self.ids)] @ np.array(here)
        if regions is not None:
            dot[~regions[self._regions[:len(self.ids)]]] = -2.0
        reach = math.cos(km / S.EARTH_KM) if km < math.pi * S.EARTH_KM else -1.0
        top = float(dot.max())
        if top < reach - self.NEAR:
            return None
        near = (dot >= max(top, reach) - self.NEAR).nonzero()[0].tolist()
        if len(near) == 1 and top > max(reach, 0.0) + self.NEAR:
            return near[0]  # the only one, and within reach beyond any rounding
        best, least = None, km
        for n in near:
            if not self._at[n].any():
                continue
            d = _exact_km(*self.places[n], lon, lat)
            if d < least or (best is None and d <= least):
                best, least = n, d
        return best


def _first_come_links(rows: DataFrame, keys: Sequence[str], date: str, lon: str, lat: str, gaps: tuple[int, int], km: float) -> DataFrame:
    """(p, q, cost, head) of (``_pos``, keys, date, place): each row takes the nearest row before it that is from ``gaps`` days before and
    within ``km``, unless an earlier row took it.

    Days lie in slots as wide as the longest gap, places in cubes as wide as the reach, so pairs come from an equality join.
    """
    keys, (least, most) = list(keys), gaps
    wide = max(int(most), 1)
    day = S.day_number(date)
    slot = lambda d: F.floor(d / wide).cast("int")
    blocks = M.block_of([F.lit(0), *keys], day, lambda shift: J.cube(lon, lat, 8 * km, shift), 16 * wide)
    seen = rows.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    q = seen.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("_pos").alias("q"), day.alias("_qday"), F.col(lon).alias("_qlon"), F.col(lat).alias("_qlat"), slot(day).alias("_qslot"), *blocks)
    p = seen.select(*keys, F.col("_pos").alias("p"), day.alias("_day"), F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), F.explode(F.sequence(slot(day - most), slot(day - least))).alias("_slot"))
    gap = F.col("_day") - F.col("_qday")
    pairs = J.radius_pairs(p, q, km, ("_lon", "_lat"), ("_qlon", "_qlat"), [(k, f"_q_{k}") for k in keys] + [("_slot", "_qslot")], "cost")
    return M.first_come(pairs.filter((gap >= least) & (gap <= most) & (F.col("q") < F.col("p"))).select("p", "q", "cost", *M.GRIDS))


#: Columns that the rule of patches reads.
PATCH_READS = ("object_id", "date", "centroid_lon", "centroid_lat")


def _patch_rule(days: int, km: float):
    def fresh():
        live, today = _Live(), [None]

        def step(ident, day, lon, lat):
            if day != today[0]:
                live.drop_before(day - days)
                today[0] = day
            n = live.nearest(lon, lat, km)
            if n is None:
                live.open(ident, day, lon, lat)
                return (ident,)
            live.move(n, day, lon, lat)
            return (live.ids[n],)

        return step

    return fresh


def _patch_order() -> list:
    return ["date", F.col("cumulative_sic_loss").desc(), "object_id"]


def _streamed_patches(patches: DataFrame, days: int, km: float, keys: Sequence[str]) -> DataFrame:
    """Patches with the ``opener`` of their event, from units that cannot touch."""
    units = proximity_units(patches, keys, "date", "centroid_lon", "centroid_lat", days, km)
    return stream_units(units, [*keys, "unit"], _patch_order(), PATCH_READS, _patch_rule(days, km), "opener string").drop("unit")


def track_patches(patches: DataFrame, days: int = 2, km: float = 300.0, keys: Sequence[str] = ("region",), id_prefix: str = "ULE", blocks: bool = False) -> DataFrame:
    """SEQ-01: link daily patches to events; adds ``opener`` (first patch of the event) and ``unique_local_event_id``.

    Per key, in (date, loss descending, object id) order, a patch joins the nearest event
    whose last patch is at most ``days`` old and ``km`` away, else it opens an event.
    Patches of one day may chain into one event.  Ids number the openings over all keys.

    By default patches stream through the rule in units that cannot touch; a unit that percolates is one task.  With ``blocks``
    the links are settled as a matching in blocks of space and time (``matching``): an event is known by its last patch, and each
    patch is followed by one other at most.  Both give the same events; blocks do more work and split any catalogue.
    """
    keys = list(keys)
    if not blocks:
        linked = _streamed_patches(patches, days, km, keys)
        opened = linked.filter("opener = object_id").select(*keys, "date", "cumulative_sic_loss", "object_id")
        numbers = ordered.row_numbers(opened, [], [*keys, *_patch_order()], "_no").select(*keys, F.col("object_id").alias("opener"), S.numbered_id(id_prefix, "_no", 6).alias("unique_local_event_id"))
        return linked.join(numbers, [*keys, "opener"])
    order = [*keys, "date", F.col("cumulative_sic_loss").desc(), "object_id"]
    numbered = durable(ordered.row_numbers(patches, [], order, "_pos").drop("n_total"))
    links = _first_come_links(numbered.select(*keys, "_pos", "date", "centroid_lon", "centroid_lat"), keys, "date", "centroid_lon", "centroid_lat", (0, days), km)
    owner = numbered.select("_pos").join(links.select(F.col("p").alias("_pos"), "head"), "_pos", "left").withColumn("head", F.coalesce("head", "_pos"))
    openers = numbered.select(F.col("_pos").alias("head"), F.col("object_id").alias("opener")).join(owner.filter("head = _pos").select("head"), "head", "left_semi")
    numbers = ordered.row_numbers(openers, [], ["head"], "_no").select("head", "opener", S.numbered_id(id_prefix, "_no", 6).alias("unique_local_event_id"))
    return numbered.join(owner.join(numbers, "head").drop("head"), "_pos").drop("_pos")


def membership(linked: DataFrame) -> DataFrame:
    """Bridge table event to patch with the patch key."""
    return linked.select("unique_local_event_id", "object_id", S.patch_key().alias("patch_key"), "date", "start_date", "window_days", "threshold")


def roll_up(linked: DataFrame, keys: Sequence[str] = ("unique_local_event_id",), distributed: str = "error") -> DataFrame:
    """AGG-07: one row per event from its member patches, with the centroid rule for its longitude class.

    An event whose longitudes spread over more than half the globe is an error, or with
    ``distributed="flag"`` a row without centroid that says so in ``needs_decision``;
    ``"skip"`` leaves the flag out.
    """
    keys = list(keys)
    base = linked.groupBy(*keys).agg(
        F.any_value("region").alias("dominant_region"), F.min("date").alias("event_start"), F.max("date").alias("event_end"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("duration_days"), F.count(F.lit(1)).alias("n_daily_patches"),
        F.max("object_area_cells").alias("max_area_cells"), F.max("object_area_km2").alias("max_area_km2"), F.max(-F.col("mean_sic_change")).alias("max_intensity"),
        F.min("min_sic_change").alias("min_sic_change"), F.avg("mean_sic_change").alias("mean_sic_change"), F.sum("cumulative_sic_loss").alias("cumulative_loss"),
        F.min("window_days").alias("window_days"), F.min("threshold").alias("sic_change_threshold"), F.min("object_area_cells").alias("min_cells"),
        F.bool_or("overlap_with_series_event").alias("overlap_with_series_event"), F.bool_or("overlap_with_regional_event").alias("overlap_with_regional_event_v1"))
    geo = RA.circular_gaps(linked, keys, "centroid_lon")
    kinds = geo.select(*keys, F.col("geometry_class").alias("track_longitude_geometry_class"))
    if distributed != "error":
        geo = geo.filter("geometry_class <> 'LONGITUDE_DISTRIBUTED'")
    c = RA.weighted_centroid(linked, keys, "cumulative_sic_loss", "centroid_lon", "centroid_lat", None, None, distributed="error", geometry=geo)
    c = c.select(*keys, F.col("centroid_lon").alias("track_centroid_lon"), F.col("centroid_lat").alias("track_centroid_lat"), F.col("geometry_class").alias("track_longitude_geometry_class"))
    if distributed == "flag":
        c = kinds.join(c.drop("track_longitude_geometry_class"), keys, "left").withColumn("needs_decision", F.col("track_longitude_geometry_class") == "LONGITUDE_DISTRIBUTED")
    return base.join(c, keys, "left" if distributed == "skip" else "inner")


#: Columns that the rule of clusters reads.
CLUSTER_READS = ("unique_local_event_id", "event_date", "gap_days", "distance_km", "dominant_region", "track_centroid_lon", "track_centroid_lat", "cumulative_loss")


def _cluster_rule(adjacent: dict[str, tuple[str, ...]]):
    def fresh():
        live, sums, today, numbers, joins = _Live(), [], [None], {None: 0}, {}

        def number(region):
            if region not in numbers:
                numbers[region] = len(numbers)
                joins.clear()
            return numbers[region]

        def step(ident, day, gap, km, here, lon, lat, loss):
            if day != today[0]:
                sums[:] = [s for s, ok in zip(sums, live.drop_before(day - gap)) if ok]
                today[0] = day
            code = number(here)
            if code not in joins:
                joins[code] = np.array([r is not None and here is not None and (r == here or here in adjacent.get(r, ())) for r in numbers], dtype=bool)
            w = 1.0 if loss is None else max(loss, 1.0)
            n = live.nearest(lon, lat, km, joins[code])
            if n is None:
                live.open(ident, day, lon, lat, code)
                sums.append(None if lon is None or lat is None else [w, w * lon, w * lat])  # without a place nothing joins it
                return ident, lon, lat
            s = sums[n]
            s[0] += w; s[1] += w * lon; s[2] += w * lat
            live.move(n, day, s[1] / s[0], s[2] / s[0])
            return live.ids[n], *live.places[n]

        return step

    return fresh


def _touching_parts(adjacent: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Smallest region name of the part of the adjacency graph that each region lies in."""
    part = {r: r for pair in ((a, *b) for a, b in adjacent.items()) for r in pair}
    changed = True
    while changed:
        changed = False
        for a, others in adjacent.items():
            low = min(part[r] for r in (a, *others))
            for r in (a, *others):
                changed |= part[r] != low
                part[r] = low
    return part


def cluster_events(events: DataFrame, adjacent: dict[str, tuple[str, ...]], settings: Sequence[tuple[int, float]] = ((5, 500.0),)) -> DataFrame:
    """SEQ-02 / SEV-05: events to clusters for every (gap, distance) setting in one pass.

    In (date, region, id) order an event joins the nearest cluster whose running
    loss-weighted centroid is within reach, whose last event is at most ``gap`` days old and
    whose first region equals or touches its own; a missing region matches none.  The running centroid is kept as three
    sums.  Units are runs of days without a longer pause, per setting and per part of the
    regions that touch each other directly or through others.
    """
    part = F.col("dominant_region")
    named = [F.lit(v) for pair in sorted(_touching_parts(adjacent).items()) for v in pair]
    if named:
        part = F.coalesce(F.create_map(*named)[part], part)
    each = F.explode(F.array(*[F.struct(F.lit(int(g)).alias("gap_days"), F.lit(float(d)).alias("distance_km")) for g, d in settings]))
    e = events.withColumn("event_date", F.col("event_start")).withColumn("_part", F.coalesce(part, F.lit(""))).withColumn("_s", each).select("*", "_s.*").drop("_s")
    cut = None
    for gap in sorted({g for g, _ in settings}):
        part = time_islands(e.filter(F.col("gap_days") == gap), gap, ["gap_days", "_part"], "event_date")
        cut = part if cut is None else cut.unionByName(part)
    order = ["event_date", "dominant_region", "unique_local_event_id"]
    out = stream_units(cut, ["gap_days", "distance_km", "_part", "island"], order, CLUSTER_READS, _cluster_rule(adjacent), "opener string, running_lon double, running_lat double")
    opened = out.filter("opener = unique_local_event_id").select("gap_days", "distance_km", *order)
    numbers = ordered.row_numbers(opened, ["gap_days", "distance_km"], order, "_no").select(
        "gap_days", "distance_km", F.col("unique_local_event_id").alias("opener"), S.numbered_id("CL", "_no", 5).alias("cluster_id"))
    return out.join(numbers, ["gap_days", "distance_km", "opener"]).drop("island", "_part")


def cluster_roll_up(members: DataFrame, region_order: Sequence[str], keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """AGG-08: one row per cluster: span, totals, peak members, members in order, flags and AGG-09 region."""
    keys = list(keys)
    pos = F.struct("event_date", "dominant_region", "unique_local_event_id")
    peak = F.struct("event_date", "unique_local_event_id", "dominant_region", "track_centroid_lon", "track_centroid_lat")
    last = F.struct("running_lon", "running_lat")
    m = members.withColumn("_back", -S.day_number("event_date"))
    # first maximum: the highest value, then the earliest row (min_by over the negated value)
    a = m.groupBy(*keys).agg(
        F.min("event_start").alias("start_date"), F.max("event_end").alias("end_date"), F.count(F.lit(1)).alias("member_event_count"),
        F.sum("cumulative_loss").alias("total_cumulative_loss"), F.max("max_area_km2").alias("max_area"), F.max("max_intensity").alias("max_intensity"),
        F.min_by(peak, F.struct(-F.col("cumulative_loss"), pos)).alias("_p"), F.min_by("event_date", F.struct(-F.col("max_intensity"), pos)).alias("peak_intensity_date"),
        F.min_by("dominant_region", pos).alias("legacy_first_member_region"), F.max_by(last, pos).alias("_c"),
        F.bool_or("overlap_with_regional_event_v1").alias("matches_regional"), F.bool_or("overlap_with_series_event").alias("matches_panarctic"))
    a = a.withColumn("duration_days", F.datediff("end_date", "start_date") + 1)
    reps = a.select(*keys, F.col("_p.dominant_region").alias("representative_region"))
    reg = dominant_by_loss(m, reps, region_order, keys)
    return a.join(reg, keys).select(
        *keys, "dominant_region", "legacy_first_member_region", "loss_dominant_region_fraction", "tie_count", "tie_break", "start_date", "end_date", "duration_days",
        "member_event_count", "total_cumulative_loss", "max_area", "max_intensity", F.col("_p.event_date").alias("peak_loss_date"), "peak_intensity_date",
        F.col("_p.event_date").alias("representative_date"), F.col("_p.unique_local_event_id").alias("representative_event_id"), F.col("_p.dominant_region").alias("representative_region"),
        F.col("_p.track_centroid_lon").alias("representative_lon"), F.col("_p.track_centroid_lat").alias("representative_lat"),
        F.col("_c.running_lon").alias("centroid_lon"), F.col("_c.running_lat").alias("centroid_lat"), "matches_regional", "matches_panarctic")


def dominant_by_loss(members: DataFrame, representatives: DataFrame, region_order: Sequence[str], keys: Sequence[str], region="dominant_region", loss="cumulative_loss") -> DataFrame:
    """AGG-09: region with the largest summed loss; near ties go to the representative region, then to the fixed order."""
    keys = list(keys)
    pos = F.array_position(F.array(*[F.lit(r) for r in region_order]), F.col(region))
    per = members.groupBy(*keys, region).agg(F.sum(loss).alias("_w"), F.min(loss).alias("_lo"), F.max(loss).alias("_hi"), F.max(F.col(loss).isNull()).alias("_gap"))
    tot = per.groupBy(*keys).agg(F.sum("_w").alias("_t"), F.max(F.abs("_w")).alias("_m"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_gap").alias("_gap"))
    sound = (~F.col("_gap")) & ((F.col("_lo") >= 0) | (F.col("_hi") <= 0)) & (F.col("_t") != 0)
    tot = tot.withColumn("_m", F.when(sound, F.col("_m")).otherwise(F.raise_error(F.lit("loss must be present, of one sign and not all zero in a cluster"))))
    tied = per.drop("_lo", "_hi", "_gap").join(tot, keys).filter(F.abs(F.abs(F.col("_w")) - F.col("_m")) <= 1e-12 * F.greatest(F.lit(1.0), F.col("_m")) + 1e-12 * F.col("_m"))
    t = tied.join(representatives, keys).withColumn("_rep", F.col(region) == F.col("representative_region"))
    pick = t.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("tie_count"), F.bool_or("_rep").alias("_has_rep"), F.min_by(region, F.struct(~F.col("_rep"), pos)).alias(region),
                                F.max(F.col("_m") / F.abs(F.col("_t"))).alias("loss_dominant_region_fraction"))
    how = F.when(F.col("tie_count") == 1, "unique_maximum").when(F.col("_has_rep"), "representative_region").otherwise("physical_regions_order")
    return pick.withColumn("tie_break", how).drop("_has_rep")


def cluster_member_lists(members: DataFrame, keys: Sequence[str] = ("cluster_id",), chunk: int = 1000) -> DataFrame:
    """Ordered member ids as arrays of at most ``chunk`` ids (part 0, 1, ...), so a large cluster never becomes one value."""
    n = ordered.row_numbers(members.select(*keys, "event_date", "dominant_region", "unique_local_event_id"), keys, ["event_date", "dominant_region", "unique_local_event_id"])
    part = F.floor((F.col("rn") - 1) / chunk).cast("int").alias("part")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "unique_local_event_id"))), lambda s: s["unique_local_event_id"])
    return n.groupBy(*keys, part).agg(ids.alias("member_event_ids"))


def link_tracks(centres: DataFrame, km: float = 1000.0, min_days: int = 2) -> DataFrame:
    """SEQ-03: link daily centres to tracks; drop short tracks, renumber by opening order, add WIN-08 columns.

    Lowest pressure first, a centre takes the nearest track that ended the day before and that
    no other took; of equally near ones the track that was opened first.
    """
    numbered = durable(ordered.row_numbers(centres, [], ["date", "center_pressure_hpa", "i", "j"], "_pos").drop("n_total"))
    links = _first_come_links(numbered.select("_pos", "date", "lon", "lat"), [], "date", "lon", "lat", (1, 1), km)
    linked = numbered.join(links.select(F.col("p").alias("_pos"), F.col("cost").alias("link_distance_km"), "head"), "_pos", "left").withColumn("head", F.coalesce("head", "_pos"))
    lengths = linked.groupBy("head").agg(F.count_distinct("date").alias("track_length_days")).filter(F.col("track_length_days") >= min_days)
    ids = ordered.row_numbers(lengths, [], ["head"], "track_id").drop("n_total")
    w = W.partitionBy("head").orderBy("date")
    return linked.join(ids, "head").withColumn("track_day_index", F.row_number().over(w)).drop("head", "_pos")


def track_summary(points: DataFrame) -> DataFrame:
    """AGG-32."""
    return points.groupBy("track_id").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count_distinct("date").alias("track_length_days"), F.min("center_pressure_hpa").alias("min_center_pressure_hpa"),
        F.max("depth_hpa").alias("max_depth_hpa"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))


def tracking_sensitivity(patches: DataFrame, windows: Sequence[int], thresholds: Sequence[float], sizes: Sequence[int], days: int = 2, km: float = 300.0) -> DataFrame:
    """SEV-04: patch and event counts for every window x threshold x size, tracked in one pass with the setting as a key.

    A threshold that the patch table does not hold yields a row that says so.
    """
    spark = patches.sparkSession
    combos = [(i, w, t, n) for i, (w, t, n) in enumerate((w, t, n) for w in windows for t in thresholds for n in sizes)]
    asks = spark.createDataFrame(combos, "setting int, window_ask int, threshold_ask double, min_cells int")
    fits = F.array(*[F.when((F.col("window_days") == w) & S.is_close("threshold", F.lit(t)) & (F.col("object_area_cells") >= n), F.lit(i)) for i, w, t, n in combos])
    spread = patches.withColumn("setting", F.explode(F.array_compact(fits)))
    read = ["setting", "region", "object_id", "date", "centroid_lon", "centroid_lat", "cumulative_sic_loss"]
    linked = _streamed_patches(spread.select(*read), days, km, ["setting", "region"])  # only counted, so openings need no numbers
    counts = linked.groupBy("setting").agg(F.count(F.lit(1)).alias("daily_patch_count"), F.count_if(F.col("opener") == F.col("object_id")).alias("unique_event_count"))
    has = patches.agg(*[F.bool_or(S.is_close("threshold", F.lit(t))).alias(f"h{i}") for i, t in enumerate(thresholds)])
    there = has.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold_ask"), F.col(f"h{i}").alias("held")) for i, t in enumerate(thresholds)])).alias("h")).select("h.*")
    out = asks.join(there, "threshold_ask").join(counts, "setting", "left")
    n = lambda c: F.when(F.col("held"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return out.select(F.col("window_ask").alias("window_days"), F.col("threshold_ask").alias("sic_change_threshold"), "min_cells", n("daily_patch_count"), n("unique_event_count"),
                      F.when(F.col("held"), "ok").otherwise("not_available_in_existing_daily_object_file").alias("status"))
