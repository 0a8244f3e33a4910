"""Raster queries: SRC-02..09, SRC-12/13/15, RAS-01..09/15/16, AGG-04..06/32/44, TOP-01/02/05/07, WIN-12, SCA geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, geometry as G, scalar as S
from ..operators import pressure as P, raster as RA
from ..session import ensure_checkpoint_dir
from ..sources import cells as C
from . import inputs as I, walks as WK
from .on_joins import hav
from .registry import query

R = S.rounded
THR = -0.3125

DELTA = "delta AS (SELECT e.date, e.y, e.x, s.value AS start_value, e.value, e.value - s.value AS delta FROM field e JOIN field s ON s.y = e.y AND s.x = e.x AND s.date = e.date - 3)"


def delta(spark, sf, days=3):
    return RA.window_difference(I.field(spark, sf), days)


# ---- sources ---------------------------------------------------------------

@query("src_02_field_scan", I.with_ctes("field", "panf") + " SELECT date, y, x, CASE WHEN value BETWEEN 0.05 AND 0.9 THEN value END AS value FROM field WHERE date IN (SELECT event_date FROM panf)")
def _(spark, sf):
    return C.scan_field(I.field(spark, sf), I.pan_frames(spark, sf).select(F.col("event_date").alias("date")), low=0.05, high=0.9)


@query("src_03_array_to_cells", "WITH e AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) t(i)) SELECT vec_id, y, x, value FROM e")
def _(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda v: v.cast("double")))
    return C.explode_grid(I.table(spark, sf, "embeddings").select("vec_id", rows.alias("values")), ["vec_id"])


FILES = """files AS (SELECT CAST(o_orderdate AS DATE) AS date, '/data/' || year(o_orderdate) || '/ext_' || strftime(o_orderdate, '%Y%m%d') || '_v' || (o_orderkey % 4) || '.' || (o_orderkey % 12) || '.tif' AS path FROM orders)"""


def files(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    return I.table(spark, sf, "orders").select(d.alias("date"), F.concat(F.lit("/data/"), F.year(d), F.lit("/ext_"), F.date_format(d, "yyyyMMdd"), F.lit("_v"), k % 4, F.lit("."), k % 12, F.lit(".tif")).alias("path"))


@query("src_04_newest_version", "WITH " + FILES + ", r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CAST(split_part(split_part(path, '_v', 2), '.', 1) AS INTEGER) DESC, CAST(split_part(split_part(path, '_v', 2), '.', 2) AS INTEGER) DESC, path DESC) AS rn FROM files) SELECT date, path FROM r WHERE rn = 1")
def _(spark, sf):
    return C.newest_version(files(spark, sf))


@query("src_05_static_grid", I.with_ctes("grid") + " SELECT y, x, area_km2, region_code FROM grid")
def _(spark, sf):
    raw = I.grid(spark, sf).select("y", "x", (F.col("area_km2") * 1e6).alias("area_m2"), "region_code")
    return C.grid_in_km2(raw).select("y", "x", R("area_km2").alias("area_km2"), "region_code")


@query("src_06_files_in_years", "WITH " + FILES + " SELECT path, CAST(year(date) AS INTEGER) AS year FROM files WHERE year(date) BETWEEN 1996 AND 1998")
def _(spark, sf):
    return C.files_in_years(files(spark, sf).withColumn("path", F.col("path")), 1996, 1998).select("path", "year")


@query("src_08_09_footprint_store", I.with_ctes("patch", "pcell") + " SELECT object_id, y, x, delta FROM pcell WHERE object_id IN (SELECT object_id FROM patch WHERE object_area_cells >= 40)")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    C.write_footprints(I.patch_cells(spark, sf).select("object_id", "date", "y", "x", "delta"), path)
    ids = I.patches(spark, sf).filter("object_area_cells >= 40")
    return C.read_footprints(spark, path, ids, [1995]).select("object_id", "y", "x", F.col("delta").cast("double").alias("delta"))


@query("src_12_coverage", "WITH need AS (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d) WHERE month(d) IN (6, 7, 8)), have AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT CAST(year(n.date) AS INTEGER) AS year, count(*) AS required_days, count(h.date) AS present_days, min(CASE WHEN h.date IS NULL THEN n.date END) AS first_missing, CASE WHEN count(*) = count(h.date) THEN 'complete' ELSE 'incomplete' END AS status FROM need n LEFT JOIN have h ON n.date = h.date GROUP BY 1")
def _(spark, sf):
    o = I.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return C.coverage(o, "1995-01-01", "2001-12-31", "jja")


@query("src_13_required_inventory", I.with_ctes("pan", "daily") + """, w AS (SELECT event_id, event_date - 2 AS date, 'start' AS role FROM pan UNION ALL SELECT event_id, event_date + 1, 'end' FROM pan)
SELECT w.date, string_agg(DISTINCT role, ';' ORDER BY role) AS roles, count(DISTINCT event_id) AS n_events, CASE WHEN w.date IN (SELECT date FROM daily) THEN 'present' ELSE 'missing' END AS status FROM w GROUP BY w.date""")
def _(spark, sf):
    return C.required_inventory(I.pan(spark, sf), I.daily(spark, sf).select("date").distinct())


@query("src_15_schema_audit", """SELECT 'orders' AS input, '' AS missing_columns, count(*) AS n_rows, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'available' END AS status FROM orders UNION ALL
SELECT 'events', 'lat;lon', count(*), 'missing_columns' FROM events""")
def _(spark, sf):
    return C.schema_audit({"orders": I.table(spark, sf, "orders"), "events": I.table(spark, sf, "events")}, {"orders": ["o_orderkey"], "events": ["ts", "lat", "lon"]})


# ---- differences and stencils -------------------------------------------------

@query("ras_01_window_difference", I.with_ctes("field") + ", " + DELTA + " SELECT date, y, x, start_value, delta FROM delta")
def _(spark, sf):
    return delta(spark, sf).select("date", "y", "x", "start_value", "delta")


MASK = I.with_ctes("field") + ", " + DELTA + f", mask AS (SELECT date, y, x FROM delta WHERE delta <= {THR})"
CLOSED = MASK + """, off AS (SELECT a, b FROM range(-1, 2) p(a), range(-1, 2) q(b)), lim AS (SELECT max(y) AS my, max(x) AS mx FROM delta),
dil AS (SELECT DISTINCT date, y + a AS y, x + b AS x FROM mask, off, lim WHERE y + a BETWEEN 0 AND my AND x + b BETWEEN 0 AND mx),
ero AS (SELECT date, y + a AS y, x + b AS x FROM dil, off GROUP BY 1, 2, 3 HAVING count(*) = 9),
closed AS (SELECT e.date, e.y, e.x FROM ero e JOIN delta d ON d.date = e.date AND d.y = e.y AND d.x = e.x)"""


@query("ras_02_closed_mask", CLOSED + " SELECT CAST(date AS DATE) AS date, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM closed")
def _(spark, sf):
    d = delta(spark, sf)
    return RA.closed_mask(d.filter(F.col("delta") <= THR), d, ["date"]).select("date", "y", "x")


def label_sql(mask: str, connectivity: int) -> str:
    near = "abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1" if connectivity == 8 else "abs(m.y - r.y) + abs(m.x - r.x) <= 1"
    return f""", node AS (SELECT date, y, x, CAST(y AS BIGINT) * 4294967296 + x AS id FROM {mask}),
reach AS (SELECT date, id AS src, y, x, id FROM node UNION SELECT r.date, r.src, m.y, m.x, m.id FROM reach r JOIN node m ON m.date = r.date AND {near}),
lab AS (SELECT date, y, x, min(src) AS component FROM reach GROUP BY 1, 2, 3),
sized AS (SELECT date, component, count(*) AS cell_count, row_number() OVER (PARTITION BY date ORDER BY component) AS label_id FROM lab GROUP BY 1, 2)"""


RMASK = MASK.replace("WITH ", "WITH RECURSIVE ", 1)


@query("ras_03_components_8", RMASK + label_sql("mask", 8) + " SELECT lab.date, lab.y, lab.x, label_id, cell_count FROM lab JOIN sized USING (date, component) WHERE cell_count >= 4")
def _(spark, sf):
    c = RA.label(delta(spark, sf).filter(F.col("delta") <= THR), ["date"])
    return c.join(RA.raster_numbers(c, ["date"], 4), ["date", "component"]).select("date", "y", "x", "label_id", "cell_count")


@query("ras_04_components_4", RMASK + label_sql("mask", 4) + " SELECT lab.date, lab.y, lab.x, label_id, cell_count FROM lab JOIN sized USING (date, component) WHERE cell_count > 3")
def _(spark, sf):
    c = RA.label(delta(spark, sf).filter(F.col("delta") <= THR), ["date"], 4)
    return c.join(RA.raster_numbers(c, ["date"], 3, strict=True), ["date", "component"]).select("date", "y", "x", "label_id", "cell_count")


@query("ras_05_neighbour_count", MASK + """, n AS (SELECT m.date, m.y + a AS y, m.x + b AS x, count(*) FILTER (NOT (a = 0 AND b = 0)) AS n_near FROM mask m, range(-1, 2) p(a), range(-1, 2) q(b) GROUP BY 1, 2, 3),
lim AS (SELECT max(x) AS mx FROM field) SELECT date, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN y BETWEEN 1 AND 23 AND x BETWEEN 1 AND mx - 1 THEN n_near ELSE 0 END AS n_near FROM n, lim WHERE y BETWEEN 0 AND 24 AND x BETWEEN 0 AND mx""")
def _(spark, sf):
    nx = I.field(spark, sf).agg(F.max("x")).first()[0] + 1
    return RA.neighbour_count(delta(spark, sf).filter(F.col("delta") <= THR), ["date"], 25, nx).select("date", "y", "x", "n_near")


@query("ras_05_expand_mask", I.with_ctes("grid") + """, lim AS (SELECT max(x) AS mx FROM grid), s0 AS (SELECT y, x FROM grid WHERE region_code > 18),
s1 AS (SELECT y, x FROM s0 UNION SELECT g.y, g.x FROM grid g, lim, s0 WHERE g.y BETWEEN 1 AND 23 AND g.x BETWEEN 1 AND mx - 1 AND abs(g.y - s0.y) <= 1 AND abs(g.x - s0.x) <= 1)
SELECT y, x FROM s1 UNION SELECT g.y, g.x FROM grid g, lim, s1 WHERE g.y BETWEEN 1 AND 23 AND g.x BETWEEN 1 AND mx - 1 AND abs(g.y - s1.y) <= 1 AND abs(g.x - s1.x) <= 1""")
def _(spark, sf):
    g = I.grid(spark, sf)
    nx = g.agg(F.max("x")).first()[0] + 1
    return RA.expand_mask(g.filter("region_code > 18"), [], 2, 25, nx)


MIN = I.with_ctes("met") + """, mini AS (SELECT c.date, c.i, c.j, c.lat, c.lon, c.msl / 100 AS hpa FROM met c JOIN met n ON n.date = c.date AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND NOT (n.i = c.i AND n.j = c.j)
  GROUP BY ALL HAVING count(*) = 8 AND min(n.msl / 100) > c.msl / 100)"""


@query("ras_06_strict_minima", MIN + " SELECT date, i, j, round(hpa, 4) + 0.0 AS hpa FROM mini")
def _(spark, sf):
    f = I.met(spark, sf).withColumn("hpa", S.pa_to_hpa("msl"))
    return RA.strict_minima(f, ["date"], "hpa", "i", "j").select("date", "i", "j", R("hpa", 4).alias("hpa"))


@query("ras_07_ring_mean", I.with_ctes("met") + """ SELECT c.date, c.i, c.j, round(avg(n.msl), 4) + 0.0 AS ring_mean FROM met c LEFT JOIN met n ON n.date = c.date AND abs(n.i - c.i) IN (0, 2) AND abs(n.j - c.j) IN (0, 2) AND NOT (n.i = c.i AND n.j = c.j) GROUP BY 1, 2, 3""")
def _(spark, sf):
    f = I.met(spark, sf)
    return RA.ring_mean(f.select("date", "i", "j"), f, ["date"], "msl", 2, "i", "j").select("date", "i", "j", R("ring_mean", 4).alias("ring_mean"))


CAND = MIN + """, ring AS (SELECT m.date, m.i, m.j, avg(n.msl / 100) AS rm FROM mini m JOIN met n ON n.date = m.date AND abs(n.i - m.i) IN (0, 2) AND abs(n.j - m.j) IN (0, 2) AND NOT (n.i = m.i AND n.j = m.j) GROUP BY 1, 2, 3),
cand AS (SELECT m.date, m.i, m.j, m.lat, m.lon, hpa AS center_pressure_hpa, rm - hpa AS depth_hpa FROM mini m JOIN ring r ON r.date = m.date AND r.i = m.i AND r.j = m.j WHERE m.lat >= 54 AND hpa <= 2000 AND rm - hpa >= 1)"""


def cands(spark, sf):
    return P.candidates(I.met(spark, sf), 54.0, 2000.0, 1.0, 2)


@query("ras_08_candidates", CAND + " SELECT date, i, j, lat, lon, round(center_pressure_hpa, 4) + 0.0 AS center_pressure_hpa, round(depth_hpa, 6) + 0.0 AS depth_hpa FROM cand")
def _(spark, sf):
    return cands(spark, sf).select("date", "i", "j", "lat", "lon", R("center_pressure_hpa", 4).alias("center_pressure_hpa"), R("depth_hpa").alias("depth_hpa"))


@query("top_03_thinned_centres", CAND.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + WK.thin_walk("cand", 1500.0, 6) + " SELECT date, i, j, lat, lon, round(center_pressure_hpa, 4) + 0.0 AS center_pressure_hpa, round(depth_hpa, 6) + 0.0 AS depth_hpa FROM thinned")
def _(spark, sf):
    return P.thin(cands(spark, sf), 1500.0, 6).select("date", "i", "j", "lat", "lon", R("center_pressure_hpa", 4).alias("center_pressure_hpa"), R("depth_hpa").alias("depth_hpa"))


LAGS = "(VALUES (-1), (0), (1)) l(lag)"


@query("joi_20_nearest_centre", CAND + ", " + I.with_ctes("pan")[5:] + f""", a AS (SELECT event_id, lag, DATE '1995-01-01' + CAST(CAST(event_id[4:] AS BIGINT) % 27 AS INTEGER) + lag AS sample_date, centroid_lon AS lon, centroid_lat AS lat FROM pan, {LAGS}),
d AS (SELECT a.event_id, a.lag, c.center_pressure_hpa AS hpa, {hav('a.', 'c.')} AS km FROM a JOIN cand c ON c.date = a.sample_date),
n AS (SELECT event_id, lag, min(km) AS km, arg_min(hpa, km) AS hpa, count(*) FILTER (km <= 500) AS n5, count(*) FILTER (km <= 1000) AS n10 FROM d GROUP BY 1, 2)
SELECT a.event_id, a.lag, round(km, 5) + 0.0 AS nearest_cyclone_distance_km, round(hpa, 4) + 0.0 AS nearest_cyclone_pressure_hpa, coalesce(n5, 0) AS cyclone_count_500km, coalesce(n10, 0) AS cyclone_count_1000km FROM a LEFT JOIN n ON n.event_id = a.event_id AND n.lag = a.lag""")
def _(spark, sf):
    p = I.met_points(spark, sf).withColumn("lag", F.explode(F.array(*[F.lit(v) for v in fixed.CYCLONE_LAGS])))
    asks = p.select(F.col("point_id").alias("event_id"), "lag", F.date_add("sample_date", F.col("lag")).alias("sample_date"), "lon", "lat")
    out = P.nearest_centre(asks, cands(spark, sf))
    return out.select("event_id", "lag", R("nearest_cyclone_distance_km", 5).alias("nearest_cyclone_distance_km"), R("nearest_cyclone_pressure_hpa", 4).alias("nearest_cyclone_pressure_hpa"), "cyclone_count_500km", "cyclone_count_1000km")


@query("joi_21_daily_metrics", CAND + """, cal AS (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 1 DAY)) AS d) WHERE month(d) IN (1, 2)),
p AS (SELECT *, """ + hav('z.', 'c.') + """ AS km FROM cand c, (SELECT 77.5::DOUBLE AS lon, 75.0::DOUBLE AS lat) z),
n AS (SELECT date, count(*) AS c, count(*) FILTER (km <= 2000) AS near, min(km) AS km, arg_min(center_pressure_hpa, km) AS hpa FROM p GROUP BY 1)
SELECT cal.date, coalesce(c, 0) AS cyclone_count, coalesce(near, 0) AS cyclone_count_near, CASE WHEN near > 0 THEN 1 ELSE 0 END AS cyclone_near, round(km, 5) + 0.0 AS nearest_cyclone_distance_km, round(hpa, 4) + 0.0 AS nearest_cyclone_pressure_hpa FROM cal LEFT JOIN n ON n.date = cal.date""")
def _(spark, sf):
    m = P.daily_metrics(cands(spark, sf), 1995, 1995, (1, 2), fixed.REGION_BOUNDS["kara_sea"], 2000.0)
    return m.select("date", "cyclone_count", "cyclone_count_near", "cyclone_near", R("nearest_cyclone_distance_km", 5).alias("nearest_cyclone_distance_km"), R("nearest_cyclone_pressure_hpa", 4).alias("nearest_cyclone_pressure_hpa"))


@query("ras_09_gradient", I.with_ctes("field") + """ SELECT c.date, c.y, c.x, round(CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN (b.value - a.value) / 2 WHEN b.value IS NOT NULL THEN b.value - c.value WHEN a.value IS NOT NULL THEN c.value - a.value END, 6) + 0.0 AS grad_y,
round(CASE WHEN l.value IS NOT NULL AND r.value IS NOT NULL THEN (r.value - l.value) / 2 WHEN r.value IS NOT NULL THEN r.value - c.value WHEN l.value IS NOT NULL THEN c.value - l.value END, 6) + 0.0 AS grad_x FROM field c
LEFT JOIN field a ON a.date = c.date AND a.y = c.y - 1 AND a.x = c.x LEFT JOIN field b ON b.date = c.date AND b.y = c.y + 1 AND b.x = c.x
LEFT JOIN field l ON l.date = c.date AND l.y = c.y AND l.x = c.x - 1 LEFT JOIN field r ON r.date = c.date AND r.y = c.y AND r.x = c.x + 1""")
def _(spark, sf):
    f = I.field(spark, sf).withColumn("y_m", F.col("y").cast("double")).withColumn("x_m", F.col("x").cast("double"))
    return RA.gradient(f, ["date"], "value").select("date", "y", "x", R("grad_y").alias("grad_y"), R("grad_x").alias("grad_x"))


# ---- patches ---------------------------------------------------------------------

PATCH = RMASK + label_sql("mask", 8) + ", " + I.GRID + """, pc AS (SELECT lab.date, label_id, cell_count, lab.y, lab.x, delta, lon, lat, region_code, x_m, y_m, greatest(-delta, 0) AS w
  FROM lab JOIN sized USING (date, component) JOIN delta d ON d.date = lab.date AND d.y = lab.y AND d.x = lab.x JOIN grid g ON g.y = lab.y AND g.x = lab.x WHERE cell_count >= 4)"""


def patch_cells(spark, sf, **kw):
    return RA.detect_patches(delta(spark, sf), I.grid(spark, sf), THR, 4, **kw)


@query("agg_04_component_stats", PATCH + """ SELECT date, label_id, count(*) AS cell_count, round(avg(delta), 6) + 0.0 AS mean_change, min(delta) AS min_change, round(sum(w), 6) + 0.0 AS loss, round(sum(w * lon) / sum(w), 6) + 0.0 AS center_lon, round(sum(w * lat) / sum(w), 6) + 0.0 AS center_lat,
 arg_min(lon, (delta + 2) * 1e9::DOUBLE + y * 100000 + x) AS max_loss_lon, arg_min(lat, (delta + 2) * 1e9::DOUBLE + y * 100000 + x) AS max_loss_lat FROM pc GROUP BY 1, 2""")
def _(spark, sf):
    s = RA.component_stats(patch_cells(spark, sf), ["date", "label_id"])
    return s.select("date", "label_id", "cell_count", *[R(c).alias(c) for c in ("mean_change",)], "min_change", *[R(c).alias(c) for c in ("loss", "center_lon", "center_lat")], "max_loss_lon", "max_loss_lat")


GAPS = """, dv AS (SELECT DISTINCT date, label_id, (lon + 360) % 360 AS v FROM pc), nx AS (SELECT *, coalesce(lead(v) OVER w, first_value(v) OVER w + 360) AS nx FROM dv WINDOW w AS (PARTITION BY date, label_id ORDER BY v)),
gp AS (SELECT *, nx - v AS gap, max(nx - v) OVER (PARTITION BY date, label_id) AS mg FROM nx), gg AS (SELECT date, label_id, any_value(mg) AS largest_gap_deg, min(nx % 360) AS arc_start_deg, CAST(count(*) AS INTEGER) AS tie_count FROM gp WHERE gap >= mg - 1e-12 GROUP BY 1, 2),
rs AS (SELECT date, label_id, max(lon) - min(lon) AS raw_span_deg FROM pc GROUP BY 1, 2),
geo AS (SELECT *, 360 - largest_gap_deg AS covering_arc_deg, CASE WHEN 360 - largest_gap_deg > 180 THEN 'LONGITUDE_DISTRIBUTED' WHEN raw_span_deg > 180 THEN 'WRAP_ONLY' ELSE 'ORDINARY' END AS geometry_class FROM gg JOIN rs USING (date, label_id))"""


@query("win_12_circular_gaps", PATCH + GAPS + " SELECT date, label_id, raw_span_deg, covering_arc_deg, largest_gap_deg, arc_start_deg, tie_count, geometry_class FROM geo")
def _(spark, sf):
    g = RA.circular_gaps(patch_cells(spark, sf), ["date", "label_id"])
    return g.select("date", "label_id", "raw_span_deg", "covering_arc_deg", "largest_gap_deg", "arc_start_deg", "tie_count", "geometry_class")


def inverse_sql(x: str, y: str) -> tuple[str, str]:
    """(lon, lat) in SQL of polar stereographic metres: isometric colatitude, then the series from conformal to geodetic latitude."""
    import math

    e2 = 1 - (fixed.GRID_SEMI_MINOR_M / fixed.GRID_SEMI_MAJOR_M) ** 2
    e, ts = math.sqrt(e2), math.radians(fixed.GRID_TRUE_SCALE_LAT)
    tc = math.tan(math.pi / 4 - ts / 2) * ((1 + e * math.sin(ts)) / (1 - e * math.sin(ts))) ** (e / 2)
    mc = math.cos(ts) / math.sqrt(1 - e2 * math.sin(ts) ** 2)
    chi = f"(pi() / 2 - 2 * atan(sqrt(({x}) * ({x}) + ({y}) * ({y})) * {tc / (fixed.GRID_SEMI_MAJOR_M * mc)!r}::DOUBLE))"
    series = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    lat = " + ".join([chi, *[f"{c!r}::DOUBLE * sin({2 * k + 2} * {chi})" for k, c in enumerate(series)]])
    return f"(degrees(atan2({x}, -({y}))) + {fixed.GRID_LON_0} + 900) % 360 - 180", f"degrees({lat})"


def centroid_sql(keys: str, classes: str = "geo", digits: int = 6) -> str:
    """Centroid by longitude class of cells pc (keys, lon, lat, x_m, y_m, w): plain mean, mean on the unwrapped branch, projected barycentre."""
    lon, lat = inverse_sql("mx", "my")
    mean = lambda v: f"CASE WHEN sum(w) > 0 THEN sum(w * {v}) / sum(w) ELSE avg({v}) END"
    branch = "CASE WHEN (lon + 360) % 360 < arc_start_deg - 1e-12 THEN (lon + 360) % 360 + 360 ELSE (lon + 360) % 360 END"
    return f"""SELECT {keys}, geometry_class, round(CASE geometry_class WHEN 'ORDINARY' THEN ml WHEN 'WRAP_ONLY' THEN (mu + 180) % 360 - 180 ELSE {lon} END, {digits}) + 0.0 AS centroid_lon, round(CASE WHEN geometry_class = 'LONGITUDE_DISTRIBUTED' THEN {lat} ELSE mb END, {digits}) + 0.0 AS centroid_lat
 FROM (SELECT {keys}, any_value(geometry_class) AS geometry_class, {mean("lon")} AS ml, {mean("lat")} AS mb, {mean(branch)} AS mu, {mean("x_m")} AS mx, {mean("y_m")} AS my FROM pc JOIN {classes} USING ({keys}) GROUP BY {keys})"""


@query("sca_04_05_centroid_by_class", PATCH + GAPS + " " + centroid_sql("date, label_id"))
def _(spark, sf):
    c = patch_cells(spark, sf).withColumn("w", F.greatest(-F.col("delta"), F.lit(0.0)))
    g = RA.weighted_centroid(c, ["date", "label_id"], "w")
    return g.select("date", "label_id", "geometry_class", R("centroid_lon").alias("centroid_lon"), R("centroid_lat").alias("centroid_lat"))


@query("agg_05_region_of_object", PATCH + """, r AS (SELECT date, label_id, region_code, sum(w) AS w, count(*) AS n FROM pc GROUP BY 1, 2, 3), t AS (SELECT date, label_id, sum(w) AS tw, sum(n) AS tn FROM r GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY date, label_id ORDER BY w DESC, n DESC, region_code) AS rn FROM r WHERE region_code BETWEEN 1 AND 18),
m AS (SELECT date, label_id, string_agg(CAST(region_code AS VARCHAR), ';' ORDER BY region_code) AS memberships FROM r WHERE region_code BETWEEN 1 AND 18 GROUP BY 1, 2)
SELECT t.date, t.label_id, b.region_code, round(b.w / tw, 6) + 0.0 AS weight_fraction, round(b.n / CAST(tn AS DOUBLE), 6) + 0.0 AS cell_fraction, coalesce(memberships, '') AS memberships FROM t LEFT JOIN b ON b.date = t.date AND b.label_id = t.label_id AND rn = 1 LEFT JOIN m ON m.date = t.date AND m.label_id = t.label_id""")
def _(spark, sf):
    r = RA.region_of_object(patch_cells(spark, sf), ["date", "label_id"])
    return r.select("date", "label_id", "region_code", R("weight_fraction").alias("weight_fraction"), R("cell_fraction").alias("cell_fraction"), "memberships")


@query("agg_06_region_of_point", I.with_ctes("ev") + """ SELECT unique_local_event_id AS event_id, CASE WHEN track_centroid_lat BETWEEN 80 AND 90 THEN 'central_arctic' WHEN track_centroid_lon BETWEEN 55 AND 100 AND track_centroid_lat BETWEEN 68 AND 82 THEN 'kara_sea'
 WHEN track_centroid_lon BETWEEN -155 AND -120 AND track_centroid_lat BETWEEN 68 AND 82 THEN 'beaufort_sea' ELSE '' END AS region FROM ev""")
def _(spark, sf):
    boxes = [(n, *fixed.REGION_BOUNDS[n]) for n in ("central_arctic", "kara_sea", "beaufort_sea")]
    return RA.region_of_point(I.events(spark, sf), boxes, "track_centroid_lon", "track_centroid_lat").select(F.col("unique_local_event_id").alias("event_id"), "region")


LOCATE = CLOSED.replace("WITH ", "WITH RECURSIVE ", 1).replace(f"delta <= {THR}", f"delta < {THR}") + label_sql("closed", 4) + ", " + I.GRID + """,
big AS (SELECT date, component, cell_count FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cell_count DESC, component) AS rn FROM sized WHERE cell_count > 4) WHERE rn = 1),
ob AS (SELECT b.date, cell_count, delta, lon, lat, greatest(-delta, 0) AS w FROM big b JOIN lab l ON l.date = b.date AND l.component = b.component JOIN delta d ON d.date = l.date AND d.y = l.y AND d.x = l.x JOIN grid g ON g.y = l.y AND g.x = l.x),
loc AS (SELECT date, any_value(cell_count) AS n_grid_cells, round(sum(w * lon) / sum(w), 6) + 0.0 AS center_lon, round(sum(w * lat) / sum(w), 6) + 0.0 AS center_lat, min(delta) AS min_change, round(avg(delta), 6) + 0.0 AS mean_change FROM ob GROUP BY 1)
"""


@query("top_01_07_locate_events", LOCATE + ", " + I.PANF + " SELECT pan_event_id, event_date, loc.date IS NOT NULL AS found, n_grid_cells, center_lon, center_lat, min_change, mean_change FROM panf LEFT JOIN loc ON loc.date = event_date")
def _(spark, sf):
    from ..operators import locate
    out = locate.locate_events(I.pan_frames(spark, sf), I.field(spark, sf), I.grid(spark, sf), days=3, threshold=THR, min_cells=4)
    return out.select("pan_event_id", "event_date", "found", "n_grid_cells", R("center_lon").alias("center_lon"), R("center_lat").alias("center_lat"), "min_change", R("mean_change").alias("mean_change"))


@query("top_02_strongest_object", I.with_ctes("patch") + " SELECT region, date, object_id FROM (SELECT *, row_number() OVER (PARTITION BY region, date, window_days, threshold ORDER BY cumulative_sic_loss DESC, object_id) AS rn FROM patch) WHERE rn = 1")
def _(spark, sf):
    from ..operators import locate
    return locate.strongest(I.patches(spark, sf)).select("region", "date", "object_id")


LAEA = """, le AS (SELECT sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257223563::DOUBLE AS f)), lq AS (SELECT g.*, e, sin(radians(lat)) AS s, e * e AS e2 FROM grid g, le WHERE region_code BETWEEN 1 AND 18),
lr AS (SELECT *, 6378137.0::DOUBLE * sqrt(greatest((1 - e2) * (1 / (1 - e2) - 1 / (2 * e) * ln((1 - e) / (1 + e))) - (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * ln((1 - e * s) / (1 + e * s))), 0)) AS rho FROM lq),
lx AS (SELECT *, rho * sin(radians(lon)) AS ex, -rho * cos(radians(lon)) AS ey FROM lr), lc AS (SELECT *, avg(ex) OVER w AS cx, avg(ey) OVER w AS cy, count(*) OVER w AS cells FROM lx WINDOW w AS (PARTITION BY region_code)),
lk AS (SELECT *, row_number() OVER (PARTITION BY region_code ORDER BY round((pow(ex - cx, 2) + pow(ey - cy, 2)) / 1e6, 3), y, x) AS rn FROM lc)"""


@query("top_05_region_medoid", I.with_ctes("grid") + LAEA + " SELECT region_code, y, x, cells FROM lk WHERE rn = 1")
def _(spark, sf):
    m = RA.region_medoid(I.grid(spark, sf), codes=list(range(1, 19)))
    return m.select("region_code", "y", "x", "cells")


@query("ras_15_perimeter", PATCH + """ SELECT a.date, a.label_id, count(*) AS edges FROM pc a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM pc b WHERE b.date = a.date AND b.label_id = a.label_id AND b.y = a.y + dy AND b.x = a.x + dx) GROUP BY 1, 2""")
def _(spark, sf):
    e = RA.perimeter_edges(patch_cells(spark, sf).select("date", "label_id", "y", "x"), ["date", "label_id"])
    return e.groupBy("date", "label_id").agg(F.count(F.lit(1)).alias("edges"))


@query("agg_44_extent_per_date", I.with_ctes("coded", "field", "grid") + """, a AS (SELECT date, sum(CASE WHEN code = 1 THEN area_km2 ELSE 0 END) AS e1 FROM coded c JOIN grid g USING (y, x) GROUP BY 1),
b AS (SELECT date, sum(CASE WHEN value >= 0.15 AND region_code <= 18 THEN area_km2 ELSE 0 END) AS e2 FROM field f JOIN grid g USING (y, x) GROUP BY 1)
SELECT a.date, a.e1 / 1e6 AS coded_extent, b.e2 / 1e6 AS field_extent, round((a.e1 - p.e1) / 1e6, 9) + 0.0 AS change_3d FROM a JOIN b USING (date) LEFT JOIN a p ON p.date = a.date - 3""")
def _(spark, sf):
    from ..operators import budget
    g = I.grid(spark, sf)
    a = budget.extent_by_date(I.coded(spark, sf), g, F.col("code") == 1, "coded_extent")
    b = budget.extent_by_date(I.field(spark, sf), g, (F.col("value") >= 0.15) & (F.col("region_code") <= 18), "field_extent")
    before = a.select(F.date_add("date", 3).alias("date"), F.col("coded_extent").alias("p"))
    return a.join(b, "date").join(before, "date", "left").select("date", "coded_extent", "field_extent", R(F.col("coded_extent") - F.col("p"), 9).alias("change_3d"))


_A, _B = fixed.GRID_SEMI_MAJOR_M, fixed.GRID_SEMI_MINOR_M
PS = I.with_ctes("ev") + f""", k AS (SELECT sqrt(1 - pow({_B}::DOUBLE / {_A}::DOUBLE, 2)) AS e, radians(70.0::DOUBLE) AS ts), f AS (SELECT unique_local_event_id AS event_id, radians(track_centroid_lat) AS p, radians(track_centroid_lon + 45.0::DOUBLE) AS l, e, ts FROM ev, k),
t AS (SELECT *, tan(pi() / 4 - p / 2) / pow((1 - e * sin(p)) / (1 + e * sin(p)), e / 2) AS t, tan(pi() / 4 - ts / 2) / pow((1 - e * sin(ts)) / (1 + e * sin(ts)), e / 2) AS tt, cos(ts) / sqrt(1 - pow(e * sin(ts), 2)) AS mc FROM f),
q AS (SELECT event_id, {_A}::DOUBLE * mc * t / tt * sin(l) AS px, -{_A}::DOUBLE * mc * t / tt * cos(l) AS py FROM t)"""


@query("sca_03_projection", PS + f" SELECT event_id, round(px, 3) + 0.0 AS px, round(py, 3) + 0.0 AS py, round((degrees(atan2(px, -py)) - 45 + 180 + 360) % 360 - 180, 6) + 0.0 AS sphere_lon, round(degrees(pi() / 2 - 2 * atan(sqrt(px * px + py * py) * sqrt((1 + sin(radians(70))) / (1 - sin(radians(70)))) / (2 * {_A}::DOUBLE))), 6) + 0.0 AS sphere_lat FROM q")
def _(spark, sf):
    x, y = G.stereographic_forward("track_centroid_lon", "track_centroid_lat")
    p = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), x.alias("px"), y.alias("py"))
    slon, slat = G.stereographic_inverse_sphere("px", "py", fixed.GRID_SEMI_MAJOR_M)
    return p.select("event_id", R("px", 3).alias("px"), R("py", 3).alias("py"), R(slon).alias("sphere_lon"), R(slat).alias("sphere_lat"))


@query("sca_03_round_trip", PS + " SELECT event_id, round(track_centroid_lat, 6) + 0.0 AS lat FROM q JOIN ev ON unique_local_event_id = event_id")
def _(spark, sf):
    x, y = G.stereographic_forward("track_centroid_lon", "track_centroid_lat")
    p = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), x.alias("px"), y.alias("py"))
    return p.select("event_id", R(G.stereographic_inverse("px", "py")[1]).alias("lat"))
