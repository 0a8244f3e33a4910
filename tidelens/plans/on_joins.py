"""Join queries JOI-01..21 and the predicates FLT-05..12, FLT-15/16."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import fixed, scalar as S
from ..operators import joins as J, ordered
from ..sources import catalog
from . import inputs as I
from .registry import query

R = S.rounded
HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"


def hav(a: str, b: str) -> str:
    return HAV.format(a=a, b=b)


def ev_frame(spark, sf):
    return catalog.as_match_frame(I.events(spark, sf), "severe")


EVF = """evf AS (SELECT unique_local_event_id AS event_id, dominant_region AS region, event_start AS event_date, track_centroid_lon AS lon, track_centroid_lat AS lat FROM ev),
pnf AS (SELECT event_id, region, event_date, centroid_lon AS lon, centroid_lat AS lat FROM pan)"""
# ring of five regions: each touches the next
ADJ = "adj AS (SELECT 'R' || n AS a, 'R' || ((n + 1) % 5) AS b FROM (SELECT range AS n FROM range(0, 5)))"


def adjacency(spark):
    return spark.createDataFrame([(f"R{i}", f"R{(i + 1) % 5}") for i in range(5)], "a string, b string")


@query("joi_01_location_by_date", I.with_ctes("pan", "daily") + " SELECT event_id, event_date, count(series_id) AS n_series, round(sum(value), 6) + 0.0 AS total FROM pan LEFT JOIN daily ON event_date = date GROUP BY 1, 2")
def _(spark, sf):
    d = I.daily(spark, sf).withColumnRenamed("date", "event_date")
    return I.pan(spark, sf).join(d, "event_date", "left").groupBy("event_id", "event_date").agg(F.count("series_id").alias("n_series"), R(F.sum("value")).alias("total"))


@query("joi_02_checked_join", I.with_ctes("ev", "lagged") + " SELECT l.event_id, lag, buffer_km, dominant_region, cumulative_loss FROM lagged l JOIN ev ON l.event_id = unique_local_event_id")
def _(spark, sf):
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), "dominant_region", "cumulative_loss")
    return J.checked_join(I.lagged(spark, sf).select("event_id", "lag", "buffer_km"), e, ["event_id"])


COUNTS = """a AS (SELECT dominant_region AS region, duration_days AS d, count(*) AS n FROM ev WHERE cumulative_loss > 300 GROUP BY 1, 2),
b AS (SELECT dominant_region AS region, duration_days AS d, count(*) AS n FROM ev WHERE cumulative_loss > 400 AND duration_days > 1 GROUP BY 1, 2)"""


def _counts(spark, sf):
    e = I.events(spark, sf).withColumnRenamed("dominant_region", "region").withColumnRenamed("duration_days", "d")
    count = lambda x: x.groupBy("region", "d").agg(F.count(F.lit(1)).alias("n"))
    return count(e.filter("cumulative_loss > 300")), count(e.filter("cumulative_loss > 400 and d > 1"))


@query("joi_03_paired_tables", I.with_ctes("ev") + ", " + COUNTS + """ SELECT coalesce(a.region, b.region) AS region, coalesce(a.d, b.d) AS d, a.n AS primary_n, b.n AS floor_n,
  CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'both' WHEN a.n IS NOT NULL THEN 'primary' ELSE 'floor' END AS seen_in FROM a FULL OUTER JOIN b ON a.region = b.region AND a.d = b.d""")
def _(spark, sf):
    return J.paired_tables(*_counts(spark, sf), ["region", "d"])


@query("joi_04_count_comparison", I.with_ctes("ev") + ", " + COUNTS + """ SELECT coalesce(a.region, b.region) AS region, coalesce(a.d, b.d) AS d, coalesce(a.n, 0) AS "primary", coalesce(b.n, 0) AS floor,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS difference, CASE WHEN a.n > 0 THEN round((coalesce(b.n, 0) - a.n) / CAST(a.n AS DOUBLE), 6) + 0.0 END AS relative_change FROM a FULL OUTER JOIN b ON a.region = b.region AND a.d = b.d""")
def _(spark, sf):
    return J.count_comparison(*_counts(spark, sf), ["region", "d"]).withColumn("relative_change", R("relative_change"))


@query("joi_05_missed_events", I.with_ctes("ev", "pan") + ", " + EVF + " SELECT event_id, event_date FROM evf WHERE NOT EXISTS (SELECT 1 FROM pnf WHERE abs(pnf.event_date - evf.event_date) <= 3)")
def _(spark, sf):
    return J.missing_near_day(ev_frame(spark, sf), I.pan(spark, sf), 3).select("event_id", "event_date")


@query("joi_06_semi_join", I.with_ctes("member", "pcell") + " SELECT unique_local_event_id, object_id FROM member WHERE object_id IN (SELECT object_id FROM pcell WHERE delta <= -0.3)")
def _(spark, sf):
    deep = I.patch_cells(spark, sf).filter("delta <= -0.3").select("object_id")
    return I.members(spark, sf).join(deep, "object_id", "left_semi").select("unique_local_event_id", "object_id")


@query("joi_07_day_range_match", I.with_ctes("ev", "pan") + ", " + EVF + " SELECT event_id, EXISTS (SELECT 1 FROM pnf WHERE abs(pnf.event_date - evf.event_date) <= 3) AS matched FROM evf")
def _(spark, sf):
    return J.flag_near_day(ev_frame(spark, sf), I.pan(spark, sf), 3, "matched").select("event_id", "matched")


@query("joi_08_day_region_match", I.with_ctes("ev", "pan") + ", " + EVF + ", " + ADJ + """ SELECT event_id, EXISTS (SELECT 1 FROM pnf WHERE abs(pnf.event_date - evf.event_date) <= 3
  AND (pnf.region = evf.region OR EXISTS (SELECT 1 FROM adj WHERE a = evf.region AND b = pnf.region))) AS matched FROM evf""")
def _(spark, sf):
    return J.flag_near_day_region(ev_frame(spark, sf), I.pan(spark, sf), adjacency(spark), 3, "matched").select("event_id", "matched")


@query("joi_09_day_radius_nearest", I.with_ctes("ev", "pan") + ", " + EVF + f""", p AS (SELECT e.event_id, {hav('e.', 'q.')} AS km FROM evf e JOIN pnf q ON abs(q.event_date - e.event_date) <= 30)
SELECT evf.event_id, round(min(km), 6) + 0.0 AS nearest_km FROM evf LEFT JOIN p ON evf.event_id = p.event_id AND km <= 1500 GROUP BY 1""")
def _(spark, sf):
    out = J.nearest_within(ev_frame(spark, sf), I.pan(spark, sf), 30, 1500.0)
    return out.select("event_id", R("nearest_km_30d").alias("nearest_km"))


MATRIX = I.with_ctes("ev", "pan") + ", " + EVF + ", " + ADJ + f""",
fr AS (SELECT 'events' AS s, 'pan' AS t, * FROM evf UNION ALL SELECT 'pan', 'events', * FROM pnf),
tg AS (SELECT 'pan' AS t, * FROM pnf UNION ALL SELECT 'events', * FROM evf),
c AS (SELECT fr.s, fr.t, fr.event_id, abs(tg.event_date - fr.event_date) AS gap, fr.region = tg.region OR adj.a IS NOT NULL AS reg, {hav('fr.', 'tg.')} AS km
  FROM fr JOIN tg ON fr.t = tg.t AND abs(tg.event_date - fr.event_date) <= 3 LEFT JOIN adj ON adj.a = fr.region AND adj.b = tg.region),
rules AS (SELECT tol, kind, r FROM (VALUES (0), (1), (3)) v(tol), (VALUES ('time-only', NULL), ('time+region', NULL), ('time+centroid_300km', 300), ('time+centroid_500km', 500)) k(kind, r)),
hits AS (SELECT s, t, kind || '_pm' || tol || 'd' AS rule, event_id, min(CASE WHEN r IS NOT NULL THEN km END) AS km FROM c, rules
  WHERE gap <= tol AND (kind <> 'time+region' OR reg) AND (r IS NULL OR km <= r) GROUP BY 1, 2, 3, 4),
tot AS (SELECT s, t, count(*) AS denominator FROM fr GROUP BY 1, 2)
SELECT tot.s AS source, tot.t AS target, kind || '_pm' || tol || 'd' AS rule, count(h.event_id) AS numerator, any_value(denominator) AS denominator, round(count(h.event_id) / CAST(any_value(denominator) AS DOUBLE), 6) + 0.0 AS ratio,
  round(quantile_cont(h.km, 0.5), 4) + 0.0 AS median_km, round(quantile_cont(h.km, 0.9), 4) + 0.0 AS p90_km FROM tot CROSS JOIN rules LEFT JOIN hits h ON h.s = tot.s AND h.t = tot.t AND h.rule = kind || '_pm' || tol || 'd' GROUP BY 1, 2, 3"""


@query("joi_10_match_matrix", MATRIX)
def _(spark, sf):
    e, p = ev_frame(spark, sf), I.pan(spark, sf)
    m = J.match_matrix([("events", e, "pan", p), ("pan", p, "events", e)], adjacency(spark))
    return m.select("source", "target", "rule", "numerator", "denominator", R("ratio").alias("ratio"), R("median_km", 4).alias("median_km"), R("p90_km", 4).alias("p90_km"))


@query("joi_11_nearest_day", I.with_ctes("pan", "daily") + """, h AS (SELECT date FROM daily GROUP BY 1 HAVING min(value) > 0.3)
SELECT event_id, event_date, (SELECT date FROM h ORDER BY abs(date - event_date), date LIMIT 1) AS nearest FROM pan""")
def _(spark, sf):
    p = I.pan(spark, sf)
    have = I.daily(spark, sf).groupBy("date").agg(F.min("value").alias("value")).filter("value > 0.3")
    m = J.nearest_day_map(p, have.withColumnRenamed("date", "event_date"), "event_date")
    return p.join(m, "event_date", "left").select("event_id", "event_date", "nearest")


@query("joi_12_nearest_latlon_node", I.with_ctes("ev", "met") + """, n AS (SELECT DISTINCT lat, lon FROM met)
SELECT unique_local_event_id AS event_id, CAST(least(9, greatest(0, round_even((track_centroid_lat + 0.25 - 50) / 4, 0))) AS INTEGER) AS i, CAST(round_even(((track_centroid_lon + 180) % 360) / 20, 0) AS INTEGER) % 18 AS j, round(m.msl, 4) + 0.0 AS msl
FROM ev LEFT JOIN met m ON m.date = DATE '1995-01-01' + CAST(CAST(unique_local_event_id[2:] AS BIGINT) % 28 AS INTEGER) AND m.lat = 50 + 4 * least(9, greatest(0, round_even((track_centroid_lat + 0.25 - 50) / 4, 0))) AND m.lon = -180 + 20 * (CAST(round_even(((track_centroid_lon + 180) % 360) / 20, 0) AS INTEGER) % 18)""")
def _(spark, sf):
    i, j = J.nearest_latlon_cell("track_centroid_lon", F.col("track_centroid_lat") + 0.25, -180.0, 50.0, 20.0, 4.0, 18, 10)
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.substring("unique_local_event_id", 2, 20).cast("bigint") % 28).cast("int"))
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), i.alias("i"), j.alias("j"), day.alias("date"))
    m = I.met(spark, sf).select("date", "i", "j", "msl")
    return e.join(m, ["date", "i", "j"], "left").select("event_id", "i", "j", R("msl", 4).alias("msl"))


PTS = """pts AS (SELECT 'PAN' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS point_id, DATE '1995-01-01' + CAST(s_suppkey % 22 + 5 AS INTEGER) AS event_date,
  (s_suppkey * 7 % 40) * 25000.0::DOUBLE - 500000.0::DOUBLE + 9000.0::DOUBLE AS px_m, 300000.0::DOUBLE - (s_suppkey * 3 % 25) * 25000.0::DOUBLE + 4000.0::DOUBLE AS py_m FROM supplier)"""


@query("joi_13_nearest_grid_sample", I.with_ctes("field") + ", " + PTS + """ SELECT point_id, value, value IS NOT NULL AS inside FROM pts LEFT JOIN field f ON f.date = event_date
  AND f.x = round_even((px_m + 500000) / 25000, 0) AND f.y = round_even((py_m - 300000) / -25000, 0)""")
def _(spark, sf):
    y, x = J.nearest_projected_cell("px_m", "py_m", -500000.0, 300000.0, 25000.0, -25000.0)
    p = I.plane_points(spark, sf).withColumn("y", y).withColumn("x", x).withColumnRenamed("event_date", "date")
    return p.join(I.field(spark, sf), ["date", "y", "x"], "left").select("point_id", "value", F.col("value").isNotNull().alias("inside"))


def windows(spark, sf, track):
    before, after = fixed.TRACKS[track]
    p = I.pan_frames(spark, sf)
    return p.select("pan_event_id", F.date_sub("event_date", before).alias("window_start"), F.date_add("event_date", after).alias("window_end"))


@query("joi_14_interval_members", I.with_ctes("panf", "member") + """ SELECT pan_event_id, unique_local_event_id, count(*) AS n FROM panf JOIN member m ON m.start_date <= event_date AND m.date >= event_date - 5 AND m.date <= event_date GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators import budget as B
    p = I.pan_frames(spark, sf)
    # events of one day share a window: relate and count per distinct window, attach events last
    per = B.aligned_members(p.select(F.col("event_date").alias("date")), I.members(spark, sf), "cdr").groupBy("window_date", "unique_local_event_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(per, F.col("event_date") == F.col("window_date")).select("pan_event_id", "unique_local_event_id", "n")


@query("joi_15_interval_exclusion", I.with_ctes("ev", "pan") + """ SELECT unique_local_event_id AS event_id, EXISTS (SELECT 1 FROM pan WHERE event_start - 5 <= event_date AND event_date - 5 <= event_start) AS excluded FROM ev""")
def _(spark, sf):
    w = I.pan(spark, sf).select(F.date_sub("event_date", 5).alias("window_start"), F.col("event_date").alias("window_end"))
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), F.date_sub("event_start", 5).alias("window_start"), F.col("event_start").alias("window_end"))
    return J.flag_overlap_any(e, w, "excluded").select("event_id", "excluded")


BUF = """pr AS (SELECT point_id, event_date, g.y, g.x, sqrt(pow(x_m - px_m, 2) + pow(y_m - py_m, 2)) / 1000 AS km FROM pts, grid g WHERE abs(x_m - px_m) <= 100000 AND abs(y_m - py_m) <= 100000),
want AS (SELECT point_id, event_date, lag, event_date + lag AS sample_date FROM pts, (VALUES (-3), (-1), (0), (1), (5)) l(lag)),
asks AS (SELECT point_id, sample_date FROM want UNION SELECT point_id, sample_date - 5 FROM want),
means AS (SELECT a.point_id, a.sample_date, r AS buffer_km, avg(value) AS mean, count(value) AS n_cells FROM asks a CROSS JOIN (VALUES (50), (100)) q(r)
  LEFT JOIN (SELECT pr.point_id, pr.km, f.date, f.value FROM pr JOIN field f ON f.y = pr.y AND f.x = pr.x) z ON z.point_id = a.point_id AND z.date = a.sample_date AND z.km <= r GROUP BY 1, 2, 3)"""


@query("joi_16_plane_buffer", I.with_ctes("field", "grid") + ", " + PTS + ", " + BUF + " SELECT point_id, sample_date, buffer_km, round(mean, 6) + 0.0 AS mean, n_cells FROM means")
def _(spark, sf):
    p = I.plane_points(spark, sf)
    pairs = J.plane_pairs(p, I.grid(spark, sf), 100.0)
    want = p.withColumn("lag", F.explode(F.array(*[F.lit(v) for v in (-3, -1, 0, 1, 5)]))).select("point_id", F.date_add("event_date", F.col("lag")).alias("sample_date"))
    asks = want.unionByName(want.select("point_id", F.date_sub("sample_date", 5).alias("sample_date"))).distinct()
    return J.buffer_means(pairs, asks, I.field(spark, sf), (50, 100)).withColumn("mean", R("mean"))


@query("joi_17_sphere_buffer", I.with_ctes("met", "pan") + f""", p AS (SELECT event_id AS point_id, DATE '1995-01-01' + CAST(CAST(event_id[4:] AS BIGINT) % 27 AS INTEGER) AS sample_date, centroid_lon AS lon, centroid_lat AS lat FROM pan),
z AS (SELECT p.point_id, m.msl, m.u10, m.v10, {hav('p.', 'm.')} AS km FROM p JOIN met m ON m.date = p.sample_date)
SELECT p.point_id, p.sample_date, r AS buffer_km, round(avg(msl) / 100, 4) + 0.0 AS msl_hpa, round(avg(u10), 6) + 0.0 AS u10, round(avg(v10), 6) + 0.0 AS v10, round(sqrt(pow(avg(u10), 2) + pow(avg(v10), 2)), 6) + 0.0 AS wspd10
FROM p CROSS JOIN (VALUES (500), (900)) q(r) LEFT JOIN z ON z.point_id = p.point_id AND z.km <= r GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = I.met_points(spark, sf)
    b = J.sphere_buffer_means(p, I.met(spark, sf), (500, 900))
    return b.select("point_id", "sample_date", "buffer_km", R("msl_hpa", 4).alias("msl_hpa"), R("u10").alias("u10"), R("v10").alias("v10"), R("wspd10").alias("wspd10"))


@query("joi_18_lag_buffers", I.with_ctes("field", "grid") + ", " + PTS + ", " + BUF + """ SELECT w.point_id, w.event_date, w.lag, a.buffer_km, round(a.mean, 6) + 0.0 AS mean_buffer, round(a.mean - b.mean, 6) + 0.0 AS change_buffer, a.n_cells AS valid_cells
FROM want w JOIN means a ON a.point_id = w.point_id AND a.sample_date = w.sample_date LEFT JOIN means b ON b.point_id = w.point_id AND b.sample_date = w.sample_date - 5 AND b.buffer_km = a.buffer_km""")
def _(spark, sf):
    p = I.plane_points(spark, sf)
    out = J.lag_buffers(p, J.plane_pairs(p, I.grid(spark, sf), 100.0), I.field(spark, sf), (-3, -1, 0, 1, 5), (50, 100))
    return out.select("point_id", "event_date", "lag", "buffer_km", R("mean_buffer").alias("mean_buffer"), R("change_buffer").alias("change_buffer"), "valid_cells")


@query("joi_19_displaced_points", I.with_ctes("ev") + """, ref AS (SELECT dominant_region AS sample_region, min(track_centroid_lon) AS ref_lon, min(track_centroid_lat) AS ref_lat FROM ev GROUP BY 1)
SELECT unique_local_event_id AS event_id, dominant_region AS region, sample_region, ref_lon, ref_lat FROM ev JOIN ref ON sample_region <> dominant_region""")
def _(spark, sf):
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), F.col("dominant_region").alias("region"), "track_centroid_lon", "track_centroid_lat")
    refs = e.groupBy("region").agg(F.min("track_centroid_lon").alias("ref_lon"), F.min("track_centroid_lat").alias("ref_lat"))
    return J.displaced_points(e, refs).select("event_id", "region", "sample_region", "ref_lon", "ref_lat")


@query("joi_24_overlap_flags", I.with_ctes("ev", "pan") + """, f AS (SELECT dominant_region, event_start, event_start IN (SELECT event_date FROM pan) AS d, EXISTS (SELECT 1 FROM pan WHERE region = dominant_region AND event_date = event_start) AS rd FROM ev)
SELECT dominant_region, bool_or(d) AS any_date, count(*) FILTER (d) AS n_date, count(*) FILTER (rd) AS n_region_date FROM f GROUP BY 1""")
def _(spark, sf):
    e, p = I.events(spark, sf), I.pan(spark, sf)
    e = J.flag_membership(e, p, {"event_start": "event_date"}, "d")
    e = J.flag_membership(e, p, {"dominant_region": "region", "event_start": "event_date"}, "rd")
    return e.groupBy("dominant_region").agg(F.bool_or("d").alias("any_date"), F.count_if("d").alias("n_date"), F.count_if("rd").alias("n_region_date"))


# ---- predicates -----------------------------------------------------------

@query("flt_05_patch_filter", I.with_ctes("patch") + " SELECT object_id FROM patch WHERE window_days = 3 AND abs(threshold + 0.1) <= 1e-8 + 1e-5 * 0.1 AND object_area_cells >= 20")
def _(spark, sf):
    return catalog.patch_filter(I.patches(spark, sf), 3, -0.1, 20).select("object_id")


@query("flt_06_box_membership", I.with_ctes("ev") + """, b(name, lo, hi, s, n) AS (VALUES ('bering_sea', 160, -160, 55, 67), ('kara_sea', 55, 100, 68, 82), ('central_arctic', -180, 180, 80, 90)),
x AS (SELECT *, (track_centroid_lon + 360) % 360 AS l, (lo + 360) % 360 AS l0, (hi + 360) % 360 AS l1 FROM ev, b)
SELECT unique_local_event_id AS event_id, name FROM x WHERE (abs(hi - lo) >= 360 OR CASE WHEN l0 <= l1 THEN l BETWEEN l0 AND l1 ELSE l >= l0 OR l <= l1 END) AND track_centroid_lat BETWEEN s AND n""")
def _(spark, sf):
    names = ("bering_sea", "kara_sea", "central_arctic")
    inside = F.array_compact(F.array(*[F.when(S.in_box("track_centroid_lon", "track_centroid_lat", *fixed.REGION_BOUNDS[n]), F.lit(n)) for n in names]))
    return I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), F.explode(inside).alias("name"))


@query("flt_07_mask_membership", I.with_ctes("grid") + ", " + PTS + """ SELECT point_id, coalesce(region_code BETWEEN 1 AND 9, false) AS member FROM pts LEFT JOIN grid g
  ON g.x = round_even((px_m + 500000) / 25000, 0) AND g.y = round_even((py_m - 300000) / -25000, 0)""")
def _(spark, sf):
    return catalog.mask_membership(I.plane_points(spark, sf), I.grid(spark, sf), tuple(range(1, 10)), -500000.0, 300000.0, 25000.0, -25000.0).select("point_id", "member")


@query("flt_08_region_names", """WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Baffin Bay' WHEN 'BUILDING' THEN 'kara-sea' WHEN 'FURNITURE' THEN '-20,100,60,85' ELSE 'arctic' END AS word FROM customer)
SELECT c_custkey, CASE word WHEN 'Baffin Bay' THEN 'baffin_and_labrador_seas' WHEN 'kara-sea' THEN 'kara_sea' WHEN 'arctic' THEN 'pan_arctic' ELSE 'custom_bbox' END AS name,
 CASE word WHEN 'Baffin Bay' THEN -80.0::DOUBLE WHEN 'kara-sea' THEN 55.0::DOUBLE WHEN 'arctic' THEN -180.0::DOUBLE ELSE -20.0::DOUBLE END AS lon_min FROM t""")
def _(spark, sf):
    seg = F.col("c_mktsegment")
    word = S.ladder([(seg == "AUTOMOBILE", "Baffin Bay"), (seg == "BUILDING", "kara-sea"), (seg == "FURNITURE", "-20,100,60,85")], "arctic")
    return catalog.resolve_regions(I.table(spark, sf, "customer").select("c_custkey", word.alias("word")), "word").select("c_custkey", F.col("region_name").alias("name"), "lon_min")


@query("flt_09_ocean_mask", I.with_ctes("grid") + " SELECT y, x, region_code BETWEEN 0 AND 18 AS ocean FROM grid")
def _(spark, sf):
    return catalog.ocean_mask(I.grid(spark, sf)).select("y", "x", "ocean")


@query("flt_10_detection_domain", I.with_ctes("met") + " SELECT date, lat, lon FROM met WHERE lat BETWEEN 60 AND 85 AND (lon + 360) % 360 BETWEEN 0 AND 100")
def _(spark, sf):
    return I.met(spark, sf).filter(S.in_box("lon", "lat", 0, 100, 60, 85)).select("date", "lat", "lon")


@query("flt_11_start_floor", I.with_ctes("field") + """ SELECT coalesce(CAST(f AS VARCHAR), 'none') AS scenario, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM field, (VALUES (NULL), (0.15::DOUBLE), (0.3::DOUBLE)) v(f) WHERE f IS NULL OR value >= f GROUP BY 1""")
def _(spark, sf):
    x = catalog.with_floors(I.field(spark, sf), "value", (None, 0.15, 0.3))
    return x.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value")).alias("total"))


@query("flt_12_first_n_per_region", I.with_ctes("ev") + " SELECT dominant_region, unique_local_event_id FROM (SELECT *, row_number() OVER (PARTITION BY dominant_region ORDER BY event_start, unique_local_event_id) AS rn FROM ev) WHERE rn <= 5")
def _(spark, sf):
    return catalog.first_per_group(I.events(spark, sf), ["dominant_region"], ["event_start", "unique_local_event_id"], 5).select("dominant_region", "unique_local_event_id")


@query("flt_15_readable_window", I.with_ctes("ev", "field") + """ SELECT unique_local_event_id AS event_id FROM ev WHERE DATE '1995-01-01' + CAST(event_start - DATE '1995-01-01' AS INTEGER) % 40 IN (SELECT date FROM field)
  AND DATE '1995-01-01' + CAST(event_start - DATE '1995-01-01' AS INTEGER) % 40 - 5 IN (SELECT date FROM field)""")
def _(spark, sf):
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), I.plus_days(F.datediff("event_start", F.lit("1995-01-01").cast("date")) % 40).alias("anchor"))
    return catalog.readable(e, I.field(spark, sf), "anchor", 5).select("event_id")


@query("flt_16_catalogue_range", I.with_ctes("ev") + """ SELECT unique_local_event_id AS event_id, coalesce(CASE WHEN dominant_region <> 'R2' THEN dominant_region END, 'unknown') AS region FROM ev WHERE year(event_start) BETWEEN 1995 AND 1996 AND month(event_start) IN (6, 7, 8)""")
def _(spark, sf):
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), F.when(F.col("dominant_region") != "R2", F.col("dominant_region")).alias("region"), F.col("event_start").alias("date"))
    return catalog.in_range(e, "date", 1995, 1996, "jja").select("event_id", "region")
