"""Budget queries: AGG-16..31/40/41/43, RAS-12..14/18..21, JOI-22/25/26, STA-12, EVI-08."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scalar as S
from ..operators import budget as B, raster as RA
from . import inputs as I, walks as WK
from .on_raster import label_sql
from .registry import query

R = S.rounded
N3 = lambda c: f"round({c}, 3) + 0.0 AS {c}"


def rr(cols, digits=6):
    return [R(c, digits).alias(c) for c in cols]


def dates(spark, sf):
    return I.pan_frames(spark, sf).select(F.col("event_date").alias("date")).distinct()


def cells(spark, sf, **kw):
    return B.change_cells(I.field(spark, sf), I.grid(spark, sf), 5, dates(spark, sf), **kw)


CELLS = """cc AS (SELECT e.date, e.y, e.x, s.value AS start_value, e.value - s.value AS delta, greatest(s.value - e.value, 0) AS loss, greatest(e.value - s.value, 0) AS gain, area_km2, region_code
  FROM field e JOIN field s ON s.y = e.y AND s.x = e.x AND s.date = e.date - 5 JOIN grid g ON g.y = e.y AND g.x = e.x WHERE region_code <= 18 AND e.date IN (SELECT event_date FROM panf))"""
BASE = I.with_ctes("field", "grid", "panf") + ", " + CELLS
RB = ", rb AS (SELECT date, region_code, sum(loss * area_km2) AS loss, sum(gain * area_km2) AS gain, sum(delta * area_km2) AS signed, sum(area_km2) AS valid_area, sum(start_value * area_km2) AS initial, count(*) AS cells FROM cc GROUP BY 1, 2)"


def rb(spark, sf):
    return B.region_window_budget(cells(spark, sf))


@query("agg_17_region_window_loss", BASE + RB + " SELECT date, region_code, round(loss, 6) + 0.0 AS loss, round(gain, 6) + 0.0 AS gain, valid_area, round(initial, 6) + 0.0 AS initial, cells FROM rb")
def _(spark, sf):
    return rb(spark, sf).select("date", "region_code", *rr(["loss", "gain"]), "valid_area", R("initial").alias("initial"), "cells")


@query("agg_19_field_budget", BASE + RB + """ SELECT pan_event_id, round(sum(loss), 6) + 0.0 AS gross_loss, round(sum(gain), 6) + 0.0 AS gross_gain, round(sum(signed), 6) + 0.0 AS signed_change, 'PASS' AS closure_status FROM panf JOIN rb ON date = event_date GROUP BY 1""")
def _(spark, sf):
    b = B.field_budget(B.region_window_budget(cells(spark, sf, stored_as_float=True)))
    return I.pan_frames(spark, sf).join(b, F.col("event_date") == F.col("date")).select("pan_event_id", *rr(["gross_loss", "gross_gain", "signed_change"]), "closure_status")


@query("agg_21_dense_region_budget", BASE + RB + " SELECT pan_event_id, CAST(c.range AS INTEGER) AS region_code, round(coalesce(loss, 0), 6) + 0.0 AS loss, round(coalesce(gain, 0), 6) + 0.0 AS gain FROM panf CROSS JOIN range(0, 19) c LEFT JOIN rb ON rb.date = event_date AND rb.region_code = c.range")
def _(spark, sf):
    return B.dense_region_budget(I.pan_frames(spark, sf), rb(spark, sf)).select("pan_event_id", "region_code", *rr(["loss", "gain"]))


@query("agg_22_budget_accounting", BASE + RB + """ SELECT pan_event_id, round(sum(loss), 6) + 0.0 AS gross_loss, round(sum(CASE WHEN region_code BETWEEN 1 AND 18 THEN loss ELSE 0 END), 6) + 0.0 AS codes_loss,
 round(sum(CASE WHEN region_code = 0 THEN loss ELSE 0 END), 6) + 0.0 AS unassigned_loss, CASE WHEN sum(loss) > 0 THEN round(sum(CASE WHEN region_code = 0 THEN loss ELSE 0 END) / sum(loss), 6) + 0.0 END AS unassigned_fraction FROM panf JOIN rb ON date = event_date GROUP BY 1""")
def _(spark, sf):
    b = rb(spark, sf)
    tot = I.pan_frames(spark, sf).join(B.field_budget(b), F.col("event_date") == F.col("date")).select("pan_event_id", "gross_loss")
    named = B.dense_region_budget(I.pan_frames(spark, sf), b, range(1, 19))
    return B.budget_accounting(tot, named).select("pan_event_id", *rr(["gross_loss", "codes_loss", "unassigned_loss", "unassigned_fraction"]))


CLASSES = """, wd AS (SELECT DISTINCT event_date FROM panf), am AS (SELECT DISTINCT event_date AS date, object_id, level, unique_local_event_id FROM wd JOIN member m ON m.start_date <= event_date + {a} AND m.date BETWEEN event_date - {b} AND event_date + {a}),
kc AS (SELECT am.date, p.y, p.x, max(level) AS class, bool_or(level = 1) AS has_broad, bool_or(level = 2) AS has_severe, bool_or(level = 3) AS has_major FROM am JOIN pcell p USING (object_id) GROUP BY 1, 2, 3)"""
CDR = CLASSES.format(a=0, b=5)
DET = CLASSES.format(a=1, b=2)
BASE2 = I.with_ctes("field", "grid", "panf", "member", "pcell") + ", " + CELLS + RB


def classes(spark, sf, track):
    return B.class_cells(dates(spark, sf), I.members(spark, sf), I.patch_cells(spark, sf), track)


for _track, _sql in (("cdr", CDR), ("detector", DET)):
    @query(f"ras_12_class_partition_{_track}", BASE2 + _sql + " SELECT date, class, count(*) AS n, sum(y * 1000 + x) AS position_sum FROM kc GROUP BY 1, 2")
    def _(spark, sf, track=_track):
        return classes(spark, sf, track).groupBy("date", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 1000 + F.col("x")).alias("position_sum"))


@query("ras_13_overlap_audit", BASE2 + CDR + """, ng AS (SELECT count(*) AS n FROM grid) SELECT date, count(*) FILTER (has_major) AS raw_major, count(*) FILTER (has_severe) AS raw_severe, count(*) FILTER (has_broad) AS raw_broad, count(*) FILTER (has_major AND has_severe) AS major_severe_overlap,
 count(*) FILTER (has_major AND has_broad) AS major_broad_overlap, count(*) FILTER (has_severe AND has_broad) AS severe_broad_overlap, count(*) FILTER (has_major AND has_severe AND has_broad) AS triple_overlap, count(*) AS union_cells, any_value(ng.n) - count(*) AS class_0, 'PASS' AS status FROM kc, ng GROUP BY 1""")
def _(spark, sf):
    n = I.grid(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    a = B.class_overlap_audit(classes(spark, sf, "cdr"), n)
    return a.select("date", "raw_major", "raw_severe", "raw_broad", "major_severe_overlap", "major_broad_overlap", "severe_broad_overlap", "triple_overlap", "union_cells", "class_0", "status")


@query("ras_21_one_class_cells", BASE2 + CDR + " SELECT date, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM kc WHERE class = 3")
def _(spark, sf):
    return classes(spark, sf, "cdr").filter("class = 3").select("date", "y", "x")


CB = ", ".join(f"round(sum(CASE WHEN k = {i} THEN l ELSE 0 END), 6) + 0.0 AS loss_{n}, round(sum(CASE WHEN k = {i} THEN g ELSE 0 END), 6) + 0.0 AS gain_{n}, CASE WHEN sum(l) > 0 THEN round(sum(CASE WHEN k = {i} THEN l ELSE 0 END) / sum(l), 6) + 0.0 END AS loss_fraction_{n}"
               for i, n in enumerate(("residual", "broad_nonsevere", "severe_nonmajor", "major_severe")))
CBT = ", round(sum(l), 6) + 0.0 AS gross_loss, round(sum(g), 6) + 0.0 AS gross_gain, 'PASS' AS closure_status, CASE WHEN sum(l) > 0 THEN round(sum(g) / sum(l), 6) + 0.0 END AS compensation_ratio, CASE WHEN sum(l) > 0 THEN round((sum(l) - sum(g)) / sum(l), 6) + 0.0 END AS net_loss_efficiency"
_CB_COLS = [f"{p}_{n}" for n in ("residual", "broad_nonsevere", "severe_nonmajor", "major_severe") for p in ("loss", "gain", "loss_fraction")] + ["gross_loss", "gross_gain"]


@query("agg_20_class_budget_field", BASE2 + CDR + f", j AS (SELECT cc.date, coalesce(class, 0) AS k, loss * area_km2 AS l, gain * area_km2 AS g FROM cc LEFT JOIN kc ON kc.date = cc.date AND kc.y = cc.y AND kc.x = cc.x) SELECT pan_event_id, {CB}{CBT} FROM panf JOIN j ON date = event_date GROUP BY 1")
def _(spark, sf):
    a = F.col("area_km2")
    b = B.class_budget(cells(spark, sf), classes(spark, sf, "cdr"), F.col("loss") * a, F.col("gain") * a)
    return I.pan_frames(spark, sf).join(b, F.col("event_date") == F.col("date")).select("pan_event_id", *rr(_CB_COLS), "closure_status", *rr(["compensation_ratio", "net_loss_efficiency"]))


TRANS = """, tr AS (SELECT e.date - 1 AS date, e.y, e.x, s.code AS s, e.code AS e, area_km2, region_code FROM coded e JOIN coded s ON s.y = e.y AND s.x = e.x AND s.date = e.date - 3 JOIN grid g ON g.y = e.y AND g.x = e.x WHERE e.date - 1 IN (SELECT event_date FROM panf)),
tf AS (SELECT *, s = 1 AND e = 0 AS is_loss, s = 0 AND e = 1 AS is_gain, NOT (s IN (0, 1) AND e IN (0, 1)) AND s = 1 AND e <> 1 AS sl, NOT (s IN (0, 1) AND e IN (0, 1)) AND s <> 1 AND e = 1 AS sg FROM tr)"""
BASE3 = I.with_ctes("field", "grid", "coded", "panf", "member", "pcell")


def transitions(spark, sf):
    return B.code_transitions(I.coded(spark, sf), I.grid(spark, sf), 2, 1, dates(spark, sf))


@query("agg_18_transition_budget", BASE3 + TRANS + """, b AS (SELECT date, sum(CASE WHEN is_loss THEN area_km2 ELSE 0 END) AS gross_loss, sum(CASE WHEN is_gain THEN area_km2 ELSE 0 END) AS gross_gain, sum(CASE WHEN sl THEN area_km2 ELSE 0 END) AS status_loss, sum(CASE WHEN sg THEN area_km2 ELSE 0 END) AS status_gain,
 sum(CASE WHEN e = 1 THEN area_km2 ELSE 0 END) - sum(CASE WHEN s = 1 THEN area_km2 ELSE 0 END) AS extent_delta, sum(CASE WHEN s = 255 OR e = 255 THEN area_km2 ELSE 0 END) AS missing_touch, sum(CASE WHEN s IN (253, 254) OR e IN (253, 254) THEN area_km2 ELSE 0 END) AS other_touch FROM tf GROUP BY 1)
SELECT pan_event_id, gross_loss, gross_gain, status_loss, status_gain, extent_delta, missing_touch, other_touch, round(gross_gain - gross_loss + status_gain - status_loss - extent_delta, 6) + 0.0 AS closure_error, CASE WHEN abs(gross_gain - gross_loss + status_gain - status_loss - extent_delta) <= 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM panf JOIN b ON date = event_date""")
def _(spark, sf):
    b = B.transition_budget(transitions(spark, sf))
    return I.pan_frames(spark, sf).join(b, F.col("event_date") == F.col("date")).select("pan_event_id", "gross_loss", "gross_gain", "status_loss", "status_gain", "extent_delta", "missing_touch", "other_touch", R("closure_error").alias("closure_error"), "status")


@query("agg_20_class_budget_coded", BASE3 + DET + TRANS + f", j AS (SELECT tf.date, coalesce(class, 0) AS k, CASE WHEN is_loss THEN area_km2 ELSE 0 END AS l, CASE WHEN is_gain THEN area_km2 ELSE 0 END AS g FROM tf LEFT JOIN kc ON kc.date = tf.date AND kc.y = tf.y AND kc.x = tf.x) SELECT pan_event_id, {CB}{CBT} FROM panf JOIN j ON date = event_date GROUP BY 1")
def _(spark, sf):
    a = F.col("area_km2")
    b = B.class_budget(transitions(spark, sf), classes(spark, sf, "detector"), F.when(F.col("is_loss"), a).otherwise(0.0), F.when(F.col("is_gain"), a).otherwise(0.0))
    return I.pan_frames(spark, sf).join(b, F.col("event_date") == F.col("date")).select("pan_event_id", *rr(_CB_COLS), "closure_status", *rr(["compensation_ratio", "net_loss_efficiency"]))


# ---- domains ---------------------------------------------------------------------

DOM = BASE2 + CDR + """, own AS (SELECT DISTINCT pan_event_id, date, y, x FROM panf JOIN kc ON date = event_date WHERE class = 3),
src AS (SELECT DISTINCT pan_event_id, event_region_code AS region_code FROM panf JOIN member m ON m.start_date <= event_date AND m.date BETWEEN event_date - 5 AND event_date WHERE level = 3),
j AS (SELECT p.pan_event_id, cc.*, own.y IS NOT NULL AS local, cc.region_code BETWEEN 1 AND 18 AND src.region_code IS NULL AS other FROM panf p JOIN cc ON cc.date = p.event_date LEFT JOIN own ON own.pan_event_id = p.pan_event_id AND own.y = cc.y AND own.x = cc.x LEFT JOIN src ON src.pan_event_id = p.pan_event_id AND src.region_code = cc.region_code),
dm AS (SELECT pan_event_id, sum(loss * area_km2) AS global_loss, sum(gain * area_km2) AS global_gain, sum(CASE WHEN local THEN loss * area_km2 ELSE 0 END) AS local_loss, sum(CASE WHEN NOT local THEN loss * area_km2 ELSE 0 END) AS residual_loss, sum(CASE WHEN NOT local THEN gain * area_km2 ELSE 0 END) AS residual_gain,
 sum(CASE WHEN other THEN loss * area_km2 ELSE 0 END) AS other_region_loss, sum(CASE WHEN other THEN gain * area_km2 ELSE 0 END) AS other_region_gain, sum(CASE WHEN NOT local THEN area_km2 ELSE 0 END) AS residual_valid_area, sum(CASE WHEN NOT local THEN start_value * area_km2 ELSE 0 END) AS residual_initial,
 sum(CASE WHEN other THEN area_km2 ELSE 0 END) AS other_region_valid_area FROM j GROUP BY 1)"""


def domains(spark, sf):
    from ..functions import fixed  # noqa: F401
    p = I.pan_frames(spark, sf).withColumnRenamed("event_date", "date")
    m = I.members(spark, sf).filter("level = 3")
    own = p.join(classes(spark, sf, "cdr").filter("class = 3"), "date").select("pan_event_id", "date", "y", "x")
    src = B.aligned_members(dates(spark, sf), m, "cdr").select(F.col("window_date").alias("date"), F.col("event_region_code").alias("region_code")).distinct().select(F.col("date").alias("_d"), "region_code")
    src = p.join(src, F.col("date") == F.col("_d")).select("pan_event_id", "region_code")
    return B.domain_budgets(p, rb(spark, sf), own, cells(spark, sf), src, "pan_event_id")


@query("agg_16_ras_14_domain_metrics", DOM + """ SELECT pan_event_id, round(global_loss, 6) + 0.0 AS global_loss, CASE WHEN global_loss > 0 THEN round(global_gain / global_loss, 6) + 0.0 END AS global_compensation_ratio, round(local_loss, 6) + 0.0 AS local_loss, round(residual_loss, 6) + 0.0 AS residual_loss, round(residual_loss - residual_gain, 6) + 0.0 AS residual_net_loss,
 CASE WHEN residual_loss > 0 THEN round(residual_gain / residual_loss, 6) + 0.0 END AS residual_compensation_ratio, round(other_region_loss, 6) + 0.0 AS other_region_loss, round(other_region_loss - other_region_gain, 6) + 0.0 AS other_region_net_loss, CASE WHEN other_region_loss > 0 THEN round(other_region_gain / other_region_loss, 6) + 0.0 END AS other_region_compensation_ratio FROM dm""")
def _(spark, sf):
    return domains(spark, sf).select("pan_event_id", *rr(["global_loss", "global_compensation_ratio", "local_loss", "residual_loss", "residual_net_loss", "residual_compensation_ratio", "other_region_loss", "other_region_net_loss", "other_region_compensation_ratio"]))


@query("agg_41_domain_opportunity", DOM + """ SELECT pan_event_id, residual_valid_area, round(residual_initial, 6) + 0.0 AS residual_initial, CASE WHEN residual_initial > 0 THEN round(residual_loss / residual_initial, 6) + 0.0 END AS residual_loss_fraction, CASE WHEN residual_valid_area > 0 THEN round(residual_loss / residual_valid_area, 9) + 0.0 END AS residual_mean_loss,
 CASE WHEN other_region_valid_area > 0 THEN round(other_region_loss / other_region_valid_area, 9) + 0.0 END AS other_region_mean_loss FROM dm""")
def _(spark, sf):
    return domains(spark, sf).select("pan_event_id", "residual_valid_area", *rr(["residual_initial", "residual_loss_fraction"]), *rr(["residual_mean_loss", "other_region_mean_loss"], 9))


# ---- composition --------------------------------------------------------------------

@query("agg_23_composition", BASE + RB + """, r AS (SELECT date, loss, row_number() OVER (PARTITION BY date ORDER BY loss DESC) AS rn FROM rb WHERE loss > 0 AND region_code BETWEEN 1 AND 18)
SELECT date, count(*) AS n_parts, round(sum(loss), 6) + 0.0 AS total, round(pow(sum(loss), 2) / sum(loss * loss), 6) + 0.0 AS effective_number, round(max(loss) / sum(loss), 6) + 0.0 AS largest_share, round(sum(CASE WHEN rn <= 3 THEN loss ELSE 0 END) / sum(loss), 6) + 0.0 AS top_share FROM r GROUP BY 1""")
def _(spark, sf):
    c = B.composition(rb(spark, sf).filter(F.col("region_code").between(1, 18)), ["date"], "loss")
    return c.select("date", "n_parts", *rr(["total", "effective_number", "largest_share", "top_share"]))


@query("agg_25_region_composition", BASE + RB + """, r AS (SELECT date, region_code, loss, row_number() OVER (PARTITION BY date, region_code BETWEEN 1 AND 18 ORDER BY loss DESC) AS rn FROM rb)
SELECT date, round(pow(sum(loss) FILTER (region_code > 0), 2) / sum(loss * loss) FILTER (region_code > 0), 6) + 0.0 AS effective_number, round(max(loss) FILTER (region_code > 0) / sum(loss) FILTER (region_code > 0), 6) + 0.0 AS largest_share,
 round(sum(loss) FILTER (region_code > 0 AND rn <= 3) / sum(loss) FILTER (region_code > 0), 6) + 0.0 AS top_share, round(coalesce(sum(loss) FILTER (region_code = 0), 0) / sum(loss), 6) + 0.0 AS non_region_fraction FROM r GROUP BY 1""")
def _(spark, sf):
    return B.region_composition(rb(spark, sf), ["date"]).select("date", *rr(["effective_number", "largest_share", "top_share", "non_region_fraction"]))


def comps(spark, sf):
    """components of the five-day change; loss, area and place ride along through labelling"""
    c = cells(spark, sf).filter("delta <= -0.3125").join(I.grid(spark, sf).select("y", "x", "lon", "lat"), ["y", "x"])
    return RA.label(c, ["date"], carry=["delta", "loss", "area_km2", "lon", "lat"])


def comp_table(spark, sf):
    w = F.col("loss") * F.col("area_km2")
    return comps(spark, sf).groupBy("date", "component").agg(F.count(F.lit(1)).alias("cell_count"), F.sum(w).alias("loss"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon"), (F.sum(w * F.col("lat")) / F.sum(w)).alias("lat")).filter("cell_count > 2")


COMP = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + ", mask AS (SELECT date, y, x FROM cc WHERE delta <= -0.3125)" + label_sql("mask", 8) + """,
ct AS (SELECT l.date, component, count(*) AS cell_count, sum(loss * area_km2) AS loss, sum(loss * area_km2 * lon) / sum(loss * area_km2) AS lon, sum(loss * area_km2 * lat) / sum(loss * area_km2) AS lat FROM lab l JOIN cc ON cc.date = l.date AND cc.y = l.y AND cc.x = l.x JOIN (SELECT y, x, lon, lat FROM grid) g ON g.y = l.y AND g.x = l.x GROUP BY 1, 2 HAVING count(*) > 2)"""
HV = lambda a, b: f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("agg_24_component_spread", COMP + f""", s AS (SELECT date, sum(loss) AS t, count(*) AS n, sum(loss * cos(radians(lat)) * cos(radians(lon))) AS x, sum(loss * cos(radians(lat)) * sin(radians(lon))) AS y, sum(loss * sin(radians(lat))) AS z FROM ct GROUP BY 1),
c AS (SELECT *, degrees(atan2(y, x)) AS lon, degrees(atan2(z, sqrt(x * x + y * y))) AS lat FROM s), d AS (SELECT ct.date, sqrt(sum(loss * pow({HV('c.', 'ct.')}, 2)) / any_value(t)) AS sp, any_value(n) AS n FROM ct JOIN c ON c.date = ct.date GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY loss DESC, component) AS rn FROM ct), p AS (SELECT a.date, {HV('a.', 'b.')} AS two FROM r a JOIN r b ON a.date = b.date AND a.rn = 1 AND b.rn = 2)
SELECT d.date, n AS n_components, round(two, 4) + 0.0 AS top2_distance_km, CASE WHEN n >= 2 THEN round(sp, 4) + 0.0 END AS weighted_spread_km FROM d LEFT JOIN p USING (date)""")
def _(spark, sf):
    return B.component_spread(comp_table(spark, sf), ["date"], ellipsoid=False).select("date", "n_components", *rr(["top2_distance_km", "weighted_spread_km"], 4))


#: Inverse geodesic in SQL: twenty steps of the longitude on the auxiliary sphere for every pair of ``pr``, then the series of the length.
A_KM, FLAT = f"({fixed.WGS84_SEMI_MAJOR_M} / 1000.0)::DOUBLE", f"({fixed.WGS84_FLATTENING!r})::DOUBLE"
ARC = """SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT *, atan2(ss, cs) AS sigma FROM (SELECT *,
  sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it))"""
BEND = f"SELECT *, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS c2m, {FLAT} / 16 * (1 - sa * sa) * (4 + {FLAT} * (4 - 3 * (1 - sa * sa))) AS c FROM ({ARC})"
GEODESIC = f"""g AS (SELECT *, atan((1 - {FLAT}) * tan(radians(lat1))) AS u1, atan((1 - {FLAT}) * tan(radians(lat2))) AS u2, radians(lon2 - lon1 + 360 - 360 * floor((lon2 - lon1 + 540) / 360)) AS far FROM pr),
it AS (SELECT 0 AS i, k, date, w, u1, u2, far, far AS lam FROM g
 UNION ALL SELECT i + 1, k, date, w, u1, u2, far, far + (1 - c) * {FLAT} * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) FROM ({BEND}) WHERE i < 20),
ln AS (SELECT *, (1 - sa * sa) * (1 / pow(1 - {FLAT}, 2) - 1) AS k2 FROM ({BEND}) WHERE i = 20),
co AS (SELECT *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) AS big, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) AS small FROM ln),
km AS (SELECT k, date, w, {A_KM} * (1 - {FLAT}) * big * (sigma - small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS km FROM co)"""


@query("agg_24_component_spread_ellipsoid", COMP + f""", s AS (SELECT date, sum(loss * cos(radians(lat)) * cos(radians(lon))) AS x, sum(loss * cos(radians(lat)) * sin(radians(lon))) AS y, sum(loss * sin(radians(lat))) AS z FROM ct GROUP BY 1),
c AS (SELECT date, degrees(atan2(y, x)) AS lon, degrees(atan2(z, sqrt(x * x + y * y))) AS lat FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY loss DESC, component) AS rn FROM ct),
pr AS (SELECT 0 AS k, date, loss AS w, c.lon AS lon1, c.lat AS lat1, ct.lon AS lon2, ct.lat AS lat2 FROM ct JOIN c USING (date) UNION ALL SELECT 1, a.date, 0, a.lon, a.lat, b.lon, b.lat FROM r a JOIN r b ON a.date = b.date AND a.rn = 1 AND b.rn = 2),
{GEODESIC}
SELECT date, count(*) FILTER (k = 0) AS n_components, round(max(km) FILTER (k = 1), 4) + 0.0 AS top2_distance_km, CASE WHEN count(*) FILTER (k = 0) >= 2 THEN round(sqrt(sum(w * km * km) FILTER (k = 0) / sum(w)), 4) + 0.0 END AS weighted_spread_km FROM km GROUP BY 1""")
def _(spark, sf):
    return B.component_spread(comp_table(spark, sf), ["date"]).select("date", "n_components", *rr(["top2_distance_km", "weighted_spread_km"], 4))


# ---- footprints -------------------------------------------------------------------------

FP = ", fp AS (SELECT DISTINCT am.date, unique_local_event_id, level, p.y, p.x FROM am JOIN pcell p USING (object_id))"


@query("agg_26_union_footprint", BASE3 + ", " + CELLS + CDR + FP + TRANS + """, u AS (SELECT DISTINCT date, y, x FROM fp),
s AS (SELECT u.date, count(*) AS cells, sum(g.area_km2) AS area_km2, sum(coalesce(loss * g.area_km2, 0)) AS loss, sum(coalesce(gain * g.area_km2, 0)) AS gain, sum(CASE WHEN is_loss THEN g.area_km2 ELSE 0 END) AS coded_loss, sum(CASE WHEN is_gain THEN g.area_km2 ELSE 0 END) AS coded_gain
 FROM u JOIN grid g ON g.y = u.y AND g.x = u.x LEFT JOIN cc ON cc.date = u.date AND cc.y = u.y AND cc.x = u.x LEFT JOIN tf ON tf.date = u.date AND tf.y = u.y AND tf.x = u.x GROUP BY 1)
SELECT pan_event_id, cells, area_km2, round(loss, 6) + 0.0 AS loss, round(gain, 6) + 0.0 AS gain, coded_loss, coded_gain FROM panf JOIN s ON date = event_date""")
def _(spark, sf):
    fp = B.footprints(dates(spark, sf), I.members(spark, sf), I.patch_cells(spark, sf))
    s = B.footprint_sums(fp, cells(spark, sf), I.grid(spark, sf), ["date"], transitions(spark, sf))
    return I.pan_frames(spark, sf).join(s, F.col("event_date") == F.col("date")).select("pan_event_id", "cells", "area_km2", *rr(["loss", "gain"]), "coded_loss", "coded_gain")


@query("agg_26_event_footprints", BASE2 + CDR + FP + """ SELECT fp.date, unique_local_event_id, count(*) AS cells, sum(g.area_km2) AS area_km2, round(sum(coalesce(loss * g.area_km2, 0)), 6) + 0.0 AS loss, round(sum(coalesce(gain * g.area_km2, 0)), 6) + 0.0 AS gain
 FROM fp JOIN grid g ON g.y = fp.y AND g.x = fp.x LEFT JOIN cc ON cc.date = fp.date AND cc.y = fp.y AND cc.x = fp.x GROUP BY 1, 2""")
def _(spark, sf):
    days = dates(spark, sf)
    s = B.tile_sums(B.footprint_tiles(days, I.members(spark, sf), I.patch_cells(spark, sf)), cells(spark, sf), I.grid(spark, sf), days)
    return s.select("date", "unique_local_event_id", "cells", "area_km2", *rr(["loss", "gain"]))


@query("joi_22_agg_27_footprint_components", COMP.replace("WITH RECURSIVE ", "WITH RECURSIVE " + I.with_ctes("member", "pcell")[5:] + ", ", 1) + CDR + FP + """, cl AS (SELECT lab.date, component, lab.y, lab.x, cc.area_km2, loss * cc.area_km2 AS lw FROM lab JOIN sized USING (date, component) JOIN cc ON cc.date = lab.date AND cc.y = lab.y AND cc.x = lab.x WHERE cell_count > 2),
c1 AS (SELECT date, component, sum(area_km2) AS ca, sum(lw) AS cl FROM cl GROUP BY 1, 2), p1 AS (SELECT date, unique_local_event_id, sum(area_km2) AS pa FROM fp JOIN grid g ON g.y = fp.y AND g.x = fp.x GROUP BY 1, 2),
h AS (SELECT fp.date, unique_local_event_id, component, count(*) AS n, sum(area_km2) AS a, sum(lw) AS lw FROM fp JOIN cl ON cl.date = fp.date AND cl.y = fp.y AND cl.x = fp.x GROUP BY 1, 2, 3)
SELECT h.date, h.unique_local_event_id, h.component, n AS intersection_cells, a AS intersection_area_km2, round(lw, 6) + 0.0 AS intersection_loss, round(a / (pa + ca - a), 6) + 0.0 AS iou, round(a / pa, 6) + 0.0 AS local_capture, round(a / ca, 6) + 0.0 AS component_capture, round(lw / cl, 6) + 0.0 AS loss_weighted_overlap
FROM h JOIN c1 ON c1.date = h.date AND c1.component = h.component JOIN p1 ON p1.date = h.date AND p1.unique_local_event_id = h.unique_local_event_id""")
def _(spark, sf):
    fp = B.footprint_tiles(dates(spark, sf), I.members(spark, sf), I.patch_cells(spark, sf))
    c = comps(spark, sf)
    big = c.groupBy("date", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    out = B.tile_components(fp, c.join(big, ["date", "component"], "left_semi"), I.grid(spark, sf), dates(spark, sf))
    return out.select("date", "unique_local_event_id", "component", "intersection_cells", "intersection_area_km2", *rr(["intersection_loss", "iou", "local_capture", "component_capture", "loss_weighted_overlap"]))


# ---- start state and scenarios --------------------------------------------------------------

STARTS = I.with_ctes("field", "grid", "member", "pcell") + """, ss AS (SELECT p.object_id, p.y, p.x, f.value AS start_value, greatest(-delta, 0) * area_km2 AS w FROM pcell p JOIN grid g ON g.y = p.y AND g.x = p.x LEFT JOIN field f ON f.date = p.start_date AND f.y = p.y AND f.x = p.x),
es AS (SELECT m.unique_local_event_id, m.level, m.event_region_code, ss.* FROM ss JOIN member m USING (object_id))"""


def starts(spark, sf):
    s = B.start_state(I.patch_cells(spark, sf), I.field(spark, sf), I.grid(spark, sf))
    return s.join(I.members(spark, sf).select("object_id", "unique_local_event_id", "level", "event_region_code"), "object_id")


@query("joi_25_26_start_state", STARTS + " SELECT object_id, count(*) AS n_cells, count(start_value) AS n_start, round(sum(start_value), 6) + 0.0 AS start_sum, round(sum(w), 6) + 0.0 AS w_sum FROM ss GROUP BY 1")
def _(spark, sf):
    s = B.start_state(I.patch_cells(spark, sf), I.field(spark, sf), I.grid(spark, sf))
    return s.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count("start_value").alias("n_start"), R(F.sum("start_value")).alias("start_sum"), R(F.sum("w")).alias("w_sum"))


BIN_SQL = """count(start_value) AS n_cells, round(sum(CASE WHEN start_value IS NOT NULL THEN w ELSE 0 END), 6) + 0.0 AS total_loss,
 round(count(*) FILTER (start_value < 0.15) / CAST(count(start_value) AS DOUBLE), 6) + 0.0 AS "cell_fraction_lt_0.15", round(count(*) FILTER (start_value >= 0.15 AND start_value < 0.3) / CAST(count(start_value) AS DOUBLE), 6) + 0.0 AS "cell_fraction_0.15_0.30", round(count(*) FILTER (start_value >= 0.3) / CAST(count(start_value) AS DOUBLE), 6) + 0.0 AS "cell_fraction_ge_0.30",
 round(coalesce(sum(w) FILTER (start_value < 0.15), 0) / sum(CASE WHEN start_value IS NOT NULL THEN w ELSE 0 END), 6) + 0.0 AS "loss_fraction_lt_0.15", round(coalesce(sum(w) FILTER (start_value >= 0.15 AND start_value < 0.3), 0) / sum(CASE WHEN start_value IS NOT NULL THEN w ELSE 0 END), 6) + 0.0 AS "loss_fraction_0.15_0.30", round(coalesce(sum(w) FILTER (start_value >= 0.3), 0) / sum(CASE WHEN start_value IS NOT NULL THEN w ELSE 0 END), 6) + 0.0 AS "loss_fraction_ge_0.30" """
BIN_COLS = [f"{p}_{n}" for p in ("cell_fraction", "loss_fraction") for n in ("lt_0.15", "0.15_0.30", "ge_0.30")]


@query("agg_28_bin_fractions", BASE + ", b AS (SELECT date, region_code, start_value, loss * area_km2 AS w FROM cc) SELECT date, region_code, " + BIN_SQL + " FROM b GROUP BY 1, 2 HAVING sum(w) > 0")
def _(spark, sf):
    b = B.bin_fractions(cells(spark, sf).withColumn("w", F.col("loss") * F.col("area_km2")), ["date", "region_code"]).filter("total_loss > 0")
    return b.select("date", "region_code", "n_cells", R("total_loss").alias("total_loss"), *[R(F.col(f"`{c}`")).alias(c) for c in BIN_COLS])


@query("agg_29_start_diagnostics", STARTS + """ SELECT unique_local_event_id, count(*) AS observations, round(sum(start_value * w) / sum(w), 6) + 0.0 AS weighted_mean_start, round(quantile_cont(start_value, 0.1), 6) + 0.0 AS p10, round(quantile_cont(start_value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(start_value, 0.5), 6) + 0.0 AS median,
 round(quantile_cont(start_value, 0.75), 6) + 0.0 AS q75, round(quantile_cont(start_value, 0.9), 6) + 0.0 AS p90 FROM es GROUP BY 1""")
def _(spark, sf):
    d = B.start_diagnostics(starts(spark, sf), ["unique_local_event_id"])
    return d.select("unique_local_event_id", "observations", *rr(["weighted_mean_start", "p10", "q25", "median", "q75", "p90"]))


@query("agg_29_start_summary", STARTS + """, el AS (SELECT unique_local_event_id, any_value(level) AS level, any_value(event_region_code) AS region_code, sum(CASE WHEN start_value IS NOT NULL THEN w ELSE 0 END) AS t, coalesce(sum(w) FILTER (start_value < 0.15), 0) AS a, coalesce(sum(w) FILTER (start_value >= 0.3), 0) AS c FROM es GROUP BY 1)
SELECT CAST(q.range AS INTEGER) AS tier, CAST(r.range AS INTEGER) AS region_code, count(t) AS event_count, round(coalesce(sum(t), 0), 6) + 0.0 AS total_loss, round(coalesce(sum(a), 0), 6) + 0.0 AS low, round(coalesce(sum(c), 0), 6) + 0.0 AS high, CASE WHEN sum(t) > 0 THEN round(sum(a) / sum(t), 6) + 0.0 END AS low_fraction
FROM range(1, 4) q CROSS JOIN range(1, 19) r LEFT JOIN el ON el.level >= q.range AND el.region_code = r.range GROUP BY 1, 2""")
def _(spark, sf):
    s = starts(spark, sf)
    keys = ["unique_local_event_id", "level", "event_region_code"]
    e = B.bin_fractions(s, keys).withColumnRenamed("event_region_code", "region_code")
    o = B.start_summary(e, list(range(1, 19)))
    return o.select("tier", "region_code", "event_count", R("total_loss").alias("total_loss"), R(F.col("`loss_lt_0.15`")).alias("low"), R(F.col("`loss_ge_0.30`")).alias("high"), R(F.col("`fraction_lt_0.15`")).alias("low_fraction"))


def scen(spark, sf):
    return B.floor_components(I.field(spark, sf), I.grid(spark, sf), 5, -0.25, (None, 0.15, 0.3), (4, 10, 20), dates(spark, sf))


SCEN = I.with_ctes("field", "grid", "panf").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + CELLS + """, sc AS (SELECT cc.*, s FROM cc, (VALUES ('none', 0.0::DOUBLE), ('0.15', 0.15::DOUBLE), ('0.3', 0.3::DOUBLE)) v(s, f) WHERE s = 'none' OR start_value >= f),
m0 AS (SELECT date, s, y, x FROM sc WHERE delta <= -0.25), off AS (SELECT a.range AS a, b.range AS b FROM range(-1, 2) a, range(-1, 2) b), lim AS (SELECT max(y) AS my, max(x) AS mx FROM sc),
dil AS (SELECT DISTINCT date, s, y + a AS y, x + b AS x FROM m0, off, lim WHERE y + a BETWEEN 0 AND my AND x + b BETWEEN 0 AND mx), ero AS (SELECT date, s, y + a AS y, x + b AS x FROM dil, off GROUP BY 1, 2, 3, 4 HAVING count(*) = 9),
mask AS (SELECT e.date, e.s, CAST(e.y AS INTEGER) AS y, CAST(e.x AS INTEGER) AS x FROM ero e JOIN sc ON sc.date = e.date AND sc.s = e.s AND sc.y = e.y AND sc.x = e.x),
node AS (SELECT date, s, y, x, CAST(y AS BIGINT) * 4294967296 + x AS id FROM mask), reach AS (SELECT date, s, id AS src, y, x, id FROM node UNION SELECT r.date, r.s, r.src, m.y, m.x, m.id FROM reach r JOIN node m ON m.date = r.date AND m.s = r.s AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
lab AS (SELECT date, s, y, x, min(src) AS component FROM reach GROUP BY 1, 2, 3, 4), cmp AS (SELECT lab.date, lab.s, component, count(*) AS n, sum(loss * area_km2) AS l FROM lab JOIN sc ON sc.date = lab.date AND sc.s = lab.s AND sc.y = lab.y AND sc.x = lab.x GROUP BY 1, 2, 3),
rk AS (SELECT cmp.*, k, row_number() OVER (PARTITION BY date, s, k ORDER BY l DESC) AS rn FROM cmp, (VALUES (4), (10), (20)) z(k) WHERE n > k),
agg AS (SELECT date, s, k, count(*) AS n, sum(l) AS l, pow(sum(l), 2) / sum(l * l) AS neff, max(l) / sum(l) AS big, sum(CASE WHEN rn <= 3 THEN l ELSE 0 END) / sum(l) AS top FROM rk WHERE l > 0 GROUP BY 1, 2, 3), el AS (SELECT date, s, sum(loss * area_km2) AS e FROM sc GROUP BY 1, 2),
rows_ AS (SELECT el.date, el.s AS scenario, z.k AS min_cells, coalesce(n, 0) AS n_parts, coalesce(l, 0) AS resolved_loss, e AS eligible_loss, neff AS effective_number, big AS largest_share, top AS top_share, CASE WHEN e > 0 THEN coalesce(l, 0) / e END AS resolved_fraction
  FROM el CROSS JOIN (VALUES (4), (10), (20)) z(k) LEFT JOIN agg ON agg.date = el.date AND agg.s = el.s AND agg.k = z.k)"""


@query("ras_19_floor_sensitivity", SCEN + " SELECT date, scenario, min_cells, n_parts, round(resolved_loss, 6) + 0.0 AS resolved_loss, round(eligible_loss, 6) + 0.0 AS eligible_loss, round(effective_number, 6) + 0.0 AS effective_number, round(largest_share, 6) + 0.0 AS largest_share, round(top_share, 6) + 0.0 AS top_share, round(resolved_fraction, 6) + 0.0 AS resolved_fraction FROM rows_")
def _(spark, sf):
    return scen(spark, sf).select("date", "scenario", "min_cells", "n_parts", *rr(["resolved_loss", "eligible_loss", "effective_number", "largest_share", "top_share", "resolved_fraction"]))


@query("agg_30_scenario_summary", SCEN + """, u AS (SELECT scenario, min_cells, date, 'effective_number' AS metric, effective_number AS v FROM rows_ UNION ALL SELECT scenario, min_cells, date, 'largest_share', largest_share FROM rows_ UNION ALL SELECT scenario, min_cells, date, 'resolved_fraction', resolved_fraction FROM rows_),
q AS (SELECT scenario, min_cells, metric, count(v) AS n_values, quantile_cont(v, 0.0) AS mn, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 1.0) AS mx FROM u WHERE v IS NOT NULL GROUP BY 1, 2, 3)
SELECT q.scenario, q.min_cells, q.metric, q.n_values, round(q.mn, 6) + 0.0 AS min, round(q.p10, 6) + 0.0 AS p10, round(q.q25, 6) + 0.0 AS q25, round(q.median, 6) + 0.0 AS median, round(q.q75, 6) + 0.0 AS q75, round(q.p90, 6) + 0.0 AS p90, round(q.mx, 6) + 0.0 AS max, round(q.median - b.median, 6) + 0.0 AS median_change
FROM q LEFT JOIN q b ON b.scenario = 'none' AND b.min_cells = 4 AND b.metric = q.metric""")
def _(spark, sf):
    s = B.scenario_summary(scen(spark, sf), ["scenario", "min_cells"], ["effective_number", "largest_share", "resolved_fraction"], "date", {"scenario": "none", "min_cells": 4})
    return s.select("scenario", "min_cells", "metric", "n_values", *rr(["min", "p10", "q25", "median", "q75", "p90", "max", "median_change"]))


PAIRS = I.with_ctes("ev") + ", pr AS (SELECT unique_local_event_id, year(event_start) AS year, CASE WHEN max_area_cells % 17 <> 0 THEN cumulative_loss / 64.0::DOUBLE - 5 END AS reported, max_intensity * 8 + duration_days - 4 AS rebuilt FROM ev)"


def pairs(spark, sf):
    return I.events(spark, sf).select("unique_local_event_id", F.year("event_start").alias("year"), F.when(F.col("max_area_cells") % 17 != 0, F.col("cumulative_loss") / 64.0 - 5).alias("reported"), (F.col("max_intensity") * 8 + F.col("duration_days") - 4).alias("rebuilt"))


AVG_RANK = lambda c, src, part="1": f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0::DOUBLE)"


@query("sta_12_spearman", PAIRS + f", k AS (SELECT year, {AVG_RANK('reported', 'pr', 'year')} AS a, {AVG_RANK('rebuilt', 'pr', 'year')} AS b FROM pr WHERE reported IS NOT NULL) SELECT CAST(year AS INTEGER) AS year, CASE WHEN count(*) >= 2 THEN round(corr(a, b), 6) + 0.0 END AS rho FROM k GROUP BY 1")
def _(spark, sf):
    return B.spearman(pairs(spark, sf), ["year"], "reported", "rebuilt").select("year", R("rho").alias("rho"))


CONC = PAIRS + f""", ok AS (SELECT *, abs(rebuilt - reported) / abs(reported) AS rel FROM pr WHERE reported IS NOT NULL AND reported <> 0), k AS (SELECT {AVG_RANK('reported', 'ok')} AS a, {AVG_RANK('rebuilt', 'ok')} AS b FROM ok), kb AS (SELECT {AVG_RANK('reported', 'ok')} AS a, {AVG_RANK('rebuilt', 'ok')} AS b FROM ok WHERE year < 1995),
ks AS (SELECT {AVG_RANK('reported', 'ok')} AS a, {AVG_RANK('rebuilt', 'ok')} AS b FROM ok WHERE year = 1995)
SELECT (SELECT count(*) FROM pr) AS event_total, count(*) AS event_evaluable, round(count(*) / CAST((SELECT count(*) FROM pr) AS DOUBLE), 6) + 0.0 AS coverage, round(avg(CAST(sign(reported) = sign(rebuilt) AS INTEGER)), 6) + 0.0 AS sign_agreement, round(avg(rebuilt - reported), 6) + 0.0 AS signed_bias, count(*) FILTER (year < 1995) AS before_n, count(*) FILTER (year = 1995) AS split_n,
 round(quantile_cont(rel, 0.5), 6) + 0.0 AS median_rel, round(quantile_cont(rel, 0.9), 6) + 0.0 AS p90_rel, round((SELECT corr(a, b) FROM k), 6) + 0.0 AS rho_all, round((SELECT corr(a, b) FROM ks), 6) + 0.0 AS rho_split"""


@query("agg_31_concordance", CONC + " FROM ok")
def _(spark, sf):
    c = B.concordance(pairs(spark, sf), split_year=1995)
    return c.select("event_total", "event_evaluable", *rr(["coverage", "sign_agreement", "signed_bias"]), "before_n", "split_n", *rr(["median_rel", "p90_rel", "rho_all", "rho_split"]))


@query("evi_08_closure_gate", "WITH base AS (" + CONC + """ FROM ok) SELECT *, CASE WHEN coverage >= 0.95 AND median_rel <= 0.15 AND p90_rel <= 0.30 AND sign_agreement >= 0.95 AND rho_all >= 0.90 THEN 'PASS' WHEN coverage < 0.95 OR median_rel > 0.20 OR p90_rel > 0.40 OR sign_agreement < 0.90 OR rho_all < 0.80 THEN 'STOP' ELSE 'WARN' END AS gate,
 CASE WHEN coverage >= 0.95 AND median_rel <= 0.15 AND p90_rel <= 0.30 AND sign_agreement >= 0.95 AND rho_all >= 0.90 THEN 'exact_detector_attribution' ELSE 'detector_source_diagnose_first' END AS route FROM base""")
def _(spark, sf):
    c = B.closure_gate(B.concordance(pairs(spark, sf), split_year=1995))
    return c.select("event_total", "event_evaluable", *rr(["coverage", "sign_agreement", "signed_bias"]), "before_n", "split_n", *rr(["median_rel", "p90_rel", "rho_all", "rho_split"]), "gate", "route")


@query("agg_40_representative", I.with_ctes("ev") + """, q AS (SELECT quantile_cont(cumulative_loss, 0.5) AS m1, quantile_cont(cumulative_loss, 0.75) - quantile_cont(cumulative_loss, 0.25) AS s1, quantile_cont(max_area_cells, 0.5) AS m2, quantile_cont(max_area_cells, 0.75) - quantile_cont(max_area_cells, 0.25) AS s2 FROM ev),
d AS (SELECT unique_local_event_id, event_start, sqrt(pow((cumulative_loss - m1) / s1, 2) + pow((max_area_cells - m2) / s2, 2)) AS distance FROM ev, q) SELECT unique_local_event_id, event_start, round(distance, 6) + 0.0 AS distance FROM d ORDER BY round(distance, 9), event_start, unique_local_event_id LIMIT 1""")
def _(spark, sf):
    r = B.nearest_to_median(I.events(spark, sf), ["cumulative_loss", "max_area_cells"], "unique_local_event_id", "event_start")
    return r.withColumn("distance", R("distance"))


@query("agg_43_ecdf", I.with_ctes("diffs") + " SELECT DISTINCT metric, difference, round(cume_dist() OVER (PARTITION BY metric ORDER BY difference), 9) AS cume_dist FROM diffs")
def _(spark, sf):
    return B.ecdf(I.diffs(spark, sf), ["metric"], "difference").withColumn("cume_dist", R("cume_dist", 9))


@query("joi_28_series_back_to_events", I.with_ctes("pan", "daily") + """, d AS (SELECT series_id, date, value, lead(value) OVER w - lag(value, 2) OVER w AS delta FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)) SELECT event_id, event_date, series_id, round(delta, 6) + 0.0 AS delta FROM pan LEFT JOIN d ON date = event_date""")
def _(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("series_id").orderBy("date")
    d = I.daily(spark, sf).withColumn("delta", F.lead("value").over(w) - F.lag("value", 2).over(w))
    return I.pan(spark, sf).join(d.select("series_id", F.col("date").alias("event_date"), "delta"), "event_date", "left").select("event_id", "event_date", "series_id", R("delta").alias("delta"))


@query("ras_20_floor_branch_pairing", BASE2 + CDR + """, f AS (SELECT s, cc.date, coalesce(class, 0) AS k, loss * area_km2 AS l FROM cc LEFT JOIN kc ON kc.date = cc.date AND kc.y = cc.y AND kc.x = cc.x, (VALUES ('none', -1.0::DOUBLE), ('0.15', 0.15::DOUBLE)) v(s, fl) WHERE s = 'none' OR start_value >= fl),
a AS (SELECT date, sum(l) AS gross_loss, sum(CASE WHEN k = 3 THEN l ELSE 0 END) AS m FROM f WHERE s = 'none' GROUP BY 1), b AS (SELECT date, sum(l) AS gross_loss, sum(CASE WHEN k = 3 THEN l ELSE 0 END) AS m FROM f WHERE s <> 'none' GROUP BY 1)
SELECT coalesce(a.date, b.date) AS date, round(a.gross_loss, 6) + 0.0 AS primary_gross_loss, round(a.m, 6) + 0.0 AS primary_loss_major_severe, round(b.gross_loss, 6) + 0.0 AS floor_gross_loss, round(b.m, 6) + 0.0 AS floor_loss_major_severe, 'both' AS seen_in FROM a FULL OUTER JOIN b ON a.date = b.date""")
def _(spark, sf):
    from ..operators import joins as J
    a, k = F.col("area_km2"), classes(spark, sf, "cdr")
    c = cells(spark, sf)
    cut = lambda d: B.class_budget(d, k, F.col("loss") * a, F.col("gain") * a).select("date", "gross_loss", "loss_major_severe")
    out = J.paired_tables(cut(c), cut(c.filter("start_value >= 0.15")), ["date"])
    return out.select("date", *rr(["primary_gross_loss", "primary_loss_major_severe", "floor_gross_loss", "floor_loss_major_severe"]), "seen_in")
