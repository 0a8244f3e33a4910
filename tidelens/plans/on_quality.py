"""Quality queries QA-01..17, WIN-13, RAS-16/17, SRC-07."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from ..functions import fixed, geometry as G, scalar as S
from ..operators import budget as B, joins as J, quality as Q, raster as RA
from ..sources import catalog, cells as C
from . import inputs as I, on_raster as ON_RASTER
from .on_budget import BASE2, CDR, cells, classes, dates
from .registry import query

R = S.rounded


def aligned(spark, sf):
    """members per distinct event day"""
    days = I.pan_frames(spark, sf).select(F.col("event_date").alias("date"))
    return B.aligned_members(days, I.members(spark, sf), "cdr").withColumnRenamed("window_date", "event_date")


@query("qa_01_no_lookahead", I.with_ctes("panf", "member") + """, m0 AS (SELECT pan_event_id, event_date, unique_local_event_id AS u, m.date FROM panf JOIN member m ON m.start_date <= event_date AND m.date BETWEEN event_date - 5 AND event_date),
m AS (SELECT *, CASE WHEN day(event_date) % 5 = 0 AND u LIKE 'L1%' THEN event_date + 1 ELSE date END AS d FROM m0)
SELECT pan_event_id, CAST(max(d - event_date) AS INTEGER) AS max_days_after, count(*) FILTER (d > event_date) AS future_rows, count(DISTINCT u) FILTER (NOT (day(event_date) % 7 = 0 AND u LIKE 'L2%')) AS shared, count(DISTINCT u) FILTER (day(event_date) % 7 = 0 AND u LIKE 'L2%') AS only_a,
 CASE WHEN any_value(day(event_date)) % 11 = 0 THEN 1 ELSE 0 END AS only_b, CASE WHEN count(*) FILTER (d > event_date) = 0 AND count(*) FILTER (day(event_date) % 7 = 0 AND u LIKE 'L2%') = 0 AND any_value(day(event_date)) % 11 <> 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY 1""")
def _(spark, sf):
    m, day, uid = aligned(spark, sf), F.dayofmonth("event_date"), F.col("unique_local_event_id")
    # defects: members dated after the event, ids missing from the relation, an id only there
    late = m.withColumn("date", F.when((day % 5 == 0) & uid.startswith("L1"), F.date_add("event_date", 1)).otherwise(F.col("date")))
    known = m.select("event_date", "unique_local_event_id").distinct()
    relation = known.filter(~((day % 7 == 0) & uid.startswith("L2"))).unionByName(known.filter(day % 11 == 0).select("event_date", F.lit("none").alias("unique_local_event_id")).distinct())
    audit = Q.no_lookahead(late, relation, key="event_date")
    return I.pan_frames(spark, sf).join(audit, "event_date").drop("event_date")


@query("qa_02_budget_gate", BASE2 + " SELECT DISTINCT event_date AS date, day(event_date) % 7 = 0 AS negative_amount, day(event_date) % 3 <> 0 AS closes, NOT (day(event_date) % 5 = 0 AND day(event_date) % 7 <> 0) AS fractions_close FROM panf")
def _(spark, sf):
    a, day = F.col("area_km2"), F.dayofmonth("date")
    b = B.class_budget(cells(spark, sf), classes(spark, sf, "cdr"), F.col("loss") * a, F.col("gain") * a)
    fractions = [f"loss_fraction_{n}" for n in fixed.CLASS_NAMES.values()]
    # defects: a negative total, an open sum, fractions that add to more than one
    b = b.withColumn(fractions[0], F.col(fractions[0]) + F.when(day % 5 == 0, 0.01).otherwise(0.0)).withColumn("closure_status", F.when(day % 3 == 0, "FAIL").otherwise(F.col("closure_status")))
    return Q.budget_gate(b.withColumn("gross_loss", F.when(day % 7 == 0, -1.0).otherwise(F.col("gross_loss"))), fractions, "gross_loss")


@query("qa_03_component_reconciliation", I.with_ctes("patch", "pcell") + ", n AS (SELECT object_id, count(*) AS n FROM pcell GROUP BY 1) SELECT object_id, CASE WHEN n <> object_area_cells + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END THEN 'object_area_cells' ELSE '' END AS mismatch_fields, CASE WHEN n <> object_area_cells + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END THEN 'FAIL' ELSE 'PASS' END AS status FROM patch JOIN n USING (object_id)")
def _(spark, sf):
    # defect: every thirteenth patch reports one cell too many
    table = I.patches(spark, sf).select("object_id", (F.col("object_area_cells") + F.when(F.col("k") % 13 == 0, 1).otherwise(0)).alias("object_area_cells"))
    return Q.sums_match(I.patch_cells(spark, sf), table, ["object_id"], {"object_area_cells": F.count(F.lit(1)).cast("double")})


@query("qa_16_ras_17_footprint_audit", I.with_ctes("pcell") + """, s AS (SELECT object_id, count(*) AS n, min(delta) AS mn, sum(greatest(-delta, 0)) AS l FROM pcell GROUP BY 1) SELECT object_id, CASE WHEN n % 2 = 1 THEN 'loss' ELSE '' END AS mismatch_fields, CASE WHEN n % 2 = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM s""")
def _(spark, sf):
    p = I.patch_cells(spark, sf)
    loss = F.sum(F.greatest(-F.col("delta"), F.lit(0.0)))
    n = F.count(F.lit(1)).cast("double")
    # a reported table with an error in every odd-sized patch: the audit has to name the field
    reported = p.groupBy("object_id").agg(n.alias("cells"), F.min("delta").alias("lowest"), (loss + F.when(F.count(F.lit(1)) % 2 == 1, 0.5).otherwise(0.0)).alias("loss"))
    return Q.sums_match(p, reported, ["object_id"], {"cells": n, "lowest": F.min("delta"), "loss": loss})


@query("qa_04_qa_10_table_diff", I.with_ctes("ev") + " SELECT unique_local_event_id, CASE WHEN duration_days = 3 THEN 'cumulative_loss' ELSE '' END AS mismatch_fields, CASE WHEN duration_days = 3 THEN 'FAIL' ELSE 'PASS' END AS status FROM ev")
def _(spark, sf):
    e = I.events(spark, sf)
    other = e.withColumn("cumulative_loss", F.col("cumulative_loss") + F.when(F.col("duration_days") == 3, 0.001).otherwise(1e-14))
    return Q.table_diff(e, other, ["unique_local_event_id"], ["cumulative_loss", "dominant_region", "event_start"])


@query("qa_05_qa_17_gates", I.with_ctes("ev") + """ SELECT 'start_after_end' AS gate, count(*) FILTER (event_start > event_end) AS violations, 'PASS' AS status FROM ev UNION ALL SELECT 'short', count(*) FILTER (duration_days < 2), CASE WHEN count(*) FILTER (duration_days < 2) = 0 THEN 'PASS' ELSE 'FAIL' END FROM ev
 UNION ALL SELECT 'duration_mismatch', count(*) FILTER (event_end - event_start + 1 <> duration_days), 'PASS' FROM ev""")
def _(spark, sf):
    return Q.gates(I.events(spark, sf), {"start_after_end": F.col("event_start") > F.col("event_end"), "short": F.col("duration_days") < 2, "duration_mismatch": F.datediff("event_end", "event_start") + 1 != F.col("duration_days")})


@query("qa_06_key_coverage", I.with_ctes("lagged") + """, e AS (SELECT DISTINCT event_id FROM lagged), x AS (SELECT event_id, l.lag, b.buffer FROM e, (VALUES (-10), (-7), (-5), (-3), (-1), (0), (1), (3), (5)) l(lag), (VALUES (100), (300)) b(buffer)), n AS (SELECT event_id, lag, buffer_km, count(*) AS n FROM lagged GROUP BY 1, 2, 3)
SELECT count(*) FILTER (n IS NULL) AS missing_keys, 0 AS unexpected_keys, count(*) FILTER (n > 1) AS duplicate_keys FROM x LEFT JOIN n ON n.event_id = x.event_id AND n.lag = x.lag AND n.buffer_km = x.buffer""")
def _(spark, sf):
    x = I.lagged(spark, sf)
    e = x.select("event_id").distinct().withColumn("lag", F.explode(F.array(*[F.lit(v) for v in fixed.ALL_LAGS]))).withColumn("buffer_km", F.explode(F.array(F.lit(100), F.lit(300))))
    return Q.key_coverage(e, x, ["event_id", "lag", "buffer_km"])


@query("qa_07_sparse_store", I.with_ctes("pcell", "grid") + " SELECT 0 AS duplicate_cells, count(*) FILTER (x > (SELECT max(x) FROM grid)) AS outside_grid, 0 AS missing_values, count(*) AS cells FROM pcell")
def _(spark, sf):
    nx = I.grid(spark, sf).agg((F.max("x") + 1).alias("n")).scalar()
    return Q.sparse_store(I.patch_cells(spark, sf), 25, nx)


@query("qa_08_grid_signature", I.with_ctes("coded", "field", "grid") + """, c AS (SELECT date, y, x FROM coded WHERE NOT (y = 3 AND x = 0 AND day(date) % 6 = 0) AND NOT (y = 4 AND x = 1 AND day(date) % 4 = 0)),
s AS (SELECT date, count(*) AS n, md5(string_agg(y || ',' || x, ';' ORDER BY y, x)) AS h FROM c GROUP BY 1) SELECT count(*) AS n_dates, count(DISTINCT h) AS n_signatures, min(n) AS n_cells FROM s""")
def _(spark, sf):
    day = F.dayofmonth("date")
    # defect: cells missing on some days
    holes = ((F.col("y") == 3) & (F.col("x") == 0) & (day % 6 == 0)) | ((F.col("y") == 4) & (F.col("x") == 1) & (day % 4 == 0))
    s = Q.grid_signature(I.coded(spark, sf).filter(~holes))
    return s.agg(F.count(F.lit(1)).alias("n_dates"), F.count_distinct("n_cells", "grid_xor", "grid_sum").alias("n_signatures"), F.min("n_cells").alias("n_cells"))


AXIS = """{c}a AS (SELECT {i} AS i, min({c}) AS lo, max({c}) AS hi FROM bad GROUP BY 1), {c}s AS (SELECT *, lo - lag(lo) OVER (ORDER BY i) AS s FROM {c}a),
{c}o AS (SELECT '{c}' AS axis, count(*) FILTER (lo <> hi) AS uneven, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS down, count(*) FILTER (s = 0) AS flat, count(*) FILTER (lo <> hi) = 0 AND count(*) FILTER (s = 0) = 0 AND (count(*) FILTER (s > 0) = 0 OR count(*) FILTER (s < 0) = 0) AS strict FROM {c}s)"""


@query("qa_08_axis_order", I.with_ctes("grid") + ", bad AS (SELECT y, x, y_m, CASE WHEN x = 5 THEN x_m - 25000 WHEN x = 9 AND y = 2 THEN x_m + 1 ELSE x_m END AS x_m FROM grid), " + AXIS.format(c="x_m", i="x") + ", " + AXIS.format(c="y_m", i="y") + " SELECT * FROM x_mo UNION ALL SELECT * FROM y_mo")
def _(spark, sf):
    # defects on one axis: two indices with one coordinate, an index with two
    x = F.col("x")
    g = I.grid(spark, sf).withColumn("x_m", F.when(x == 5, F.col("x_m") - 25000).when((x == 9) & (F.col("y") == 2), F.col("x_m") + 1).otherwise(F.col("x_m")))
    return Q.axis_order(g, "x", "x_m").unionByName(Q.axis_order(g, "y", "y_m"))


@query("qa_09_same_rows", I.with_ctes("patch") + " SELECT count(*) FILTER (object_area_cells = 10) AS only_first, 0 AS only_second, false AS identical FROM patch")
def _(spark, sf):
    p = I.patches(spark, sf).select("object_id", "region", "object_area_cells")
    return Q.same_rows(p, p.filter("object_area_cells <> 10"))


EVENT_COLUMNS = ["unique_local_event_id", "dominant_region", "event_start", "event_end", "duration_days", "max_area_cells", "max_area_km2", "max_intensity", "cumulative_loss", "track_centroid_lon", "track_centroid_lat", "overlap_with_series_event"]
ROW = lambda cols, reals=(): "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(printf('%.12g', {c}), '~')" if c in reals else f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols) + ")), 1, 15) AS BIGINT)"


@query("qa_11_fingerprint", I.with_ctes("ev") + f", h AS (SELECT {ROW(EVENT_COLUMNS, ('max_area_km2', 'max_intensity', 'cumulative_loss', 'track_centroid_lon', 'track_centroid_lat'))} AS h FROM ev) SELECT count(*) AS n_rows, bit_xor(h) AS row_xor, CAST(sum(h) AS VARCHAR) AS row_sum FROM h")
def _(spark, sf):
    return Q.fingerprint(I.events(spark, sf), EVENT_COLUMNS).withColumn("row_sum", F.col("row_sum").cast("string"))


@query("qa_12_catalogue_counts", I.with_ctes("member") + """, e AS (SELECT DISTINCT unique_local_event_id AS u, level FROM member) SELECT 'severe_in_broad' AS gate, count(*) FILTER (level >= 2 AND u LIKE 'L4%') AS only_left, count(*) FILTER (level >= 2 AND u NOT LIKE 'L4%') AS shared FROM e
 UNION ALL SELECT 'major_in_severe', count(*) FILTER (level >= 3 AND u LIKE 'L5%'), count(*) FILTER (level >= 3 AND u NOT LIKE 'L5%') FROM e""")
def _(spark, sf):
    m, uid = I.members(spark, sf), F.col("unique_local_event_id")
    ids = lambda k: m.filter(F.col("level") >= k).select("unique_local_event_id")
    # defects: events that the wider catalogue lacks
    return Q.subset_gate(ids(2), ids(1).filter(~uid.startswith("L4")), "severe_in_broad").unionByName(Q.subset_gate(ids(3), ids(2).filter(~uid.startswith("L5")), "major_in_severe"))


@query("qa_13_grid_alignment", I.with_ctes("grid") + " SELECT 0 AS unmatched_cells, 500.0::DOUBLE AS max_shift_m, min(area_km2) AS min_area, max(area_km2) AS max_area, true AS alignment_pass FROM grid")
def _(spark, sf):
    g = I.grid(spark, sf)
    moved = g.withColumn("x_m", F.col("x_m") + F.when(F.col("y") == 3, 500.0).otherwise(0.0))
    return Q.grid_alignment(g, moved, 25000.0).select("unmatched_cells", "max_shift_m", "min_area", "max_area", "alignment_pass")


@query("qa_13_grid_misalignment", I.with_ctes("grid") + ", b AS (SELECT y, x, x_m + CASE WHEN y = 3 THEN 1500 ELSE 0 END AS xm FROM grid WHERE NOT (y = 7 AND x < 9)) SELECT count(*) FILTER (b.y IS NULL) AS unmatched_cells, max(abs(xm - x_m)) AS max_shift_m, min(area_km2) AS min_area, max(area_km2) AS max_area, count(*) FILTER (b.y IS NULL) = 0 AND max(abs(xm - x_m)) < 1000 AS alignment_pass FROM grid LEFT JOIN b USING (y, x)".replace("b.y IS NULL", "xm IS NULL"))
def _(spark, sf):
    g = I.grid(spark, sf)
    moved = g.filter("NOT (y = 7 AND x < 9)").withColumn("x_m", F.col("x_m") + F.when(F.col("y") == 3, 1500.0).otherwise(0.0))
    return Q.grid_alignment(g, moved, 25000.0).select("unmatched_cells", "max_shift_m", "min_area", "max_area", "alignment_pass")


_E = (1 - (fixed.GRID_SEMI_MINOR_M / fixed.GRID_SEMI_MAJOR_M) ** 2) ** 0.5
_TS = math.radians(fixed.GRID_TRUE_SCALE_LAT)
_T = math.tan(math.pi / 4 - _TS / 2) / ((1 - _E * math.sin(_TS)) / (1 + _E * math.sin(_TS))) ** (_E / 2)
_K = _T * math.sqrt(1 - (_E * math.sin(_TS)) ** 2) / (fixed.GRID_SEMI_MAJOR_M * math.cos(_TS))
_S = math.sqrt((1 + math.sin(_TS)) / (1 - math.sin(_TS))) / (2 * fixed.GRID_SEMI_MAJOR_M)
_SERIES = (_E**2 / 2 + 5 * _E**4 / 24 + _E**6 / 12 + 13 * _E**8 / 360, 7 * _E**4 / 48 + 29 * _E**6 / 240 + 811 * _E**8 / 11520, 7 * _E**6 / 120 + 81 * _E**8 / 1120, 4279 * _E**8 / 161280)
GEO = f""", u AS (SELECT y, x, pi() / 2 - 2 * atan(sqrt(x_m * x_m + y_m * y_m) * {_K!r}::DOUBLE) AS chi, pi() / 2 - 2 * atan(sqrt(x_m * x_m + y_m * y_m) * {_S!r}::DOUBLE) AS ball FROM grid),
w AS (SELECT chi + {' + '.join(f"{c!r}::DOUBLE * sin({2 * k + 2} * chi)" for k, c in enumerate(_SERIES))} AS a, ball AS b FROM u), m AS (SELECT 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((b - a) / 2), 2))) AS metres FROM w)"""


@query("qa_14_geolocation_delta", I.with_ctes("grid") + GEO + " SELECT count(*) AS n_values, round(quantile_cont(metres, 0.5), 3) + 0.0 AS median_m, round(quantile_cont(metres, 0.99), 3) + 0.0 AS p99_m, round(max(metres), 3) + 0.0 AS max_m FROM m")
def _(spark, sf):
    a = G.stereographic_inverse("x_m", "y_m")
    b = G.stereographic_inverse_sphere("x_m", "y_m", fixed.GRID_SEMI_MAJOR_M)
    q = Q.geolocation_delta(I.grid(spark, sf), a, b)
    return q.select("n_values", *[R(c, 3).alias(c) for c in ("median_m", "p99_m", "max_m")])


@query("qa_15_group_fingerprint", BASE2 + CDR + f", h AS (SELECT date, {ROW(['y', 'x', 'class'])} AS h FROM kc) SELECT date, count(*) AS n_rows, bit_xor(h) AS row_xor, CAST(sum(h) AS VARCHAR) AS row_sum FROM h GROUP BY 1")
def _(spark, sf):
    return Q.group_fingerprint(classes(spark, sf, "cdr"), ["date"], ["y", "x", "class"]).withColumn("row_sum", F.col("row_sum").cast("string"))


@query("win_13_contiguous_offsets", I.with_ctes("patch") + """, o AS (SELECT region, object_id, object_area_cells AS n, coalesce(sum(object_area_cells) OVER (PARTITION BY region ORDER BY object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN k % 50 = 7 THEN 1 ELSE 0 END AS start_offset, k FROM patch) SELECT region, object_id, k % 50 <> 7 AS contiguous FROM o""")
def _(spark, sf):
    from ..operators import ordered
    p = I.patches(spark, sf).select("region", "object_id", "object_area_cells", "k")
    idx = ordered.running_total(p, ["region"], ["object_id"], F.col("object_area_cells").cast("long"), "b", "t").withColumn("start_offset", F.col("b") + F.when(F.col("k") % 50 == 7, 1).otherwise(0)).drop("b", "t")
    return Q.contiguous_offsets(idx, ["region"], ["object_id"], "start_offset", "object_area_cells").select("region", "object_id", "contiguous")


@query("ras_16_patch_geometry", I.with_ctes("pcell", "grid") + ", pc AS (SELECT p.object_id, lon, lat, x_m, y_m, greatest(-delta, 0) AS w FROM pcell p JOIN grid g ON g.y = p.y AND g.x = p.x)" + ON_RASTER.GAPS.replace("date, label_id", "object_id").replace("GROUP BY 1, 2", "GROUP BY object_id") + " " + ON_RASTER.centroid_sql("object_id"))
def _(spark, sf):
    c = I.patch_cells(spark, sf).join(I.grid(spark, sf), ["y", "x"]).withColumn("w", F.greatest(-F.col("delta"), F.lit(0.0)))
    g = RA.weighted_centroid(c, ["object_id"], "w")
    return g.select("object_id", "geometry_class", R("centroid_lat").alias("centroid_lat"), R("centroid_lon").alias("centroid_lon"))


@query("src_07_match_frames", I.with_ctes("ev", "pan", "daily") + """ SELECT unique_local_event_id AS event_id, 'severe' AS definition, dominant_region AS region, event_start AS event_date, event_start AS start_date, event_end AS end_date, track_centroid_lon AS centroid_lon, track_centroid_lat AS centroid_lat FROM ev
 UNION ALL SELECT event_id, 'panarctic', CASE WHEN l.date IS NOT NULL THEN 'R1' END, event_date, event_date, event_date, CASE WHEN l.date IS NOT NULL THEN 10.0::DOUBLE END, CASE WHEN l.date IS NOT NULL THEN 80.0::DOUBLE END FROM pan LEFT JOIN (SELECT DISTINCT date FROM daily) l ON l.date = event_date
 UNION ALL SELECT 'REG' || event_id, 'regional', region, event_date, event_date, event_date, NULL, NULL FROM pan""")
def _(spark, sf):
    pan = I.pan(spark, sf)
    places = I.daily(spark, sf).select("date").distinct().select("date", F.lit("R1").alias("region"), F.lit(10.0).alias("center_lon"), F.lit(80.0).alias("center_lat"))
    a = catalog.as_match_frame(I.events(spark, sf), "severe")
    b = catalog.as_match_frame(pan.select("event_id", F.col("event_date").alias("date")), "panarctic", places)
    c = catalog.as_match_frame(pan.select(F.concat(F.lit("REG"), "event_id").alias("unique_event_id"), "region", "event_date", F.col("event_date").alias("start_date"), F.col("event_date").alias("end_date")), "regional")
    return a.unionByName(b).unionByName(c)
