"""Event queries: SEQ-01..03, AGG-07..14/32, WIN-05..08/14, SEV-01..06, SET-02..06, SCA keys and ladders."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import fixed, scalar as S
from ..operators import ordered, pressure as P, severity as SV, tracking as T
from . import inputs as I, walks as WK
from .on_raster import CAND, cands
from .registry import query

R = S.rounded
RING = {f"R{i}": (f"R{(i + 1) % 5}",) for i in range(5)}
ORDER = [f"R{i}" for i in range(5)]


# ---- ranks -------------------------------------------------------------------

@query("win_05_average_rank", I.with_ctes("ev") + """ SELECT unique_local_event_id AS event_id, round((rank() OVER (ORDER BY max_area_km2) + (count(*) OVER (PARTITION BY max_area_km2) - 1) / 2.0::DOUBLE) / count(*) OVER (), 9) AS global_rank,
 round((rank() OVER (PARTITION BY dominant_region ORDER BY max_area_km2) + (count(*) OVER (PARTITION BY dominant_region, max_area_km2) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY dominant_region), 9) AS region_rank FROM ev""")
def _(spark, sf):
    e = ordered.average_rank_pct(I.events(spark, sf), [], "max_area_km2", "g")
    e = ordered.average_rank_pct(e, ["dominant_region"], "max_area_km2", "r")
    return e.select(F.col("unique_local_event_id").alias("event_id"), R("g", 9).alias("global_rank"), R("r", 9).alias("region_rank"))


@query("win_06_group_quantile", I.with_ctes("ev") + """, q AS (SELECT dominant_region, quantile_cont(cumulative_loss, 0.8) AS q80, quantile_cont(cumulative_loss, 0.25) AS q25 FROM ev GROUP BY 1)
SELECT unique_local_event_id AS event_id, round(q80, 6) + 0.0 AS q80, round(q25, 6) + 0.0 AS q25 FROM ev JOIN q USING (dominant_region)""")
def _(spark, sf):
    e = ordered.broadcast_quantile(I.events(spark, sf), ["dominant_region"], "cumulative_loss", {"q80": 0.8, "q25": 0.25})
    return e.select(F.col("unique_local_event_id").alias("event_id"), R("q80").alias("q80"), R("q25").alias("q25"))


@query("win_14_case_ranking", I.with_ctes("diffs") + """ SELECT metric, unit_id, difference, row_number() OVER (PARTITION BY metric ORDER BY difference, unit_id) AS rn, round(avg(difference) OVER (PARTITION BY metric), 6) + 0.0 AS mean_line FROM diffs""")
def _(spark, sf):
    d = I.diffs(spark, sf)
    n = ordered.row_numbers(d, ["metric"], ["difference", "unit_id"])
    means = d.groupBy("metric").agg(R(F.avg("difference")).alias("mean_line"))
    return n.join(means, "metric").select("metric", "unit_id", "difference", "rn", "mean_line")


# ---- severity -------------------------------------------------------------------

RANK = lambda c, part="": f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part.replace('PARTITION BY ', '') + ', ' if part else ''}{c}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part})"
SEVERE = I.with_ctes("ev") + """, g AS (SELECT quantile_cont(cumulative_loss, 0.8) AS l, quantile_cont(max_area_cells, 0.8) AS a, quantile_cont(max_intensity, 0.8) AS i FROM ev),
r AS (SELECT dominant_region, quantile_cont(cumulative_loss, 0.8) AS rl, quantile_cont(max_area_cells, 0.8) AS ra FROM ev GROUP BY 1),
marked AS (SELECT ev.*, l, a, (cumulative_loss >= l OR max_area_cells >= a) AND ok AS is_severe_global, (cumulative_loss >= rl OR max_area_cells >= ra) AND ok AS is_severe_region_normalized
  FROM (SELECT ev.*, g.*, r.rl, r.ra, max_area_cells >= 100 AND (duration_days >= 2 OR max_intensity >= g.i) AND sic_change_threshold <= -0.1 + 1e-12 AS ok FROM ev, g JOIN r ON true WHERE r.dominant_region = ev.dominant_region) ev),
severe AS (SELECT * FROM marked WHERE is_severe_global OR is_severe_region_normalized)"""
_ranks = ", ".join(f"{RANK(c)} AS global_rank_{c}, {RANK(c, 'PARTITION BY dominant_region')} AS region_rank_{c}" for c in SV.RANKED)
MAJOR = SEVERE + f""", rk AS (SELECT *, {_ranks} FROM severe),
ix AS (SELECT *, (global_rank_cumulative_loss + global_rank_max_area_km2 + global_rank_max_intensity + global_rank_duration_days) / 4 AS severity_index_global,
  (region_rank_cumulative_loss + region_rank_max_area_km2 + region_rank_max_intensity + region_rank_duration_days) / 4 AS severity_index_region FROM rk),
cuts AS (SELECT quantile_cont(cumulative_loss, 0.9) AS l10, quantile_cont(cumulative_loss, 0.85) AS l15, quantile_cont(max_area_km2, 0.8) AS a20, quantile_cont(severity_index_global, 0.9) AS i10,
  quantile_cont(severity_index_global, 0.85) AS i15, quantile_cont(severity_index_global, 0.8) AS i20 FROM ix),
fl AS (SELECT ix.*, cumulative_loss >= l10 AND max_area_km2 >= a20 AND duration_days >= 2 AS h0, cumulative_loss >= l15 AND max_area_km2 >= a20 AND duration_days >= 2 AS h1,
  region_rank_cumulative_loss >= 0.9::DOUBLE AND region_rank_max_area_km2 >= 0.8::DOUBLE AND duration_days >= 2 AS h2, region_rank_cumulative_loss >= 0.85::DOUBLE AND region_rank_max_area_km2 >= 0.8::DOUBLE AND duration_days >= 2 AS h3,
  severity_index_global >= i10 AS h4, severity_index_global >= i15 AS h5, severity_index_global >= i20 AS h6 FROM ix, cuts),
major AS (SELECT *, CASE WHEN h0 THEN 'global_loss_top10_area_top20_duration2' WHEN h1 THEN 'global_loss_top15_area_top20_duration2' WHEN h2 THEN 'region_loss_top10_area_top20_duration2' WHEN h3 THEN 'region_loss_top15_area_top20_duration2'
  WHEN h4 THEN 'severity_index_top10' WHEN h5 THEN 'severity_index_top15' ELSE 'severity_index_top20' END AS major_definition FROM fl WHERE h0 OR h1 OR h2 OR h3 OR h4 OR h5 OR h6)"""


def marked(spark, sf):
    return SV.mark_severe(I.events(spark, sf))


def severe(spark, sf):
    return marked(spark, sf).filter("is_severe_primary")


@query("sev_01_mark_severe", SEVERE + " SELECT unique_local_event_id AS event_id, round(l, 6) + 0.0 AS severity_loss_threshold, round(a, 6) + 0.0 AS severity_area_threshold_cells, is_severe_global, is_severe_region_normalized, is_severe_global OR is_severe_region_normalized AS is_severe_primary FROM marked")
def _(spark, sf):
    return marked(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), R("severity_loss_threshold").alias("severity_loss_threshold"), R("severity_area_threshold_cells").alias("severity_area_threshold_cells"), "is_severe_global", "is_severe_region_normalized", "is_severe_primary")


GRID_SQL = I.with_ctes("ev") + """, p AS (SELECT * FROM (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE)) v(pct)), g AS (SELECT 10.0::DOUBLE AS pct, quantile_cont(cumulative_loss, 0.9) AS l, quantile_cont(max_area_cells, 0.9) AS a, quantile_cont(max_intensity, 0.9) AS i FROM ev
 UNION ALL SELECT 20.0::DOUBLE, quantile_cont(cumulative_loss, 0.8), quantile_cont(max_area_cells, 0.8), quantile_cont(max_intensity, 0.8) FROM ev UNION ALL SELECT 30.0::DOUBLE, quantile_cont(cumulative_loss, 0.7), quantile_cont(max_area_cells, 0.7), quantile_cont(max_intensity, 0.7) FROM ev),
r AS (SELECT 10.0::DOUBLE AS pct, dominant_region, quantile_cont(cumulative_loss, 0.9) AS rl, quantile_cont(max_area_cells, 0.9) AS ra FROM ev GROUP BY 2 UNION ALL SELECT 20.0::DOUBLE, dominant_region, quantile_cont(cumulative_loss, 0.8), quantile_cont(max_area_cells, 0.8) FROM ev GROUP BY 2
 UNION ALL SELECT 30.0::DOUBLE, dominant_region, quantile_cont(cumulative_loss, 0.7), quantile_cont(max_area_cells, 0.7) FROM ev GROUP BY 2),
s AS (SELECT g.pct, n, d, t, ev.dominant_region, (cumulative_loss >= l OR max_area_cells >= a) AND max_area_cells >= n AND (duration_days >= d OR max_intensity >= i) AND sic_change_threshold <= t + 1e-12 AS fg,
  (cumulative_loss >= rl OR max_area_cells >= ra) AND max_area_cells >= n AND (duration_days >= d OR max_intensity >= i) AND sic_change_threshold <= t + 1e-12 AS fr
  FROM ev JOIN g ON true JOIN r ON r.pct = g.pct AND r.dominant_region = ev.dominant_region, (VALUES (50), (100), (200)) a1(n), (VALUES (1), (2), (3)) a2(d), (VALUES (-0.10::DOUBLE), (-0.15::DOUBLE)) a3(t)),
u AS (SELECT pct, n, d, t, dominant_region, 'global' AS scope, fg AS f FROM s UNION ALL SELECT pct, n, d, t, dominant_region, 'region_normalized', fr FROM s UNION ALL SELECT pct, n, d, t, dominant_region, 'primary_union', fg OR fr FROM s)
SELECT pct AS severity_percentile, n AS min_cells, d AS min_duration, t AS sic_threshold, scope, count(*) FILTER (f) AS severe_event_count, count(*) AS broad_event_count, round(count(*) FILTER (f) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS severe_fraction_of_broad,
 count(DISTINCT CASE WHEN f THEN dominant_region END) AS n_regions_with_events FROM u GROUP BY 1, 2, 3, 4, 5"""


@query("sev_02_severity_grid", GRID_SQL)
def _(spark, sf):
    g = SV.severity_grid(I.events(spark, sf), [10.0, 20.0, 30.0], [50, 100, 200], [1, 2, 3], [-0.10, -0.15])
    return g.withColumn("severe_fraction_of_broad", R("severe_fraction_of_broad"))


@query("sev_03_major_tier", MAJOR + " SELECT unique_local_event_id AS event_id, major_definition, round(severity_index_global, 9) AS severity_index_global, round(severity_index_region, 9) AS severity_index_region FROM major")
def _(spark, sf):
    m, _ = SV.select_major(severe(spark, sf))
    return m.select(F.col("unique_local_event_id").alias("event_id"), "major_definition", R("severity_index_global", 9).alias("severity_index_global"), R("severity_index_region", 9).alias("severity_index_region"))


@query("sev_03_major_rule_counts", MAJOR + """ SELECT 'global' AS family, 0.1::DOUBLE AS threshold, count(*) FILTER (h0) AS event_count FROM fl UNION ALL SELECT 'global', 0.15, count(*) FILTER (h1) FROM fl UNION ALL SELECT 'region_normalized', 0.1, count(*) FILTER (h2) FROM fl
 UNION ALL SELECT 'region_normalized', 0.15, count(*) FILTER (h3) FROM fl UNION ALL SELECT 'severity_index', 0.1, count(*) FILTER (h4) FROM fl UNION ALL SELECT 'severity_index', 0.15, count(*) FILTER (h5) FROM fl UNION ALL SELECT 'severity_index', 0.2, count(*) FILTER (h6) FROM fl""")
def _(spark, sf):
    return SV.select_major(severe(spark, sf))[1]


@query("set_02_first_definition", MAJOR + " SELECT major_definition, count(*) AS n FROM major GROUP BY 1")
def _(spark, sf):
    return SV.select_major(severe(spark, sf))[0].groupBy("major_definition").agg(F.count(F.lit(1)).alias("n"))


@query("win_07_first_come_rank", MAJOR + """ SELECT unique_local_event_id AS event_id, row_number() OVER (ORDER BY severity_index_global DESC, unique_local_event_id) AS global_severity_rank,
 row_number() OVER (PARTITION BY dominant_region ORDER BY severity_index_region DESC, unique_local_event_id) AS region_normalized_severity_rank FROM major""")
def _(spark, sf):
    r = SV.index_ranks(SV.select_major(severe(spark, sf))[0])
    return r.select(F.col("unique_local_event_id").alias("event_id"), "global_severity_rank", "region_normalized_severity_rank")


@query("agg_10_severe_summary", SEVERE + """, b AS (SELECT dominant_region, count(*) AS broad_event_count, quantile_cont(cumulative_loss, 0.5) AS bl, quantile_cont(max_area_cells, 0.5) AS ba FROM ev GROUP BY 1),
s AS (SELECT dominant_region, count(*) AS n, quantile_cont(cumulative_loss, 0.5) AS sl, quantile_cont(max_area_cells, 0.5) AS sa, count(*) FILTER (overlap_with_series_event) AS op, count(*) FILTER (overlap_with_regional_event_v1) AS orr FROM severe GROUP BY 1)
SELECT b.dominant_region AS region, broad_event_count, coalesce(n, 0) AS severe_event_count, round(bl, 6) + 0.0 AS broad_median_cumulative_loss, round(coalesce(sl, 0), 6) + 0.0 AS severe_median_cumulative_loss, round(coalesce(sa, 0), 6) + 0.0 AS severe_median_max_area_cells,
 coalesce(op, 0) AS severe_overlap_panarctic, coalesce(orr, 0) AS severe_overlap_regional, round(coalesce(n, 0) / CAST(broad_event_count AS DOUBLE), 6) + 0.0 AS severe_fraction_of_broad,
 CASE WHEN coalesce(n, 0) = 0 THEN 'weak_or_not_supported_by_severe_definition' WHEN n / CAST(broad_event_count AS DOUBLE) < 0.05 THEN 'broad-dominated_or_threshold-sensitive' ELSE 'supported_by_severe_definition' END AS interpretation_flag FROM b LEFT JOIN s USING (dominant_region)""")
def _(spark, sf):
    m = marked(spark, sf)
    s = SV.severe_summary(m, m.filter("is_severe_primary"))
    return s.select(F.col("dominant_region").alias("region"), "broad_event_count", "severe_event_count", *[R(c).alias(c) for c in ("broad_median_cumulative_loss", "severe_median_cumulative_loss", "severe_median_max_area_cells")],
                    "severe_overlap_panarctic", "severe_overlap_regional", R("severe_fraction_of_broad").alias("severe_fraction_of_broad"), "interpretation_flag")


@query("agg_10_major_summary", MAJOR + """, s AS (SELECT dominant_region, count(*) AS n FROM severe GROUP BY 1), m AS (SELECT dominant_region, count(*) AS k, quantile_cont(cumulative_loss, 0.5) AS l, quantile_cont(max_area_km2, 0.5) AS a, quantile_cont(duration_days, 0.5) AS d FROM major GROUP BY 1)
SELECT dominant_region AS region, n AS severe_event_count, coalesce(k, 0) AS major_event_count, round(coalesce(l, 0), 6) + 0.0 AS median_cumulative_loss, round(coalesce(a, 0), 6) + 0.0 AS median_max_area_km2, round(coalesce(d, 0), 6) + 0.0 AS median_duration_days, round(coalesce(k, 0) / CAST(n AS DOUBLE), 6) + 0.0 AS major_fraction_of_severe FROM s LEFT JOIN m USING (dominant_region)""")
def _(spark, sf):
    s = severe(spark, sf)
    m = SV.major_summary(s, SV.select_major(s)[0])
    return m.select(F.col("dominant_region").alias("region"), "severe_event_count", "major_event_count", *[R(c).alias(c) for c in ("median_cumulative_loss", "median_max_area_km2", "median_duration_days", "major_fraction_of_severe")])


@query("agg_10_object_summary", I.with_ctes("patch") + """, s AS (SELECT * FROM patch UNION ALL SELECT * REPLACE ('pan_arctic' AS region) FROM patch)
SELECT r.region, count(object_id) AS object_count, count(DISTINCT year(date)) AS years_with_objects, round(avg(object_area_km2), 6) + 0.0 AS mean_area_km2, round(avg(mean_sic_change), 6) + 0.0 AS mean_sic_change, round(avg(cumulative_sic_loss), 6) + 0.0 AS mean_cumulative_sic_loss,
 round(avg(CAST(overlap_with_series_event AS INTEGER)), 6) + 0.0 AS panarctic_overlap_fraction FROM (VALUES ('pan_arctic'), ('click'), ('error'), ('none_such')) r(region) LEFT JOIN s ON s.region = r.region GROUP BY 1""")
def _(spark, sf):
    o = SV.object_summary(I.patches(spark, sf), ["pan_arctic", "click", "error", "none_such"])
    return o.select("region", "object_count", "years_with_objects", *[R(c).alias(c) for c in ("mean_area_km2", "mean_sic_change", "mean_cumulative_sic_loss", "panarctic_overlap_fraction")])


LEVELS = SEVERE + ", lv AS (SELECT 'broad' AS level, dominant_region, event_start FROM ev UNION ALL SELECT 'severe', dominant_region, event_start FROM severe)"


@query("agg_11_level_counts", LEVELS + " SELECT level, CASE WHEN grouping(dominant_region) = 1 THEN 'all' ELSE dominant_region END AS region, count(*) AS event_count, count(DISTINCT event_start) AS unique_start_dates FROM lv GROUP BY GROUPING SETS ((level), (level, dominant_region))")
def _(spark, sf):
    m = marked(spark, sf)
    level = F.explode(F.when(F.col("is_severe_primary"), F.array(F.lit("broad"), F.lit("severe"))).otherwise(F.array(F.lit("broad"))))
    return SV.level_counts(m.withColumn("level", level))


@query("agg_12_two_by_two", I.with_ctes("ev") + """, f AS (SELECT overlap_with_series_event AS a, overlap_with_regional_event_v1 AS b FROM ev) SELECT 'both' AS cell_label, count(*) FILTER (a AND b) AS n_events FROM f UNION ALL SELECT 'temporal_only', count(*) FILTER (a AND NOT b) FROM f
 UNION ALL SELECT 'footprint_only', count(*) FILTER (NOT a AND b) FROM f UNION ALL SELECT 'neither', count(*) FILTER (NOT a AND NOT b) FROM f UNION ALL SELECT 'temporal_margin', count(*) FILTER (a) FROM f UNION ALL SELECT 'footprint_margin', count(*) FILTER (b) FROM f""")
def _(spark, sf):
    return SV.two_by_two(I.events(spark, sf), "overlap_with_series_event", "overlap_with_regional_event_v1")


@query("agg_13_half_month_grid", MAJOR + """, c AS (SELECT ev.event_start, CASE WHEN m.unique_local_event_id IS NOT NULL THEN 'major_severe' WHEN s.unique_local_event_id IS NOT NULL THEN 'severe_nonmajor' ELSE 'broad_only' END AS cls FROM ev LEFT JOIN severe s USING (unique_local_event_id) LEFT JOIN major m USING (unique_local_event_id)),
e AS (SELECT year(event_start) AS year, (month(event_start) - 6) * 2 + CASE WHEN day(event_start) > 15 THEN 1 ELSE 0 END AS h, cls FROM c WHERE month(event_start) IN (6, 7, 8)), y AS (SELECT unnest(range((SELECT min(year) FROM e), (SELECT max(year) + 1 FROM e))) AS year)
SELECT CAST(y.year AS INTEGER) AS year, CAST(q.h AS INTEGER) AS half_month_index, count(*) FILTER (cls = 'broad_only') AS broad_only, count(*) FILTER (cls = 'severe_nonmajor') AS severe_nonmajor, count(*) FILTER (cls = 'major_severe') AS major_severe, count(cls) AS total_events
FROM y CROSS JOIN (SELECT range AS h FROM range(0, 6)) q LEFT JOIN e ON e.year = y.year AND e.h = q.h GROUP BY 1, 2""")
def _(spark, sf):
    m = marked(spark, sf)
    major = SV.select_major(m.filter("is_severe_primary"))[0].select("unique_local_event_id", F.lit(True).alias("_m"))
    c = m.join(major, "unique_local_event_id", "left").withColumn("exclusive_class", F.when(F.col("_m"), "major_severe").when(F.col("is_severe_primary"), "severe_nonmajor").otherwise("broad_only"))
    return SV.half_month_grid(c, ["broad_only", "severe_nonmajor", "major_severe"])


@query("agg_14_value_counts", I.with_ctes("grid") + " SELECT region_code AS surface_code, count(*) AS cell_count, CASE WHEN region_code <= 18 THEN 'ocean' WHEN region_code IN (30, 32, 33, 34, 35, 40) THEN 'non_ocean' ELSE 'unknown' END AS classification FROM grid GROUP BY 1")
def _(spark, sf):
    c = F.col("surface_code")
    kind = S.ladder([(c.isin(*fixed.OCEAN_CODES), "ocean"), (c.isin(*fixed.OTHER_CODES), "non_ocean")], "unknown")
    return I.grid(spark, sf).groupBy(F.col("region_code").alias("surface_code")).agg(F.count(F.lit(1)).alias("cell_count")).withColumn("classification", kind)


@query("sev_06_taxonomy", I.with_ctes("ev") + """, n AS (SELECT CASE dominant_region WHEN 'R0' THEN 'beaufort_sea' WHEN 'R1' THEN 'kara_sea' WHEN 'R2' THEN 'hudson_bay' WHEN 'R3' THEN 'pan_arctic' ELSE 'pan_arctic_reference' END AS region, cumulative_loss FROM ev)
SELECT CASE WHEN region LIKE 'pan%' THEN 'aggregate_reference' ELSE 'physical_region' END AS region_type, count(*) AS n_events, count(*) FILTER (region NOT LIKE 'pan%') AS n_ranked, count(*) FILTER (region <> 'pan_arctic_reference') AS n_matched, count(*) FILTER (region IN ('beaufort_sea', 'kara_sea')) AS n_classified FROM n GROUP BY 1""")
def _(spark, sf):
    r = F.col("dominant_region")
    name = S.ladder([(r == "R0", "beaufort_sea"), (r == "R1", "kara_sea"), (r == "R2", "hudson_bay"), (r == "R3", "pan_arctic")], "pan_arctic_reference")
    e = I.events(spark, sf).select(name.alias("region_name")).join(SV.taxonomy(spark), "region_name")
    return e.groupBy("region_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("used_in_ranking").alias("n_ranked"), F.count_if("used_in_matching").alias("n_matched"), F.count_if("used_in_mechanism_classification").alias("n_classified"))


# ---- tracking ----------------------------------------------------------------------

def tracked(spark, sf, *more):
    """Linked patches; with ``more`` only the columns that linking reads and these."""
    p = I.patches(spark, sf)
    return T.track_patches(p.select("region", "cumulative_sic_loss", *T.PATCH_READS, *more) if more else p)


@query("seq_01_patch_tracking", WK.NUMBERED + " SELECT object_id, unique_local_event_id, opener FROM lk")
def _(spark, sf):
    return tracked(spark, sf).select("object_id", "unique_local_event_id", "opener")


@query("seq_01_patch_tracking_blocks", WK.NUMBERED + " SELECT object_id, unique_local_event_id, opener FROM lk")
def _(spark, sf):
    return T.track_patches(I.patches(spark, sf), blocks=True).select("object_id", "unique_local_event_id", "opener")


@query("seq_01_membership_keys", I.with_ctes("patch") + " SELECT object_id, object_id || '|' || strftime(date, '%Y-%m-%d') || '|' || strftime(start_date, '%Y-%m-%d') || '|3|-0.1' AS patch_key FROM patch")
def _(spark, sf):
    return T.membership(tracked(spark, sf, "start_date", "window_days", "threshold")).select("object_id", "patch_key")


@query("agg_07_event_roll_up", WK.NUMBERED + ", " + WK.EVENT_GEOMETRY + """ SELECT unique_local_event_id, any_value(region) AS dominant_region, min(date) AS event_start, max(date) AS event_end, max(date) - min(date) + 1 AS duration_days, count(*) AS n_daily_patches, max(object_area_cells) AS max_area_cells, max(object_area_km2) AS max_area_km2,
 max(-mean_sic_change) AS max_intensity, min(min_sic_change) AS min_sic_change, round(avg(mean_sic_change), 6) + 0.0 AS mean_sic_change, sum(cumulative_sic_loss) AS cumulative_loss, min(window_days) AS window_days, min(threshold) AS sic_change_threshold, min(object_area_cells) AS min_cells,
 bool_or(overlap_with_series_event) AS overlap_with_series_event, bool_or(overlap_with_regional_event) AS overlap_with_regional_event_v1, any_value(kind) AS track_longitude_geometry_class, any_value(kind) = 'LONGITUDE_DISTRIBUTED' AS needs_decision,
 round(any_value(CASE kind WHEN 'ORDINARY' THEN x WHEN 'WRAP_ONLY' THEN (x + 540) % 360 - 180 END), 6) + 0.0 AS track_centroid_lon, round(any_value(CASE WHEN kind <> 'LONGITUDE_DISTRIBUTED' THEN y END), 6) + 0.0 AS track_centroid_lat FROM lk JOIN ce ON ce.e = unique_local_event_id GROUP BY 1""")
def _(spark, sf):
    r = T.roll_up(tracked(spark, sf), distributed="flag")
    return r.withColumns({c: R(c) for c in ("mean_sic_change", "track_centroid_lon", "track_centroid_lat")})


ROLL = I.with_ctes("member", "patch") + """ SELECT unique_local_event_id, min(m.date) AS event_start, max(m.date) AS event_end, max(m.date) - min(m.date) + 1 AS duration_days, count(*) AS n_daily_patches, max(object_area_cells) AS max_area_cells, max(-mean_sic_change) AS max_intensity, min(min_sic_change) AS min_sic_change,
 round(avg(mean_sic_change), 6) + 0.0 AS mean_sic_change, sum(p.cumulative_sic_loss) AS cumulative_loss, bool_or(overlap_with_series_event) AS overlap_with_series_event,
 round(CASE WHEN sum(p.cumulative_sic_loss) > 0 THEN sum(p.cumulative_sic_loss * centroid_lat) / sum(p.cumulative_sic_loss) ELSE avg(centroid_lat) END, 6) + 0.0 AS track_centroid_lat FROM member m JOIN patch p USING (object_id) GROUP BY 1"""


@query("agg_07_roll_up_given_members", ROLL)
def _(spark, sf):
    p = I.patches(spark, sf).join(I.members(spark, sf).select("object_id", "unique_local_event_id"), "object_id")
    r = T.roll_up(p, distributed="skip")
    return r.select("unique_local_event_id", "event_start", "event_end", "duration_days", "n_daily_patches", "max_area_cells", "max_intensity", "min_sic_change", R("mean_sic_change").alias("mean_sic_change"), "cumulative_loss", "overlap_with_series_event", R("track_centroid_lat").alias("track_centroid_lat"))


@query("agg_10_patch_summary", I.with_ctes("patch", "member") + """, e AS (SELECT unique_local_event_id, any_value(region) AS region, max(p.date) - min(p.date) + 1 AS d, max(object_area_km2) AS a, sum(p.cumulative_sic_loss) AS l, CAST(bool_or(overlap_with_series_event) AS INTEGER) AS o FROM member JOIN patch p USING (object_id) GROUP BY 1),
 s AS (SELECT region, count(*) AS unique_event_count, avg(d) AS d, avg(a) AS a, avg(l) AS l, avg(o) AS o FROM e GROUP BY 1), c AS (SELECT region, count(*) AS daily_patch_count FROM patch GROUP BY 1)
SELECT region, daily_patch_count, unique_event_count, round(daily_patch_count / CAST(unique_event_count AS DOUBLE), 6) + 0.0 AS patch_to_event_ratio, round(d, 6) + 0.0 AS mean_duration_days, round(a, 6) + 0.0 AS mean_max_area_km2, round(l, 6) + 0.0 AS mean_cumulative_loss, round(o, 6) + 0.0 AS panarctic_overlap_fraction FROM c JOIN s USING (region)""")
def _(spark, sf):
    p = I.patches(spark, sf)
    e = T.roll_up(p.join(I.members(spark, sf).select("object_id", "unique_local_event_id"), "object_id"), distributed="skip")
    return SV.patch_summary(p, e).select("region", "daily_patch_count", "unique_event_count", *[R(c).alias(c) for c in ("patch_to_event_ratio", "mean_duration_days", "mean_max_area_km2", "mean_cumulative_loss", "panarctic_overlap_fraction")])


SENSITIVE = I.with_ctes("patch", recursive=True) + ", asks AS (SELECT * FROM (VALUES (1, 5), (2, 20)) v(setting, least_)), sp_ AS (SELECT patch.*, setting FROM patch JOIN asks ON object_area_cells >= least_ WHERE window_days = 3), " + WK.patch_walk("sp_", "setting, region")


@query("sev_04_tracking_sensitivity", SENSITIVE + """ SELECT 3 AS window_days, -0.1::DOUBLE AS sic_change_threshold, CAST(least_ AS INTEGER) AS min_cells, count(*) AS daily_patch_count, count(*) FILTER (opener = object_id) AS unique_event_count, 'ok' AS status FROM linked JOIN asks USING (setting) GROUP BY least_
 UNION ALL SELECT 3, -0.2::DOUBLE, CAST(least_ AS INTEGER), NULL, NULL, 'not_available_in_existing_daily_object_file' FROM asks WHERE NOT EXISTS (SELECT 1 FROM patch WHERE threshold = -0.2)""")
def _(spark, sf):
    return T.tracking_sensitivity(I.patches(spark, sf), [3], [-0.1, -0.2], [5, 20])


CLUSTERED = I.with_ctes("ev", recursive=True) + ", ev1 AS (SELECT *, 1 AS one FROM ev), " + WK.cluster_walk("ev1", "one", "5", "500.0", WK.RING_TOUCHES) + """,
cn AS (SELECT unique_local_event_id AS opener, 'CL' || lpad(CAST(row_number() OVER (ORDER BY event_start, dominant_region, unique_local_event_id) AS VARCHAR), 5, '0') AS cluster_id FROM clustered WHERE opener = unique_local_event_id), cl AS (SELECT clustered.*, cluster_id FROM clustered JOIN cn USING (opener))"""


def clusters(spark, sf):
    """Events with their cluster, with the columns that clustering reads only."""
    e = I.events(spark, sf).select("unique_local_event_id", "event_start", "dominant_region", "track_centroid_lon", "track_centroid_lat", "cumulative_loss")
    return T.cluster_events(e, RING)


@query("seq_02_event_clusters", CLUSTERED + " SELECT unique_local_event_id, cluster_id, round(running_lon, 6) + 0.0 AS running_lon, round(running_lat, 6) + 0.0 AS running_lat FROM cl")
def _(spark, sf):
    return clusters(spark, sf).select("unique_local_event_id", "cluster_id", R("running_lon").alias("running_lon"), R("running_lat").alias("running_lat"))


@query("agg_08_cluster_roll_up", CLUSTERED + """, p AS (SELECT cl.cluster_id, cl.running_lon, cl.running_lat, ev.*, row_number() OVER (PARTITION BY cluster_id ORDER BY ev.cumulative_loss DESC, ev.event_start, ev.dominant_region, unique_local_event_id) AS rl,
 row_number() OVER (PARTITION BY cluster_id ORDER BY ev.max_intensity DESC, ev.event_start, ev.dominant_region, unique_local_event_id) AS ri, row_number() OVER (PARTITION BY cluster_id ORDER BY ev.event_start, ev.dominant_region, unique_local_event_id) AS rf, row_number() OVER (PARTITION BY cluster_id ORDER BY ev.event_start DESC, ev.dominant_region DESC, unique_local_event_id DESC) AS rz FROM cl JOIN ev USING (unique_local_event_id)),
g AS (SELECT cluster_id, dominant_region AS r, sum(cumulative_loss) AS w FROM p GROUP BY 1, 2), m AS (SELECT cluster_id, max(w) AS mx, sum(w) AS t FROM g GROUP BY 1),
td AS (SELECT g.cluster_id, g.r, mx, t, q.dominant_region AS rep FROM g JOIN m USING (cluster_id) JOIN p q ON q.cluster_id = g.cluster_id AND q.rl = 1 WHERE abs(w - mx) <= 1e-12 * greatest(1, mx) + 1e-12 * mx),
dr AS (SELECT cluster_id, CASE WHEN bool_or(r = rep) THEN any_value(rep) ELSE min(r) END AS dominant_region, CAST(count(*) AS INTEGER) AS tie_count, CASE WHEN count(*) = 1 THEN 'unique_maximum' WHEN bool_or(r = rep) THEN 'representative_region' ELSE 'physical_regions_order' END AS tie_break, max(mx / t) AS f FROM td GROUP BY 1)
SELECT cluster_id, any_value(dr.dominant_region) AS dominant_region, max(p.dominant_region) FILTER (rf = 1) AS legacy_first_member_region, round(any_value(f), 6) + 0.0 AS loss_dominant_region_fraction, any_value(tie_count) AS tie_count, any_value(tie_break) AS tie_break, min(event_start) AS start_date, max(event_end) AS end_date, max(event_end) - min(event_start) + 1 AS duration_days,
 count(*) AS member_event_count, round(sum(cumulative_loss), 6) + 0.0 AS total_cumulative_loss, max(max_area_km2) AS max_area, max(max_intensity) AS max_intensity, max(event_start) FILTER (rl = 1) AS peak_loss_date, max(event_start) FILTER (ri = 1) AS peak_intensity_date, max(event_start) FILTER (rl = 1) AS representative_date, max(unique_local_event_id) FILTER (rl = 1) AS representative_event_id,
 max(p.dominant_region) FILTER (rl = 1) AS representative_region, max(track_centroid_lon) FILTER (rl = 1) AS representative_lon, max(track_centroid_lat) FILTER (rl = 1) AS representative_lat, round(max(running_lon) FILTER (rz = 1), 6) + 0.0 AS centroid_lon, round(max(running_lat) FILTER (rz = 1), 6) + 0.0 AS centroid_lat,
 bool_or(overlap_with_regional_event_v1) AS matches_regional, bool_or(overlap_with_series_event) AS matches_panarctic FROM p JOIN dr USING (cluster_id) GROUP BY 1""")
def _(spark, sf):
    c = T.cluster_roll_up(T.cluster_events(I.events(spark, sf), RING), ORDER)
    return c.withColumns({n: R(n) for n in ("loss_dominant_region_fraction", "total_cumulative_loss", "centroid_lon", "centroid_lat")})


@query("agg_08_member_lists", CLUSTERED + """, nb AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY event_start, dominant_region, unique_local_event_id) AS rn FROM cl) SELECT cluster_id, CAST((rn - 1) // 1000 AS INTEGER) AS part, list(unique_local_event_id ORDER BY rn) AS member_event_ids FROM nb GROUP BY 1, 2""")
def _(spark, sf):
    return T.cluster_member_lists(clusters(spark, sf))


@query("agg_09_dominant_region", I.with_ctes("ev") + """, c AS (SELECT 'C' || duration_days || '-' || (max_area_cells % 50) AS cluster_id, dominant_region, cumulative_loss FROM ev), p AS (SELECT cluster_id, dominant_region, sum(cumulative_loss) AS w FROM c GROUP BY 1, 2),
m AS (SELECT cluster_id, max(w) AS mx, sum(w) AS t FROM p GROUP BY 1), rep AS (SELECT cluster_id, min(dominant_region) AS r FROM c GROUP BY 1), tied AS (SELECT p.*, mx, t, r FROM p JOIN m USING (cluster_id) JOIN rep USING (cluster_id) WHERE abs(w - mx) <= 1e-12 * mx)
SELECT cluster_id, CASE WHEN count(*) = 1 THEN min(dominant_region) WHEN bool_or(dominant_region = r) THEN any_value(r) ELSE min(dominant_region) END AS dominant_region, CAST(count(*) AS INTEGER) AS tie_count,
 CASE WHEN count(*) = 1 THEN 'unique_maximum' WHEN bool_or(dominant_region = r) THEN 'representative_region' ELSE 'physical_regions_order' END AS tie_break, round(any_value(mx / t), 6) + 0.0 AS loss_dominant_region_fraction FROM tied GROUP BY 1""")
def _(spark, sf):
    c = I.events(spark, sf).select(F.concat(F.lit("C"), "duration_days", F.lit("-"), F.col("max_area_cells") % 50).alias("cluster_id"), "dominant_region", "cumulative_loss")
    rep = c.groupBy("cluster_id").agg(F.min("dominant_region").alias("representative_region"))
    d = T.dominant_by_loss(c, rep, ORDER, ["cluster_id"])
    return d.select("cluster_id", "dominant_region", "tie_count", "tie_break", R("loss_dominant_region_fraction").alias("loss_dominant_region_fraction"))


@query("sev_05_cluster_sensitivity", SEVERE.replace("WITH ", "WITH RECURSIVE ", 1) + ", sx AS (SELECT severe.*, g AS gap_days, d AS distance_km FROM severe, (VALUES (3), (5), (7)) a(g), (VALUES (300.0::DOUBLE), (500.0::DOUBLE), (700.0::DOUBLE)) b(d)), " + WK.cluster_walk("sx", "gap_days, distance_km", "gap_days", "distance_km", WK.RING_TOUCHES) + """,
 n AS (SELECT gap_days, distance_km, opener, count(*) AS n FROM clustered GROUP BY 1, 2, 3) SELECT CAST(gap_days AS INTEGER) AS gap_days, distance_km, count(*) AS cluster_count, round(avg(CAST(n > 1 AS INTEGER)), 6) + 0.0 AS multi_event_cluster_fraction FROM n GROUP BY 1, 2""")
def _(spark, sf):
    c = T.cluster_events(severe(spark, sf), RING, [(g, d) for g in (3, 5, 7) for d in (300.0, 500.0, 700.0)])
    n = c.groupBy("gap_days", "distance_km", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("gap_days", "distance_km").agg(F.count(F.lit(1)).alias("cluster_count"), R(F.avg((F.col("n") > 1).cast("int"))).alias("multi_event_cluster_fraction"))


def tracks(spark, sf):
    return T.link_tracks(P.thin(cands(spark, sf), 1500.0, 6), 2500.0)


WALKED = CAND.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + WK.thin_walk("cand", 1500.0, 6) + ", " + WK.track_walk("thinned", 2500.0)


@query("seq_03_link_tracks", WALKED + " SELECT date, i, j, track_id, track_length_days, CAST(track_day_index AS INTEGER) AS track_day_index, round(link_distance_km, 4) + 0.0 AS link_distance_km FROM tracked")
def _(spark, sf):
    return tracks(spark, sf).select("date", "i", "j", "track_id", "track_length_days", "track_day_index", R("link_distance_km", 4).alias("link_distance_km"))


@query("agg_32_track_summary", WALKED + """ SELECT track_id, min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS track_length_days, round(min(center_pressure_hpa), 4) + 0.0 AS min_center_pressure_hpa, round(max(depth_hpa), 6) + 0.0 AS max_depth_hpa, round(avg(lat), 6) + 0.0 AS mean_lat, round(avg(lon), 6) + 0.0 AS mean_lon FROM tracked GROUP BY 1""")
def _(spark, sf):
    s = T.track_summary(tracks(spark, sf))
    return s.withColumns({"min_center_pressure_hpa": R("min_center_pressure_hpa", 4), "max_depth_hpa": R("max_depth_hpa"), "mean_lat": R("mean_lat"), "mean_lon": R("mean_lon")})


@query("agg_32_summary_given_tracks", I.with_ctes("member", "patch") + """ SELECT unique_local_event_id AS track_id, min(p.date) AS start_date, max(p.date) AS end_date, count(DISTINCT p.date) AS track_length_days, min(min_sic_change) AS min_center_pressure_hpa, max(mean_sic_change) AS max_depth_hpa, round(avg(centroid_lat), 6) + 0.0 AS mean_lat, round(avg(centroid_lon), 6) + 0.0 AS mean_lon FROM member JOIN patch p USING (object_id) GROUP BY 1""")
def _(spark, sf):
    p = I.patches(spark, sf).join(I.members(spark, sf).select("object_id", F.col("unique_local_event_id").alias("track_id")), "object_id")
    s = T.track_summary(p.select("track_id", "date", F.col("min_sic_change").alias("center_pressure_hpa"), F.col("mean_sic_change").alias("depth_hpa"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon")))
    return s.withColumn("mean_lat", R("mean_lat")).withColumn("mean_lon", R("mean_lon"))


@query("agg_08_roll_up_given_clusters", I.with_ctes("ev") + """, c AS (SELECT dominant_region || '-' || (max_area_cells % 40) AS cluster_id, * FROM ev), p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cumulative_loss DESC, event_start, dominant_region, unique_local_event_id) AS rl, row_number() OVER (PARTITION BY cluster_id ORDER BY max_intensity DESC, event_start, dominant_region, unique_local_event_id) AS ri FROM c)
SELECT cluster_id, min(event_start) AS start_date, max(event_end) AS end_date, max(event_end) - min(event_start) + 1 AS duration_days, count(*) AS member_event_count, sum(cumulative_loss) AS total_cumulative_loss, max(max_area_km2) AS max_area, max(unique_local_event_id) FILTER (rl = 1) AS representative_event_id, max(event_start) FILTER (ri = 1) AS peak_intensity_date,
 max(track_centroid_lon) FILTER (rl = 1) AS representative_lon, bool_or(overlap_with_regional_event_v1) AS matches_regional, round(1.0::DOUBLE, 6) AS loss_dominant_region_fraction FROM p GROUP BY 1""")
def _(spark, sf):
    e = I.events(spark, sf).withColumn("cluster_id", F.concat_ws("-", "dominant_region", (F.col("max_area_cells") % 40).cast("string")))
    e = e.withColumn("event_date", F.col("event_start")).withColumn("running_lon", F.col("track_centroid_lon")).withColumn("running_lat", F.col("track_centroid_lat"))
    c = T.cluster_roll_up(e, ORDER)
    return c.select("cluster_id", "start_date", "end_date", "duration_days", "member_event_count", "total_cumulative_loss", "max_area", "representative_event_id", "peak_intensity_date", "representative_lon", "matches_regional", R("loss_dominant_region_fraction").alias("loss_dominant_region_fraction"))


@query("win_08_day_index", I.with_ctes("member") + """, d AS (SELECT DISTINCT unique_local_event_id AS track_id, date FROM member) SELECT track_id, date, CAST(row_number() OVER (PARTITION BY track_id ORDER BY date) AS INTEGER) AS track_day_index, count(*) OVER (PARTITION BY track_id) AS track_length_days FROM d""")
def _(spark, sf):
    d = I.members(spark, sf).select(F.col("unique_local_event_id").alias("track_id"), "date").distinct()
    # one row per (track, day): the partition is bounded by the calendar
    w = W.partitionBy("track_id")
    return d.select("track_id", "date", F.row_number().over(w.orderBy("date")).alias("track_day_index"), F.count(F.lit(1)).over(w).alias("track_length_days"))


# ---- sets ----------------------------------------------------------------------------

@query("set_03_distinct_by_key", I.with_ctes("patch") + " SELECT region, date, object_id FROM (SELECT *, row_number() OVER (PARTITION BY region, date ORDER BY object_id) AS rn FROM patch) WHERE rn = 1")
def _(spark, sf):
    p = I.patches(spark, sf)
    return p.groupBy("region", "date").agg(F.min("object_id").alias("object_id"))


@query("set_04_set_gates", SEVERE + """ SELECT 'severe_in_broad' AS gate, (SELECT count(*) FROM (SELECT unique_local_event_id FROM severe EXCEPT SELECT unique_local_event_id FROM ev)) AS only_left, (SELECT count(*) FROM (SELECT unique_local_event_id FROM severe INTERSECT SELECT unique_local_event_id FROM ev)) AS shared
 UNION ALL SELECT 'broad_in_severe', (SELECT count(*) FROM (SELECT unique_local_event_id FROM ev EXCEPT SELECT unique_local_event_id FROM severe)), (SELECT count(*) FROM (SELECT unique_local_event_id FROM severe INTERSECT SELECT unique_local_event_id FROM ev))""")
def _(spark, sf):
    from ..operators import quality as Q
    m = marked(spark, sf)
    a, b = m.filter("is_severe_primary").select("unique_local_event_id"), m.select("unique_local_event_id")
    return Q.subset_gate(a, b, "severe_in_broad").unionByName(Q.subset_gate(b, a, "broad_in_severe"))


@query("set_05_shared_and_single_counts", I.with_ctes("panf", "member") + """, d AS (SELECT DISTINCT pan_event_id, unique_local_event_id FROM panf JOIN member m ON m.start_date <= event_date + 1 AND m.date BETWEEN event_date - 2 AND event_date + 1),
c AS (SELECT DISTINCT pan_event_id, unique_local_event_id FROM panf JOIN member m ON m.start_date <= event_date AND m.date BETWEEN event_date - 5 AND event_date),
j AS (SELECT coalesce(d.pan_event_id, c.pan_event_id) AS pan_event_id, d.pan_event_id IS NOT NULL AS a, c.pan_event_id IS NOT NULL AS b FROM d FULL OUTER JOIN c USING (pan_event_id, unique_local_event_id))
SELECT pan_event_id, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM j GROUP BY 1""")
def _(spark, sf):
    from ..operators import budget as B, quality as Q
    p = I.pan_frames(spark, sf)
    days = p.select(F.col("event_date").alias("date"))
    pick = lambda t: B.aligned_members(days, I.members(spark, sf), t).select("window_date", "unique_local_event_id").distinct()
    counts = Q.shared_counts(pick("detector"), pick("cdr"), ["window_date"], ["unique_local_event_id"])
    return p.join(counts, F.col("event_date") == F.col("window_date")).select("pan_event_id", "shared", "only_a", "only_b")


@query("set_06_membership_signatures", I.with_ctes("member") + """, k AS (SELECT unique_local_event_id, object_id || '|' || strftime(date, '%Y-%m-%d') AS k FROM member), s AS (SELECT unique_local_event_id, count(*) AS n, string_agg(k, ';' ORDER BY k) AS sig FROM k GROUP BY 1)
SELECT n, count(*) AS n_events, count(DISTINCT sig) AS n_signatures FROM s GROUP BY 1""")
def _(spark, sf):
    from ..operators import quality as Q
    m = I.members(spark, sf).withColumn("k", F.concat_ws("|", "object_id", F.date_format("date", "yyyy-MM-dd")))
    s = Q.signatures(m, ["unique_local_event_id"], "k")
    return s.groupBy("n").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("signature").alias("n_signatures"))


# ---- scalars -----------------------------------------------------------------------------

@query("sca_01_haversine", I.with_ctes("ev") + " SELECT unique_local_event_id AS event_id, round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(70.0::DOUBLE - track_centroid_lat) / 2), 2) + cos(radians(track_centroid_lat)) * cos(radians(70.0::DOUBLE)) * pow(sin(radians(30.0::DOUBLE - track_centroid_lon) / 2), 2))), 5) AS km FROM ev")
def _(spark, sf):
    return I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), R(S.haversine_km("track_centroid_lon", "track_centroid_lat", F.lit(30.0), F.lit(70.0)), 5).alias("km"))


@query("sca_02_lon180", I.with_ctes("ev") + " SELECT unique_local_event_id AS event_id, (track_centroid_lon + 275.5 + 180) % 360 - 180 AS lon FROM ev")
def _(spark, sf):
    return I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), S.lon180(F.col("track_centroid_lon") + 275.5).alias("lon"))


@query("sca_06_season_day", I.with_ctes("daily") + """ SELECT series_id, date, CASE WHEN NOT (month(date) = 2 AND day(date) = 29) THEN CAST(dayofyear(make_date(2001, month(date), day(date))) AS INTEGER) END AS season_day, CAST((month(date) - 6) * 2 + CASE WHEN day(date) > 15 THEN 1 ELSE 0 END AS INTEGER) AS half FROM daily""")
def _(spark, sf):
    return I.daily(spark, sf).select("series_id", "date", S.season_day("date").alias("season_day"), S.half_month("date").alias("half"))


@query("sca_07_keys", I.with_ctes("patch") + " SELECT object_id, 'LOC' || lpad(CAST(k AS VARCHAR), 7, '0') AS loc_id, object_id || '|' || strftime(date, '%Y-%m-%d') || '|' || strftime(start_date, '%Y-%m-%d') || '|3|-0.1' AS patch_key FROM patch")
def _(spark, sf):
    return I.patches(spark, sf).select("object_id", S.numbered_id("LOC", "k", 7).alias("loc_id"), S.patch_key().alias("patch_key"))


@query("sca_08_tolerant", I.with_ctes("lagged") + """ SELECT event_id, count(*) FILTER (lower(trim(CASE lag WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' ELSE NULL END)) = 'true') AS n_true, count(*) FILTER (coalesce(abs(v1 - v2) <= 0.5 + 0.25 * abs(v2), false)) AS n_close FROM lagged GROUP BY 1""")
def _(spark, sf):
    text = F.when(F.col("lag") == 0, " TRUE").when(F.col("lag") == 1, "no")
    return I.lagged(spark, sf).groupBy("event_id").agg(F.count_if(S.parse_bool(text)).alias("n_true"), F.count_if(S.is_close("v1", "v2", 0.25, 0.5)).alias("n_close"))


@query("sca_09_safe_ratio", I.with_ctes("lagged") + " SELECT event_id, lag, buffer_km, sum(v1) AS s, CASE WHEN sum(v2) - 3 > 0 THEN round(sum(v1) / (sum(v2) - 3), 6) + 0.0 END AS ratio FROM lagged GROUP BY 1, 2, 3")
def _(spark, sf):
    g = I.lagged(spark, sf).groupBy("event_id", "lag", "buffer_km").agg(F.sum("v1").alias("s"), (F.sum("v2") - 3).alias("d"))
    return g.select("event_id", "lag", "buffer_km", "s", R(S.ratio("s", "d")).alias("ratio"))


@query("sca_10_11_direction_and_status", I.with_ctes("lagged") + """, s AS (SELECT event_id, v1 - v2 AS d, CASE WHEN v1 > 3 THEN 'ok' WHEN v1 > 1 THEN 'degraded' ELSE 'odd' END AS a, CASE WHEN v2 > 0.5 THEN 'ok' ELSE 'degraded' END AS b FROM lagged)
SELECT event_id, count(*) FILTER (coalesce(d < 0, false)) AS n_negative, count(*) FILTER (coalesce(d > 0, false)) AS n_positive, count(*) FILTER (a = 'ok' AND b = 'ok') AS n_ok, count(*) FILTER (a = 'odd') AS n_reject FROM s GROUP BY 1""")
def _(spark, sf):
    a = F.when(F.col("v1") > 3, "ok").when(F.col("v1") > 1, "degraded").otherwise("odd")
    b = F.when(F.col("v2") > 0.5, "ok").otherwise("degraded")
    x = I.lagged(spark, sf).withColumn("d", F.col("v1") - F.col("v2")).withColumn("a", a).withColumn("b", b).withColumn("q", S.worst_status("a", "b"))
    return x.groupBy("event_id").agg(F.count_if(S.matches_direction("d", "negative")).alias("n_negative"), F.count_if(S.matches_direction("d", "positive")).alias("n_positive"),
                                     F.count_if(F.col("q") == "ok").alias("n_ok"), F.count_if(F.col("q") == "reject").alias("n_reject"))


@query("sca_12_representative_place", I.with_ctes("ev") + """ SELECT unique_local_event_id AS event_id, CASE WHEN max_area_cells % 3 = 0 THEN 10.0::DOUBLE WHEN max_area_cells % 3 = 1 THEN track_centroid_lon END AS lon, CASE WHEN max_area_cells % 3 = 0 THEN 80.0::DOUBLE WHEN max_area_cells % 3 = 1 THEN track_centroid_lat END AS lat,
 CASE max_area_cells % 3 WHEN 0 THEN 'max_loss_point' WHEN 1 THEN 'track_centroid_fallback' ELSE 'missing' END AS how FROM ev""")
def _(spark, sf):
    m = F.col("max_area_cells") % 3
    e = I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), F.lit(10.0).alias("a"), F.when(m == 0, 80.0).alias("b"), F.when(m == 1, F.col("track_centroid_lon")).alias("c"), F.col("track_centroid_lat").alias("d"))
    lon, lat, how = S.first_pair([("max_loss_point", "a", "b"), ("track_centroid_fallback", "c", "d")])
    return e.select("event_id", lon.alias("lon"), lat.alias("lat"), how.alias("how"))


@query("sca_13_14_wind_and_units", I.with_ctes("met") + " SELECT date, i, j, msl / 100 AS hpa, round(u10 * 0.6 + v10 * 0.8, 6) + 0.0 AS normal, round(-u10 * 0.8 + v10 * 0.6, 6) + 0.0 AS tangential, round(abs(u10 * 0.6 + v10 * 0.8), 6) + 0.0 AS abs_normal, round(sqrt(u10 * u10 + v10 * v10), 6) + 0.0 AS speed FROM met")
def _(spark, sf):
    w = S.rotate_wind("u10", "v10", F.lit(0.6), F.lit(0.8))
    return I.met(spark, sf).select("date", "i", "j", S.pa_to_hpa("msl").alias("hpa"), R(w["normal"]).alias("normal"), R(w["tangential"]).alias("tangential"), R(w["abs_normal"]).alias("abs_normal"), R(w["speed"]).alias("speed"))


@query("sca_15_key_seed", I.with_ctes("ev") + " SELECT unique_local_event_id AS event_id, ('0x' || substr(sha256('7|' || unique_local_event_id || '|' || dominant_region), 1, 8))::BIGINT AS seed FROM ev")
def _(spark, sf):
    return I.events(spark, sf).select(F.col("unique_local_event_id").alias("event_id"), S.key_seed(7, "unique_local_event_id", "dominant_region").alias("seed"))


@query("sca_16_lists", I.with_ctes("lagged") + ", d AS (SELECT DISTINCT event_id, lag FROM lagged) SELECT event_id, string_agg(CAST(lag AS VARCHAR), ';' ORDER BY lag) AS lags, count(*) AS n FROM d GROUP BY 1")
def _(spark, sf):
    # at most nine lags per event
    g = I.lagged(spark, sf).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_set("lag")), lambda v: v.cast("string")).alias("a"))
    return g.select("event_id", S.join_list("a").alias("lags")).withColumn("n", F.size(S.split_list("lags")).cast("long"))


@query("sca_18_ladder", I.with_ctes("ev") + " SELECT CASE WHEN cumulative_loss > 400 THEN 'high' WHEN duration_days >= 3 THEN 'long' ELSE 'rest' END AS label, count(*) AS n FROM ev GROUP BY 1")
def _(spark, sf):
    label = S.ladder([(F.col("cumulative_loss") > 400, "high"), (F.col("duration_days") >= 3, "long")], "rest")
    return I.events(spark, sf).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sca_19_labels", "SELECT n_nationkey, coalesce(CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' END, n_name) AS label, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, sf):
    from ..sources import catalog
    c = I.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = catalog.with_labels(I.table(spark, sf, "nation"), "n_name", labels={"NATION_1": {"en": "One"}, "NATION_2": {"en": "Two"}})
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_nationkey", "label", F.coalesce("n", F.lit(0)).alias("n"))
