"""Floor scenarios from cells to tiers, overlap, composition, controls and evidence: RAS-18, RAS-20, EVI-10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import budget as B, evidence as E, joins as J, scenario as SC, severity as SV
from ..session import durable
from . import inputs as I, on_controls as OC, on_events as OE, on_evidence as OV, on_raster as RA, walks as WK
from .registry import query

R = S.rounded
FLOORS, THRESHOLD, LEAST, SEVERE_CELLS, DAYS = (None, 0.15, 0.3), -0.25, 4, 10, 5
NAMES = ["none", "0.15", "0.3"]
REGIONS = [""] + [f"{c:02d}" for c in range(1, 19)]


def rr(cols, digits=6):
    return [R(c, digits).alias(c) for c in cols]


def change(spark, sf):
    return B.change_cells(I.field(spark, sf), I.grid(spark, sf), DAYS)


def cells(spark, sf):
    return durable(SC.floor_cells(change(spark, sf), I.grid(spark, sf), THRESHOLD, FLOORS, LEAST))


def catalogues(spark, sf, found=None):
    found = cells(spark, sf) if found is None else found
    return SC.floor_catalogues(SC.floor_patches(found, DAYS, THRESHOLD), min_cells=SEVERE_CELLS)


_VALUES = ", ".join(f"('{n}', {f if f is not None else -1.0}::DOUBLE)" for n, f in zip(NAMES, FLOORS))
_KEYS = "s, date, component"
#: Cells, patches, linked patches and events of every scenario.
CELLS = I.with_ctes("field", "grid", recursive=True) + f""", cc AS (SELECT e.date, e.y, e.x, s.value AS start_value, e.value - s.value AS delta, greatest(s.value - e.value, 0) AS loss, area_km2, region_code, lon, lat, x_m, y_m
  FROM field e JOIN field s ON s.y = e.y AND s.x = e.x AND s.date = e.date - {DAYS} JOIN grid g ON g.y = e.y AND g.x = e.x WHERE region_code <= 18),
sc AS (SELECT cc.*, s FROM cc, (VALUES {_VALUES}) v(s, f) WHERE s = 'none' OR start_value >= f),
node AS (SELECT date, s, y, x, CAST(y AS BIGINT) * 4294967296 + x AS id FROM sc WHERE delta <= {THRESHOLD}), reach AS (SELECT date, s, id AS src, y, x, id FROM node UNION SELECT r.date, r.s, r.src, m.y, m.x, m.id FROM reach r JOIN node m ON m.date = r.date AND m.s = r.s AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
lab AS (SELECT date, s, y, x, min(src) AS component FROM reach GROUP BY 1, 2, 3, 4), sized AS (SELECT date, s, component FROM lab GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
pc AS (SELECT lab.s, lab.date, component, lab.y, lab.x, delta, lon, lat, x_m, y_m, area_km2, region_code, greatest(-delta, 0) AS w FROM lab JOIN sized USING (date, s, component) JOIN cc ON cc.date = lab.date AND cc.y = lab.y AND cc.x = lab.x)"""
PATCHES = CELLS + RA.GAPS.replace("date, label_id", _KEYS).replace("GROUP BY 1, 2", f"GROUP BY {_KEYS}") + f""",
cen AS ({RA.centroid_sql(_KEYS, digits=13)}),
rgn AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY w DESC, n DESC, region_code) AS rn FROM (SELECT {_KEYS}, region_code, sum(w) AS w, count(*) AS n FROM pc WHERE region_code BETWEEN 1 AND 18 GROUP BY ALL)),
fp AS (SELECT s AS scenario, p.date, p.component, 'ROB_' || s || '_' || lpad(CAST(row_number() OVER (PARTITION BY s ORDER BY p.date, p.component) AS VARCHAR), 8, '0') AS object_id, coalesce(lpad(CAST(rgn.region_code AS VARCHAR), 2, '0'), '') AS region, p.n AS object_area_cells, m AS mean_sic_change, lo AS min_sic_change, l AS cumulative_sic_loss, al AS area_weighted_loss, centroid_lon, centroid_lat, geometry_class
 FROM (SELECT {_KEYS}, count(*) AS n, avg(delta) AS m, min(delta) AS lo, sum(w) AS l, sum(w * area_km2) AS al FROM pc GROUP BY ALL) p JOIN cen USING ({_KEYS}) LEFT JOIN rgn ON rgn.s = p.s AND rgn.date = p.date AND rgn.component = p.component AND rn = 1)"""
EVENTS = PATCHES + ", " + WK.patch_walk("fp", "scenario, region") + """,
fo AS (SELECT scenario, region, object_id AS opener, 'ULE' || lpad(CAST(row_number() OVER (ORDER BY scenario, region, date, cumulative_sic_loss DESC, object_id) AS VARCHAR), 6, '0') AS unique_local_event_id FROM fp WHERE (scenario, object_id) IN (SELECT (scenario, object_id) FROM linked WHERE opener = object_id)),
lk AS (SELECT fp.*, fo.unique_local_event_id FROM fp JOIN linked USING (scenario, object_id) JOIN fo ON fo.scenario = fp.scenario AND fo.opener = linked.opener),
ev AS (SELECT scenario, unique_local_event_id, any_value(region) AS dominant_region, min(date) AS event_start, max(date) AS event_end, max(date) - min(date) + 1 AS duration_days, count(*) AS n_daily_patches, max(object_area_cells) AS max_area_cells, max(object_area_cells) * 625.0::DOUBLE AS max_area_km2, max(-mean_sic_change) AS max_intensity, sum(cumulative_sic_loss) AS cumulative_loss FROM lk GROUP BY 1, 2)"""
_q = lambda c, p: f"quantile_cont({c}, {p})"
_rank = lambda c, part: OE.RANK(c, f"PARTITION BY {part}")
TIERS = EVENTS + f""", g AS (SELECT scenario, {_q('cumulative_loss', 0.8)} AS l, {_q('max_area_cells', 0.8)} AS a, {_q('max_intensity', 0.8)} AS i FROM ev GROUP BY 1), r AS (SELECT scenario, dominant_region, {_q('cumulative_loss', 0.8)} AS rl, {_q('max_area_cells', 0.8)} AS ra FROM ev GROUP BY 1, 2),
mk AS (SELECT ev.*, (cumulative_loss >= l OR max_area_cells >= a OR cumulative_loss >= rl OR max_area_cells >= ra) AND max_area_cells >= {SEVERE_CELLS} AND (duration_days >= 2 OR max_intensity >= i) AS sev FROM ev JOIN g USING (scenario) JOIN r USING (scenario, dominant_region)),
rk AS (SELECT *, {", ".join(f"{_rank(c, 'scenario')} AS global_rank_{c}, {_rank(c, 'scenario, dominant_region')} AS region_rank_{c}" for c in SV.RANKED)} FROM mk WHERE sev),
ix AS (SELECT *, ({" + ".join(f"global_rank_{c}" for c in SV.RANKED)}) / 4 AS gi FROM rk),
ct AS (SELECT scenario, {_q('cumulative_loss', 0.9)} AS l10, {_q('cumulative_loss', 0.85)} AS l15, {_q('max_area_km2', 0.8)} AS a20, {_q('gi', 0.9)} AS i10, {_q('gi', 0.85)} AS i15, {_q('gi', 0.8)} AS i20 FROM ix GROUP BY 1),
mj AS (SELECT scenario, unique_local_event_id, CASE WHEN cumulative_loss >= l10 AND max_area_km2 >= a20 AND duration_days >= 2 THEN 'global_loss_top10_area_top20_duration2' WHEN cumulative_loss >= l15 AND max_area_km2 >= a20 AND duration_days >= 2 THEN 'global_loss_top15_area_top20_duration2'
  WHEN region_rank_cumulative_loss >= 0.9::DOUBLE AND region_rank_max_area_km2 >= 0.8::DOUBLE AND duration_days >= 2 THEN 'region_loss_top10_area_top20_duration2' WHEN region_rank_cumulative_loss >= 0.85::DOUBLE AND region_rank_max_area_km2 >= 0.8::DOUBLE AND duration_days >= 2 THEN 'region_loss_top15_area_top20_duration2'
  WHEN gi >= i10 THEN 'severity_index_top10' WHEN gi >= i15 THEN 'severity_index_top15' WHEN gi >= i20 THEN 'severity_index_top20' END AS major_definition FROM ix JOIN ct USING (scenario)),
td AS (SELECT mk.*, major_definition, CASE WHEN major_definition IS NOT NULL THEN 3 WHEN sev THEN 2 ELSE 1 END AS level FROM mk LEFT JOIN mj USING (scenario, unique_local_event_id))"""


@query("ras_18_floor_patches", PATCHES + " SELECT scenario, object_id, date, region, CAST(object_area_cells AS INTEGER) AS object_area_cells, round(mean_sic_change, 9) + 0.0 AS mean_sic_change, min_sic_change, round(cumulative_sic_loss, 9) + 0.0 AS cumulative_sic_loss, round(area_weighted_loss, 6) + 0.0 AS area_weighted_loss, round(centroid_lon, 6) + 0.0 AS centroid_lon, round(centroid_lat, 6) + 0.0 AS centroid_lat, geometry_class FROM fp")
def _(spark, sf):
    p = SC.floor_patches(cells(spark, sf), DAYS, THRESHOLD)
    return p.select("scenario", "object_id", "date", "region", "object_area_cells", R("mean_sic_change", 9).alias("mean_sic_change"), "min_sic_change", R("cumulative_sic_loss", 9).alias("cumulative_sic_loss"), *rr(["area_weighted_loss", "centroid_lon", "centroid_lat"]), "geometry_class")


@query("ras_18_floor_events", TIERS + " SELECT scenario, unique_local_event_id, dominant_region, event_start, event_end, CAST(duration_days AS INTEGER) AS duration_days, n_daily_patches, CAST(max_area_cells AS INTEGER) AS max_area_cells, round(max_intensity, 9) + 0.0 AS max_intensity, round(cumulative_loss, 9) + 0.0 AS cumulative_loss, CAST(level AS INTEGER) AS level, major_definition FROM td")
def _(spark, sf):
    _, events, major = catalogues(spark, sf)
    t = SC.tiers(events, major)
    return t.select("scenario", "unique_local_event_id", "dominant_region", "event_start", "event_end", "duration_days", "n_daily_patches", "max_area_cells", *rr(["max_intensity", "cumulative_loss"], 9), "level", "major_definition")


@query("ras_18_floor_catalogue", TIERS + f""", lv AS (SELECT * FROM (VALUES (1, 'broad'), (2, 'severe'), (3, 'major_severe')) v(k, severity_level)), ss AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n in NAMES)}) v(scenario)), rg AS (SELECT * FROM (VALUES ('all'), {", ".join(f"('{r}')" for r in REGIONS)}) v(region)),
n AS (SELECT td.scenario, k, u.region, count(*) AS event_count, count(DISTINCT event_start) AS unique_start_dates FROM td JOIN lv ON k <= level, (VALUES (true), (false)) w(whole), LATERAL (SELECT CASE WHEN whole THEN 'all' ELSE dominant_region END AS region) u GROUP BY 1, 2, 3),
full_ AS (SELECT scenario, k, severity_level, region, coalesce(event_count, 0) AS event_count, coalesce(unique_start_dates, 0) AS unique_start_dates FROM ss CROSS JOIN lv CROSS JOIN rg LEFT JOIN n USING (scenario, k, region)), pr AS (SELECT k, event_count AS p FROM full_ WHERE region = 'all' AND scenario = 'none')
SELECT scenario, severity_level, region, event_count, unique_start_dates, CASE WHEN region = 'all' THEN event_count - p END AS absolute_change_vs_primary, CASE WHEN region = 'all' AND p <> 0 THEN round((event_count - p) / CAST(p AS DOUBLE), 9) + 0.0 END AS relative_change_vs_primary FROM full_ JOIN pr USING (k)""")
def _(spark, sf):
    _, events, major = catalogues(spark, sf)
    n = SC.catalogue_counts(SC.tiers(events, major), NAMES, REGIONS)
    return n.withColumn("relative_change_vs_primary", R("relative_change_vs_primary", 9))


@query("ras_18_nesting_gates", TIERS + """ SELECT scenario, 'severe_subset_broad' AS gate, bool_and(unique_local_event_id IN (SELECT unique_local_event_id FROM ev e WHERE e.scenario = td.scenario)) AS holds FROM td GROUP BY 1
 UNION ALL SELECT scenario, 'major_subset_severe', bool_and(major_definition IS NULL OR sev) FROM td WHERE sev OR major_definition IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    _, events, major = catalogues(spark, sf)
    return SC.nesting_gates(events, major)


WINDOW = 5
PRINTS = TIERS + f""", wd AS (SELECT DISTINCT date FROM pc), ep AS (SELECT DISTINCT lk.scenario, wd.date, unique_local_event_id, pc.y, pc.x FROM lk JOIN wd ON lk.date BETWEEN wd.date - {WINDOW} AND wd.date JOIN pc ON pc.s = lk.scenario AND pc.date = lk.date AND pc.component = lk.component)"""
OVERLAP = PRINTS + """, wg AS (SELECT date, y, x, area_km2, loss * area_km2 AS lw FROM cc), tc AS (SELECT s, pc.date, component, sum(pc.area_km2) AS ca FROM pc GROUP BY 1, 2, 3),
te AS (SELECT scenario, date, unique_local_event_id, sum(area_km2) AS la FROM ep JOIN wg USING (date, y, x) GROUP BY 1, 2, 3),
mt AS (SELECT ep.scenario, ep.date, unique_local_event_id, pc.component, count(*) AS n, sum(wg.area_km2) AS ia, sum(lw) AS il FROM ep JOIN pc ON pc.s = ep.scenario AND pc.date = ep.date AND pc.y = ep.y AND pc.x = ep.x JOIN wg ON wg.date = ep.date AND wg.y = ep.y AND wg.x = ep.x GROUP BY 1, 2, 3, 4),
ov AS (SELECT mt.*, ia / (la + ca - ia) AS iou, ia / la AS lc, ia / ca AS kc FROM mt JOIN te USING (scenario, date, unique_local_event_id) JOIN tc ON tc.s = mt.scenario AND tc.date = mt.date AND tc.component = mt.component)"""


def overlap(spark, sf):
    found = cells(spark, sf)
    linked, events, major = catalogues(spark, sf, found)
    weighed = change(spark, sf).select("date", "y", "x", "area_km2", (F.col("loss") * F.col("area_km2")).alias("lw"))
    prints = SC.event_footprints(linked, found, found.select("date"), WINDOW)
    return prints, SC.overlap_pairs(prints, found, weighed), SC.tiers(events, major)


@query("ras_20_floor_overlap", OVERLAP + " SELECT scenario, date, unique_local_event_id, component, n AS intersection_cells, round(ia, 6) + 0.0 AS intersection_area_km2, round(il, 6) + 0.0 AS intersection_loss, round(iou, 9) + 0.0 AS iou, round(lc, 9) + 0.0 AS local_capture, round(kc, 9) + 0.0 AS component_capture FROM ov")
def _(spark, sf):
    _, pairs, _ = overlap(spark, sf)
    return pairs.select("scenario", "date", "unique_local_event_id", "component", "intersection_cells", *rr(["intersection_area_km2", "intersection_loss"]), *rr(["iou", "local_capture", "component_capture"], 9))


@query("ras_20_floor_overlap_summary", OVERLAP + """, n AS (SELECT 'event_relations' AS metric, scenario, count(*) AS v FROM (SELECT DISTINCT scenario, date, unique_local_event_id FROM ep) GROUP BY 2 UNION ALL SELECT 'component_overlap_pairs', scenario, count(*) FROM ov GROUP BY 2)
SELECT a.metric, a.v AS primary_value, b.v AS floor_value, b.v - a.v AS absolute_change, b.v > 0 AS direction_preserved FROM n a JOIN n b ON b.metric = a.metric AND b.scenario = '0.15' WHERE a.scenario = 'none'""")
def _(spark, sf):
    prints, pairs, _ = overlap(spark, sf)
    n = lambda name, t: t.groupBy("scenario").agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit(name))
    both = SC.paired(n("event_relations", prints.select("scenario", "date", "unique_local_event_id").distinct()).unionByName(n("component_overlap_pairs", pairs)), ["metric"], ["value"], "none", "0.15")
    return both.select("metric", "primary_value", "floor_value", F.col("change_value").alias("absolute_change"), (F.col("floor_value") > 0).alias("direction_preserved"))


PARTS = ("residual", "broad_only", "severe_only", "major_severe")
COMPOSED = PRINTS + """, kc AS (SELECT ep.scenario, date, y, x, max(level) AS k FROM ep JOIN td USING (scenario, unique_local_event_id) GROUP BY 1, 2, 3, 4),
cb AS (SELECT sc.s AS scenario, sc.date, sum(loss * area_km2) AS gross_loss, """ + ", ".join(f"sum(CASE WHEN coalesce(k, 0) = {i} THEN loss * area_km2 ELSE 0 END) AS loss_{p}" for i, p in enumerate(PARTS)) + """ FROM sc LEFT JOIN kc ON kc.scenario = sc.s AND kc.date = sc.date AND kc.y = sc.y AND kc.x = sc.x GROUP BY 1, 2)"""


@query("ras_20_floor_composition", COMPOSED + " SELECT a.date, " + ", ".join(f"round(a.{c}, 6) + 0.0 AS primary_{c}, round(b.{c}, 6) + 0.0 AS floor_{c}, round(b.{c} - a.{c}, 6) + 0.0 AS change_{c}" for c in ("gross_loss", *[f"loss_{p}" for p in PARTS])) + """, 'PASS' AS primary_closure_status, 'PASS' AS floor_closure_status
 FROM (SELECT * FROM cb WHERE scenario = 'none') a FULL JOIN (SELECT * FROM cb WHERE scenario = '0.15') b ON b.date = a.date""")
def _(spark, sf):
    prints, _, tiered = overlap(spark, sf)
    b = SC.class_composition(prints, tiered, change(spark, sf), FLOORS)
    columns = ["gross_loss", *[f"loss_{p}" for p in PARTS]]
    p = SC.paired(b, ["date"], columns, "none", "0.15")
    gate = b.groupBy("date").agg(*[F.max(F.when(F.col("scenario") == s, F.col("closure_status"))).alias(f"{n}_closure_status") for s, n in (("none", "primary"), ("0.15", "floor"))])
    return p.join(gate, "date").select("date", *rr([f"{side}_{c}" for c in columns for side in ("primary", "floor", "change")]), "primary_closure_status", "floor_closure_status")


@query("ras_20_composition_medians", COMPOSED + ", fr AS (" + " UNION ALL ".join(f"SELECT scenario, '{p}' AS part, loss_{p} / gross_loss AS v FROM cb WHERE gross_loss <> 0" for p in PARTS) + """), md AS (SELECT scenario, part, quantile_cont(v, 0.5) AS m FROM fr GROUP BY 1, 2)
SELECT a.part, round(a.m, 9) + 0.0 AS primary_median, round(b.m, 9) + 0.0 AS floor_median, round(b.m - a.m, 9) + 0.0 AS change_median FROM md a JOIN md b ON b.part = a.part AND b.scenario = '0.15' WHERE a.scenario = 'none'""")
def _(spark, sf):
    from ..operators import ordered
    prints, _, tiered = overlap(spark, sf)
    b = SC.class_composition(prints, tiered, change(spark, sf), FLOORS)
    flat = b.select("scenario", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"loss_fraction_{p}").alias("v")) for p in PARTS]))).filter("v is not null")
    m = ordered.quantiles(flat, ["scenario", "part"], "v", {"median": 0.5})
    return SC.paired(m, ["part"], ["median"], "none", "0.15").select("part", *rr(["primary_median", "floor_median", "change_median"], 9))


_FLOORED = OC.DIFF.replace("WHERE region_code <= 18)", "WHERE region_code <= 18 AND s.value >= 0.15)", 1)


@query("ras_20_floor_controls", f"""SELECT a.pan_event_id, a.metric, a.control_count, round(a.difference, 6) + 0.0 AS primary_difference, round(b.difference, 6) + 0.0 AS floor_difference, round(b.difference - a.difference, 6) + 0.0 AS change_difference, sign(round(a.difference, 6)) = sign(round(b.difference, 6)) AS direction_preserved
 FROM ({OC.DIFF} SELECT * FROM df) a FULL JOIN ({_FLOORED} SELECT * FROM df) b ON b.pan_event_id = a.pan_event_id AND b.metric = a.metric AND b.control_count = a.control_count""")
def _(spark, sf):
    """Cases and controls stay those of the primary analysis; only the cells that count change."""
    both = None
    for name, floor in (("none", None), ("0.15", 0.15)):
        d = OC.forward_differences(spark, sf, floor).withColumn("scenario", F.lit(name))
        both = d if both is None else both.unionByName(d)
    p = SC.paired(both, ["pan_event_id", "metric", "control_count"], ["difference"], "none", "0.15")
    p = p.select("pan_event_id", "metric", "control_count", *rr(["primary_difference", "floor_difference", "change_difference"]))
    return p.withColumn("direction_preserved", F.signum("primary_difference") == F.signum("floor_difference"))


LAGS = (-10, -7, -5, -3, -1, 0, 1, 3, 5)


def floor_samples(spark, sf):
    """samples around the events of every catalogue, in the columns that the six diagnostics read"""
    found = cells(spark, sf)
    linked, events, _ = catalogues(spark, sf, found)
    x = SC.event_samples(SC.event_points(linked, found), I.grid(spark, sf), I.field(spark, sf), LAGS, OV.BUFFERS, DAYS)
    code = F.concat(F.lit("R"), F.coalesce(F.nullif("dominant_region", F.lit("")).cast("int"), F.lit(0)) % 5)
    return x.join(events.select("scenario", "unique_local_event_id", code.alias("region")), ["scenario", "unique_local_event_id"]).select(
        "scenario", F.col("unique_local_event_id").alias("event_id"), "region", "buffer_km", F.year("event_date").alias("year"), "lag", R(F.col("mean_buffer") * 4, 12).alias("v1"), R("change_buffer", 12).alias("v2"))


SAMPLES = EVENTS + f""", pp AS (SELECT lk.scenario, unique_local_event_id, min(lk.date) AS event_date, sum(w * x_m) / sum(w) AS px, sum(w * y_m) / sum(w) AS py FROM lk JOIN pc ON pc.s = lk.scenario AND pc.date = lk.date AND pc.component = lk.component GROUP BY 1, 2),
gpt AS (SELECT scenario, unique_local_event_id, g.y, g.x, sqrt(pow(x_m - px, 2) + pow(y_m - py, 2)) / 1000.0 AS km FROM pp, grid g WHERE sqrt(pow(x_m - px, 2) + pow(y_m - py, 2)) / 1000.0 <= {max(OV.BUFFERS)}),
wt AS (SELECT scenario, unique_local_event_id, event_date, l AS lag, event_date + CAST(l AS INTEGER) AS sd FROM pp, (SELECT unnest({list(LAGS)}) AS l)), dy AS (SELECT scenario, unique_local_event_id, sd FROM wt UNION SELECT scenario, unique_local_event_id, sd - {DAYS} FROM wt),
mn AS (SELECT dy.scenario, dy.unique_local_event_id, sd, b AS buffer_km, avg(value) AS m FROM dy JOIN gpt USING (scenario, unique_local_event_id) JOIN field f ON f.date = sd AND f.y = gpt.y AND f.x = gpt.x, (SELECT unnest({list(OV.BUFFERS)}) AS b) WHERE km <= b GROUP BY 1, 2, 3, 4),
smp AS (SELECT wt.scenario, wt.unique_local_event_id AS event_id, 'R' || (coalesce(TRY_CAST(ev.dominant_region AS INTEGER), 0) % 5) AS region, CAST(q.b AS INTEGER) AS buffer_km, CAST(year(wt.event_date) AS INTEGER) AS year, CAST(lag AS INTEGER) AS lag, round(a.m * 4, 12) + 0.0 AS v1, round(a.m - c.m, 12) + 0.0 AS v2
 FROM wt JOIN ev ON ev.scenario = wt.scenario AND ev.unique_local_event_id = wt.unique_local_event_id CROSS JOIN (SELECT unnest({list(OV.BUFFERS)}) AS b) q LEFT JOIN mn a ON a.scenario = wt.scenario AND a.unique_local_event_id = wt.unique_local_event_id AND a.sd = wt.sd AND a.buffer_km = q.b
 LEFT JOIN mn c ON c.scenario = wt.scenario AND c.unique_local_event_id = wt.unique_local_event_id AND c.sd = wt.sd - {DAYS} AND c.buffer_km = q.b)"""
_TESTS = OV.FAMILIES[len(I.with_ctes("lagged")):]
_of = lambda s: f"(WITH lagged AS (SELECT * EXCLUDE (scenario) FROM smp WHERE scenario = '{s}'){_TESTS} SELECT * FROM fam)"
EVIDENCE = SAMPLES + f", fa AS {_of('none')}, fb AS {_of('0.15')}, pe AS (SELECT " + ", ".join(f"a.{c}" for c in OV.KEY) + """, a.effect AS primary_effect, b.effect AS floor_effect, a.supported AS primary_supported, b.supported AS floor_supported,
 coalesce(sign(a.effect) = sign(b.effect), false) AS direction_preserved, a.supported = b.supported AS status_preserved FROM fa a JOIN fb b ON """ + " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in OV.KEY) + ")"


def paired_evidence(spark, sf):
    """the six diagnostics on the catalogue without and with the floor, row by row"""
    x = durable(floor_samples(spark, sf))
    rows = lambda s: OV.families(spark, sf, lambda *_: x.filter(F.col("scenario") == s).drop("scenario"))
    blank = ("analysis_tier", "wrong_region", "lag_group")
    pick = lambda t: t.select("evidence_id", *[F.nullif(F.col(c), F.lit("")).alias(c) if c in blank else F.col(c) for c in OV.KEY], "effect", F.col("supported_or_significant").alias("supported"))
    p = J.paired_tables(pick(rows("none")), pick(rows("0.15")).drop(*OV.KEY), ["evidence_id"])
    r = E.scenario_comparison(p.withColumnsRenamed({f"primary_{c}": c for c in OV.KEY}), ["evidence_id"])
    return r.withColumn("direction_preserved", F.coalesce("direction_preserved", F.lit(False)))


@query("evi_10_floor_samples", SAMPLES + " SELECT * FROM smp")
def _(spark, sf):
    return floor_samples(spark, sf)


@query("evi_10_floor_catalogue_families", EVIDENCE + " SELECT " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c == "buffer_km" else c for c in OV.KEY) + ", round(primary_effect, 6) + 0.0 AS primary_effect, round(floor_effect, 6) + 0.0 AS floor_effect, primary_supported, floor_supported, direction_preserved, status_preserved FROM pe")
def _(spark, sf):
    r = paired_evidence(spark, sf)
    return r.select(*OV.KEY, *rr(["primary_effect", "floor_effect"]), "primary_supported", "floor_supported", "direction_preserved", "status_preserved")


@query("evi_10_floor_catalogue_summary", EVIDENCE + " SELECT region, diagnostic_family AS diagnostic, count(*) FILTER (primary_supported) AS n_primary_supported, count(*) FILTER (floor_supported) AS n_floor_supported, count(*) AS n_rows, bool_and(status_preserved) AS status_preserved, bool_and(direction_preserved) AS direction_preserved FROM pe GROUP BY 1, 2")
def _(spark, sf):
    return E.comparison_by_region(paired_evidence(spark, sf).withColumnRenamed("diagnostic_family", "diagnostic"))
