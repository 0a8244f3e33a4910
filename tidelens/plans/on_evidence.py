"""Evidence queries: FLT-13/14, JOI-27, STA-09/15..18, TOP-06, AGG-42, EVI-01..07/09/10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scalar as S
from ..operators import evidence as E, joins as J, resample as RS
from ..session import durable
from . import inputs as I
from .on_joins import ADJ, EVF, ev_frame, hav
from .on_stats import U32
from .registry import query

R = S.rounded
B, SEED = 200, 11
VARS = ["v1", "v2"]
WINDS = ("outward_edge_normal_wind_ms", "wind_speed_ms")
TIERS = ("primary", "sensitivity")
BUFFERS = (100, 300)
REGIONS = tuple(f"R{i}" for i in range(5))


def rr(cols, digits=6):
    return [R(c, digits).alias(c) for c in cols]


def tests_sql(src: str, keys: list[str], out: str, family: list[str], unit: str = "event_id", value: str = "difference") -> str:
    """CTEs that test grouped differences: n, mean, sd, Student p by its finite sums, bootstrap interval, step-up FDR."""
    k = ", ".join(keys)
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in keys)
    on = " AND ".join(f"d.{c} = i.{c}" for c in keys)
    fam = f"PARTITION BY {', '.join(family)}" if family else ""
    famp = f"PARTITION BY {', '.join([*family, 'p_raw'])}"
    return f"""{out}_u AS (SELECT {k}, {unit} AS unit_, {value} AS d_ FROM {src} WHERE {value} IS NOT NULL),
{out}_s AS (SELECT {k}, count(*) AS n_units, avg(d_) AS m, stddev_samp(d_) AS sd FROM {out}_u GROUP BY {k}),
{out}_h AS (SELECT {k}, n_units - 1 AS nu, atan(abs(m / sd * sqrt(n_units)) / sqrt(n_units - 1)) AS th FROM {out}_s WHERE n_units >= 2 AND sd > 0),
{out}_a AS (SELECT {k}, any_value(nu) AS nu, any_value(th) AS th, sum(CASE WHEN nu % 2 = 0 THEN exp(lgamma(j + 0.5::DOUBLE) - lgamma(j + 1.0::DOUBLE)) / sqrt(pi()) ELSE sqrt(pi()) / 2 * exp(lgamma(j + 1.0::DOUBLE) - lgamma(j + 1.5::DOUBLE)) END * pow(cos(th), 2 * j)) AS s
  FROM {out}_h, range(0, 4000) r(j) WHERE j <= CASE WHEN nu % 2 = 0 THEN (nu - 2) / 2 ELSE greatest((nu - 3) / 2, 0) END GROUP BY {k}),
{out}_p AS (SELECT {k}, greatest(0.0::DOUBLE, 1 - CASE WHEN nu % 2 = 0 THEN sin(th) * s WHEN nu = 1 THEN 2 / pi() * th ELSE 2 / pi() * (th + sin(th) * cos(th) * s) END) AS p_raw FROM {out}_a),
{out}_i AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY unit_) - 1 AS i_, count(*) OVER (PARTITION BY {k}) AS n_ FROM {out}_u),
{out}_d AS (SELECT {k}, rep.range AS rep, {U32("'11|' || " + text + " || '|' || rep.range || '|' || (i_ // 4)", 'i_')} % n_ AS j_ FROM {out}_i, range(0, {B}) rep),
{out}_b AS (SELECT {', '.join('d.' + c for c in keys)}, rep, avg(i.d_) AS mean_ FROM {out}_d d JOIN {out}_i i ON {on} AND i.i_ = d.j_ GROUP BY ALL),
{out}_c AS (SELECT {k}, quantile_cont(mean_, 0.025) AS ci_low, quantile_cont(mean_, 0.975) AS ci_high FROM {out}_b GROUP BY {k}),
{out}_j AS (SELECT s.*, p_raw, CASE WHEN s.n_units >= 2 THEN ci_low END AS ci_low, CASE WHEN s.n_units >= 2 THEN ci_high END AS ci_high FROM {out}_s s LEFT JOIN {out}_p USING ({k}) LEFT JOIN {out}_c USING ({k})),
{out}_f AS (SELECT *, p_raw * count(p_raw) OVER ({fam}) / (rank() OVER ({fam} ORDER BY p_raw NULLS LAST) + count(*) OVER ({famp}) - 1) AS adj FROM {out}_j),
{out} AS (SELECT * EXCLUDE (adj), CASE WHEN p_raw IS NOT NULL THEN least(1.0::DOUBLE, min(adj) OVER ({fam} ORDER BY p_raw NULLS LAST RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_fdr,
  coalesce(ci_low * ci_high > 0, false) AS ci_excludes_zero, CASE WHEN n_units >= 2 AND sd > 0 THEN m / sd END AS std FROM {out}_f)"""


FL = I.with_ctes("lagged") + ", fl AS (SELECT region, buffer_km, event_id, year, lag, 'v1' AS variable, v1 AS v FROM lagged UNION ALL SELECT region, buffer_km, event_id, year, lag, 'v2', v2 FROM lagged)"
EM = ", em AS (SELECT region, buffer_km, fl.event_id, variable, avg(v) FILTER (lag IN (-1, 0)) - avg(v) FILTER (lag IN (-10, -7, -5)) AS difference, ey.year AS year FROM fl JOIN (SELECT event_id, min(year) AS year FROM lagged GROUP BY 1) ey USING (event_id) GROUP BY 1, 2, 3, 4, ey.year)"
LOC = FL + EM + ", " + tests_sql("em", ["region", "buffer_km", "variable"], "loc", [])
SUPP = "coalesce(n_units >= 3 AND p_fdr < 0.05 AND ci_excludes_zero AND abs(std) >= 0.2, false)"


def loc(spark, sf, src=I.lagged):
    return E.location_tests(src(spark, sf), VARS, B, SEED)


@query("sta_15_location_tests", LOC + f" SELECT region, buffer_km, variable, n_units, round(m, 6) + 0.0 AS mean_difference, round(std, 6) + 0.0 AS standardized_mean_difference_zero, round(p_raw, 6) + 0.0 AS p_raw, round(p_fdr, 6) + 0.0 AS p_fdr, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, {SUPP} AS supported FROM loc")
def _(spark, sf):
    return loc(spark, sf).select("region", "buffer_km", "variable", "n_units", *rr(["mean_difference", "standardized_mean_difference_zero", "p_raw", "p_fdr", "ci_low", "ci_high"]), "supported")


@query("sca_17_t_test_p", LOC + " SELECT region, buffer_km, variable, round(p_raw, 8) + 0.0 AS p_raw FROM loc")
def _(spark, sf):
    u = RS.event_minus_background(I.lagged(spark, sf), ["region", "buffer_km"], "event_id", VARS, fixed.EVENT_LAGS, fixed.BACKGROUND_LAGS)
    return RS.one_sample(u, ["region", "buffer_km", "variable"], "difference").select("region", "buffer_km", "variable", R("p_raw", 8).alias("p_raw"))


@query("flt_14_schema_projection", I.with_ctes("lagged") + " SELECT region, CAST(buffer_km AS INTEGER) AS buffer_km, count(*) AS n, CAST(NULL AS VARCHAR) AS wrong_region, CAST(NULL AS DOUBLE) AS effect FROM lagged GROUP BY 1, 2")
def _(spark, sf):
    g = I.lagged(spark, sf).groupBy("region", "buffer_km").agg(F.count(F.lit(1)).alias("n_units"))
    return E.to_schema(g).select("region", "buffer_km", F.col("n_units").alias("n"), "wrong_region", "effect")


@query("joi_27_template_join", LOC + f" SELECT region, variable, buffer_km, n_units, round(m, 6) + 0.0 AS effect, round(p_fdr, 6) + 0.0 AS p_fdr, {SUPP} AS supported_or_significant, true AS evaluated FROM loc")
def _(spark, sf):
    keys = E.key_grid(spark, "location_buffer", region=REGIONS, variable=VARS, buffer_km=BUFFERS)
    rows = E.fill_family(keys, loc(spark, sf), ["region", "variable", "buffer_km"], F.col("supported"), F.lit(""))
    return rows.select("region", "variable", "buffer_km", "n_units", *rr(["effect", "p_fdr"]), "supported_or_significant", "evaluated")


@query("flt_13_supported_rows", LOC + f" SELECT region, buffer_km, variable FROM loc WHERE {SUPP}")
def _(spark, sf):
    return loc(spark, sf).filter(E.is_supported()).select("region", "buffer_km", "variable")


GROUPS = "(VALUES ('pre-event', [-3, -1]), ('event-time', [0]), ('post-event', [1, 3, 5])) g(lag_group, ls)"
LEAD = FL + f""", bgm AS (SELECT region, event_id, variable, avg(v) AS b FROM fl WHERE lag IN (-10, -7, -5) GROUP BY 1, 2, 3), grp AS (SELECT region, event_id, variable, lag_group, avg(v) AS e FROM fl, {GROUPS} WHERE list_contains(ls, lag) GROUP BY 1, 2, 3, 4),
dd AS (SELECT region, event_id, variable, lag_group, e - b AS difference FROM grp JOIN bgm USING (region, event_id, variable)), """ + tests_sql("dd", ["region", "variable", "lag_group"], "lead", []) + """,
ls AS (SELECT *, coalesce(ci_excludes_zero AND p_fdr < 0.05 AND n_units >= 3, false) AS significant FROM lead), la AS (SELECT region, variable, bool_and(significant) AND count(*) = 3 AS every FROM ls GROUP BY 1, 2),
lc AS (SELECT ls.*, CASE WHEN every THEN 'persistent background state' WHEN significant THEN CASE lag_group WHEN 'pre-event' THEN 'precondition / precursor' WHEN 'event-time' THEN 'contemporaneous forcing' ELSE 'response / adjustment' END ELSE 'weak / unreliable' END AS classification FROM ls JOIN la USING (region, variable))"""


def lead(spark, sf, src=I.lagged):
    return E.lead_lag_tests(src(spark, sf), VARS, B, SEED)


@query("sta_16_lead_lag_tests", LEAD + " SELECT region, variable, lag_group, n_units, round(m, 6) + 0.0 AS mean_difference, round(p_fdr, 6) + 0.0 AS p_fdr, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, significant, classification FROM lc")
def _(spark, sf):
    return lead(spark, sf).select("region", "variable", "lag_group", "n_units", *rr(["mean_difference", "p_fdr", "ci_low", "ci_high"]), "significant", "classification")


@query("top_06_strongest_lag_group", LEAD + """ SELECT region, variable, coalesce(arg_max(classification, abs(m)) FILTER (significant), 'weak / unreliable') AS lag_classification, round(max(m) FILTER (lag_group = 'pre-event'), 6) + 0.0 AS pre_event_mean, round(max(m) FILTER (lag_group = 'event-time'), 6) + 0.0 AS event_time_mean,
 round(max(m) FILTER (lag_group = 'post-event'), 6) + 0.0 AS post_event_mean, CAST(sum(n_units) FILTER (lag_group = 'pre-event') AS BIGINT) AS n_pre_units FROM lc GROUP BY 1, 2""")
def _(spark, sf):
    return E.strongest_lag_group(lead(spark, sf)).select("region", "variable", "lag_classification", *rr(["pre_event_mean", "event_time_mean", "post_event_mean"]), "n_pre_units")


def displaced(spark, sf, src=I.lagged):
    """every sample repeated at the four other regions with values damped by the distance in the ring"""
    x = src(spark, sf).withColumn("_r", F.explode(F.array(*[F.lit(r) for r in REGIONS]))).filter("_r <> region")
    step = F.pmod(F.substring("_r", 2, 1).cast("int") - F.substring("region", 2, 1).cast("int"), F.lit(5)) * 0.125
    return x.select("event_id", "region", F.col("_r").alias("sample_region"), "buffer_km", "lag", "year", (F.col("v1") * step).alias("v1"), (F.col("v2") * step).alias("v2"))


SPEC = LOC + """, dfl AS (SELECT fl.region, 'R' || r.range AS sample_region, buffer_km, event_id, lag, variable, v * (((r.range - CAST(region[2:] AS INTEGER)) + 5) % 5) * 0.125::DOUBLE AS v FROM fl, range(0, 5) r WHERE 'R' || r.range <> region),
dw AS (SELECT region, sample_region, buffer_km, event_id, variable, avg(v) FILTER (lag IN (-1, 0)) - avg(v) FILTER (lag IN (-10, -7, -5)) AS w FROM dfl GROUP BY 1, 2, 3, 4, 5),
pr AS (SELECT dw.*, em.difference AS s, abs(em.difference) - abs(w) AS difference FROM dw JOIN em ON em.region = dw.region AND em.buffer_km = dw.buffer_km AND em.event_id = dw.event_id AND em.variable = dw.variable), """ + tests_sql("pr", ["region", "sample_region", "buffer_km", "variable"], "sp0", ["region"]) + f""",
sg AS (SELECT region, sample_region, buffer_km, variable, rep.range AS rep, avg(difference * ({U32("'11|' || region || '|' || sample_region || '|' || buffer_km || '|' || variable || '|s|' || event_id || '|' || (rep.range // 4)", 'rep.range')} % 2 * 2 - 1)) AS mean FROM pr, range(0, {B}) rep WHERE difference IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
sq AS (SELECT region, sample_region, buffer_km, variable, (count(*) FILTER (abs(mean) >= abs(sp0.m) - 1e-12) + 1) / {B + 1}.0::DOUBLE AS p2 FROM sg JOIN sp0 USING (region, sample_region, buffer_km, variable) GROUP BY 1, 2, 3, 4),
sr AS (SELECT region, sample_region, buffer_km, variable, n_units AS paired_n, m AS mean_specificity, ci_low, ci_high, p2 AS p_raw FROM sp0 JOIN sq USING (region, sample_region, buffer_km, variable)),
sa AS (SELECT *, p_raw * count(p_raw) OVER (PARTITION BY region) / (rank() OVER (PARTITION BY region ORDER BY p_raw) + count(*) OVER (PARTITION BY region, p_raw) - 1) AS adj FROM sr),
sf AS (SELECT * EXCLUDE (adj), least(1.0::DOUBLE, min(adj) OVER (PARTITION BY region ORDER BY p_raw RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM sa),
sup AS (SELECT region, buffer_km, variable FROM loc WHERE {SUPP}),
st AS (SELECT sf.*, sup.region IS NOT NULL AS source_primary_supported, coalesce(paired_n >= 3 AND sup.region IS NOT NULL AND mean_specificity > 0 AND ci_low > 0 AND p_fdr < 0.05, false) AS control_passed FROM sf LEFT JOIN sup USING (region, buffer_km, variable))"""


def spec(spark, sf, src=I.lagged, tests=None):
    tests = loc(spark, sf, src) if tests is None else tests
    return E.paired_specificity(src(spark, sf), displaced(spark, sf, src), tests.filter("supported"), VARS, B, SEED)


@query("sta_09_paired_specificity", SPEC + """ SELECT region, sample_region, buffer_km, variable, paired_n, round(mean_specificity, 6) + 0.0 AS mean_specificity, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_raw, 9) AS p_raw, round(p_fdr, 9) AS p_fdr, source_primary_supported, control_passed,
 CASE WHEN paired_n < 3 THEN 'insufficient_paired_event_units' WHEN NOT source_primary_supported THEN 'source_primary_not_supported' WHEN control_passed THEN 'passed_same_event_displaced_control' ELSE 'specificity_not_supported' END AS control_status FROM st""")
def _(spark, sf):
    return spec(spark, sf).select("region", "sample_region", "buffer_km", "variable", "paired_n", *rr(["mean_specificity", "ci_low", "ci_high"]), *rr(["p_raw", "p_fdr"], 9), "source_primary_supported", "control_passed", "control_status")


@query("sta_09_specificity_gate", SPEC + """ SELECT region, buffer_km, variable, bool_and(source_primary_supported) AS source_primary_supported, count(*) FILTER (paired_n >= 3) AS n_evaluable, count(*) FILTER (control_passed) AS n_passed, count(*) FILTER (control_passed) = 4 AS all_passed,
 CASE WHEN count(*) FILTER (paired_n >= 3) < 4 THEN 'insufficient_wrong_region_coverage' WHEN count(*) FILTER (control_passed) = 4 THEN 'passed_all_wrong_regions' ELSE 'failed_one_or_more_wrong_regions' END AS pair_status FROM st GROUP BY 1, 2, 3""")
def _(spark, sf):
    return E.specificity_summary(spec(spark, sf))


# ---- pressure centres and fronts ------------------------------------------------------------

def prox_rows(spark, sf, src=I.lagged):
    x = src(spark, sf)
    return x.select("event_id", "region", "lag", (F.col("v1") * 100).alias("nearest_cyclone_distance_km"), (F.col("v2") + 990).alias("nearest_cyclone_pressure_hpa"),
                    F.floor("v1").alias("cyclone_count_500km"), (F.floor("v1") + F.floor("v2")).alias("cyclone_count_1000km"))


PROX = I.with_ctes("lagged") + """, px AS (SELECT event_id, region, lag, 'nearest_cyclone_distance_km' AS variable, v1 * 100 AS v FROM lagged UNION ALL SELECT event_id, region, lag, 'nearest_cyclone_pressure_hpa', v2 + 990 FROM lagged UNION ALL SELECT event_id, region, lag, 'cyclone_count_500km', floor(v1) FROM lagged
 UNION ALL SELECT event_id, region, lag, 'cyclone_count_1000km', floor(v1) + floor(v2) FROM lagged), pd AS (SELECT region, event_id, variable, avg(v) FILTER (lag IN (-1, 0, 1)) - avg(v) FILTER (lag IN (-10, -7, -5)) AS difference FROM px GROUP BY 1, 2, 3), """ + tests_sql("pd", ["region", "variable"], "prx", [])


@query("sta_17_proximity_tests", PROX + " SELECT region, variable, n_units, round(m, 5) + 0.0 AS mean_difference, round(p_raw, 6) + 0.0 AS p_raw, round(p_fdr, 6) + 0.0 AS p_fdr, round(ci_low, 5) + 0.0 AS ci_low, round(ci_high, 5) + 0.0 AS ci_high, ci_excludes_zero FROM prx")
def _(spark, sf):
    return E.proximity_tests(prox_rows(spark, sf), B, SEED).select("region", "variable", "n_units", R("mean_difference", 5).alias("mean_difference"), *rr(["p_raw", "p_fdr"]), *rr(["ci_low", "ci_high"], 5), "ci_excludes_zero")


@query("sta_17_proximity_status", PROX + """, hit AS (SELECT region, variable FROM prx WHERE n_units >= 3 AND p_fdr < 0.05 AND ci_excludes_zero AND CASE WHEN variable LIKE 'nearest%' THEN m < 0 ELSE m > 0 END), g AS (SELECT region, string_agg(variable, ';' ORDER BY variable) AS s FROM hit GROUP BY 1),
 e AS (SELECT region, count(*) FILTER (n_units >= 3 AND p_fdr IS NOT NULL) AS n FROM prx GROUP BY 1) SELECT r.region, CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 0 THEN 'insufficient_samples' WHEN s IS NOT NULL THEN 'supported' ELSE 'not_supported' END AS evidence_status, coalesce(s, '') AS supported_variables, coalesce(n, 0) AS evaluated_test_count
 FROM (VALUES ('R0'), ('R1'), ('R2'), ('R3'), ('R4'), ('R9')) r(region) LEFT JOIN e USING (region) LEFT JOIN g USING (region)""")
def _(spark, sf):
    regions = spark.createDataFrame([(r,) for r in (*REGIONS, "R9")], "region string")
    return E.proximity_status(E.proximity_tests(prox_rows(spark, sf), B, SEED), regions).select("region", "evidence_status", "supported_variables", "evaluated_test_count")


def front_rows(spark, sf, src=I.lagged):
    x = src(spark, sf)
    return x.select("event_id", "region", "lag", (F.col("v1") - 1).alias("outward_edge_normal_wind_ms"), F.col("v2").alias("wind_speed_ms"),
                    S.ladder([(F.col("v1") > 1.5, "ok"), (F.col("v1") > 0.5, "degraded")], "reject").alias("qa_status"))


FRONT = I.with_ctes("lagged") + f""", fq AS (SELECT *, CASE WHEN v1 > 1.5 THEN 'ok' WHEN v1 > 0.5 THEN 'degraded' ELSE 'reject' END AS qa FROM lagged), ft AS (SELECT t.tier AS analysis_tier, fq.* FROM fq, (VALUES ('primary', 'ok'), ('sensitivity', 'ok'), ('sensitivity', 'degraded')) t(tier, q) WHERE qa = q),
fv AS (SELECT analysis_tier, region, event_id, lag, 'outward_edge_normal_wind_ms' AS variable, v1 - 1 AS v FROM ft UNION ALL SELECT analysis_tier, region, event_id, lag, 'wind_speed_ms', v2 FROM ft),
fb AS (SELECT analysis_tier, region, event_id, variable, avg(v) AS b FROM fv WHERE lag IN (-10, -7, -5) GROUP BY 1, 2, 3, 4), fg AS (SELECT analysis_tier, region, event_id, variable, lag_group, avg(v) AS e FROM fv, {GROUPS} WHERE list_contains(ls, lag) GROUP BY 1, 2, 3, 4, 5),
fd AS (SELECT analysis_tier, region, event_id, variable, lag_group, e - b AS difference FROM fg JOIN fb USING (analysis_tier, region, event_id, variable)), """ + tests_sql("fd", ["analysis_tier", "region", "variable", "lag_group"], "fr", ["analysis_tier"])


@query("sta_18_front_tests", FRONT + """ SELECT analysis_tier, region, variable, lag_group, n_units, round(m, 9) + 0.0 AS mean_difference, round(p_fdr, 6) + 0.0 AS p_fdr, CASE WHEN coalesce(p_fdr < 0.05 AND ci_excludes_zero AND n_units >= 3, false) THEN CASE analysis_tier WHEN 'primary' THEN 'statistically_supported_dynamic_indicator' ELSE 'sensitivity_dependent_suggestive' END ELSE 'weak_or_insufficient' END AS mechanism_evidence_status FROM fr""")
def _(spark, sf):
    t = E.front_tests(front_rows(spark, sf), B, SEED, variables=("outward_edge_normal_wind_ms", "wind_speed_ms"))
    return t.filter("n_units > 0").select("analysis_tier", "region", "variable", "lag_group", "n_units", R("mean_difference", 9).alias("mean_difference"), R("p_fdr").alias("p_fdr"), "mechanism_evidence_status")


@query("sta_18_front_status", FRONT + """, s AS (SELECT region, count(*) FILTER (n_units >= 3 AND p_fdr IS NOT NULL) AS n, string_agg(CASE WHEN n_units >= 3 AND m > 0 AND p_fdr < 0.05 AND ci_excludes_zero THEN lag_group END, ';' ORDER BY lag_group) AS g FROM fr WHERE variable = 'outward_edge_normal_wind_ms' AND analysis_tier = 'primary' AND lag_group IN ('pre-event', 'event-time') GROUP BY 1)
SELECT region, CASE WHEN n = 0 THEN 'insufficient_samples' WHEN g IS NOT NULL THEN 'supported' ELSE 'not_supported' END AS evidence_status, coalesce(g, '') AS supported_lag_groups FROM s""")
def _(spark, sf):
    t = E.front_tests(front_rows(spark, sf), B, SEED, variables=("outward_edge_normal_wind_ms", "wind_speed_ms"))
    regions = spark.createDataFrame([(r,) for r in REGIONS], "region string")
    return E.front_status(t, regions).select("region", "evidence_status", "supported_lag_groups")


# ---- assembly -----------------------------------------------------------------------------------

YB = EM + f""", ys AS (SELECT region, buffer_km, variable, year, sum(difference) AS s, count(*) AS c FROM em WHERE difference IS NOT NULL GROUP BY 1, 2, 3, 4), yi AS (SELECT *, row_number() OVER (PARTITION BY region, buffer_km, variable ORDER BY CAST(year AS VARCHAR)) - 1 AS i_, count(*) OVER (PARTITION BY region, buffer_km, variable) AS n_ FROM ys),
yd AS (SELECT region, buffer_km, variable, rep.range AS rep, {U32("'11|' || region || '|' || buffer_km || '|' || variable || '|' || rep.range || '|' || (i_ // 4)", 'i_')} % n_ AS j_ FROM yi, range(0, {B}) rep),
yb AS (SELECT d.region, d.buffer_km, d.variable, rep, sum(s) / sum(c) AS mean_ FROM yd d JOIN yi i ON i.region = d.region AND i.buffer_km = d.buffer_km AND i.variable = d.variable AND i.i_ = d.j_ GROUP BY ALL), yc AS (SELECT region, buffer_km, variable, quantile_cont(mean_, 0.025) AS lo, quantile_cont(mean_, 0.975) AS hi FROM yb GROUP BY 1, 2, 3)"""


def year_tests(spark, sf, src=I.lagged):
    u = RS.event_minus_background(src(spark, sf), ["region", "buffer_km"], "event_id", VARS, fixed.EVENT_LAGS, fixed.BACKGROUND_LAGS)
    first = src(spark, sf).groupBy("event_id").agg(F.min("year").alias("year"))
    u = u.join(first, "event_id")
    t = RS.year_block_ci(u, ["region", "buffer_km", "variable"], "difference", "year", B, SEED)
    t = t.withColumn("mean_difference", F.col("primary_mean")).withColumn("n_units", F.col("n_years")).withColumn("ci_excludes_zero", E.excludes_zero())
    return t.withColumn("confirmed", E.year_confirmed())


def once(spark, sf, src=I.lagged):
    """location tests and displaced controls, read by several parts of a query: stored (a row per test)"""
    tests = durable(loc(spark, sf, src))
    return tests, durable(spec(spark, sf, src, tests))


#: Families of the per-region summary.
SUMMED = ("location_buffer", "lead_lag", "wrong_region_control", "year_block_robustness")


def families(spark, sf, src=I.lagged, stored=None, only=None):
    """rows of all families, or of the first four with ``only=SUMMED``"""
    tests, controls = stored or once(spark, sf, src)
    K = lambda f, **a: E.key_grid(spark, f, **a)
    sup = F.coalesce(F.col("supported"), F.lit(False))
    loc_rows = E.fill_family(K("location_buffer", region=REGIONS, variable=VARS, buffer_km=BUFFERS), tests, ["region", "variable", "buffer_km"], sup, F.when(sup, "primary_location_buffer_supported").otherwise("not_primary_supported"))
    lead_rows = E.fill_family(K("lead_lag", region=REGIONS, variable=VARS, lag_group=tuple(fixed.LAG_GROUPS)), lead(spark, sf, src), ["region", "variable", "lag_group"], F.col("significant"), F.col("classification"))
    wrong_keys = K("wrong_region_control", region=REGIONS, wrong_region=REGIONS, variable=VARS, buffer_km=BUFFERS).filter("region <> wrong_region")
    wrong_rows = E.fill_family(wrong_keys, controls.withColumnRenamed("sample_region", "wrong_region"), ["region", "wrong_region", "variable", "buffer_km"], F.col("control_passed"), F.col("control_status"), "paired_n", "mean_specificity")
    y = F.col("ci_excludes_zero")
    year_rows = E.fill_family(K("year_block_robustness", region=REGIONS, variable=VARS, buffer_km=BUFFERS), year_tests(spark, sf, src), ["region", "variable", "buffer_km"], y, F.when(y, "year_block_ci_excludes_zero").otherwise("year_block_ci_includes_zero"))
    if only == SUMMED:
        return assembled(loc_rows, lead_rows, wrong_rows, year_rows)
    regions = spark.createDataFrame([(r,) for r in REGIONS], "region string")
    prox = E.proximity_tests(prox_rows(spark, sf, src), B, SEED)
    near = F.coalesce((F.col("n_units") >= 3) & (F.col("p_fdr") < 0.05) & F.col("ci_excludes_zero") & S.matches_direction("mean_difference", S.ladder([(F.col("variable") == v, d) for v, d in fixed.CYCLONE_DIRECTION.items()], F.lit(None).cast("string"))), F.lit(False))
    prox = prox.join(E.proximity_status(prox, regions).select("region", "evidence_status"), "region")
    prox_rows_ = E.fill_family(K("cyclone_proximity", region=REGIONS, variable=tuple(fixed.CYCLONE_DIRECTION)), prox, ["region", "variable"], near, F.concat(F.lit("region_evidence_status="), F.col("evidence_status")), status=F.col("evidence_status"))
    front = E.front_tests(front_rows(spark, sf, src), B, SEED, variables=WINDS)
    front = front.join(E.front_status(front, regions).select("region", "evidence_status"), "region")
    front_rows_ = E.fill_family(K("ice_edge_relative_wind", analysis_tier=TIERS, region=REGIONS, variable=WINDS, lag_group=tuple(fixed.LAG_GROUPS)), front, ["analysis_tier", "region", "variable", "lag_group"],
                                F.col("mechanism_evidence_status") == "statistically_supported_dynamic_indicator", F.col("mechanism_evidence_status"), status=F.col("evidence_status"))
    return assembled(loc_rows, lead_rows, wrong_rows, year_rows, prox_rows_, front_rows_)


def assembled(*parts):
    out = None
    for part in parts:
        rows = E.to_schema(E.with_ids(part))
        out = rows if out is None else out.unionByName(rows)
    return out


EXPECTED = {"location_buffer": 20, "lead_lag": 30, "wrong_region_control": 80, "year_block_robustness": 20, "cyclone_proximity": 20, "ice_edge_relative_wind": 60}
FAMILIES = SPEC.replace(EM, YB, 1) + LEAD[len(FL):] + PROX[len(I.with_ctes("lagged")):] + FRONT[len(I.with_ctes("lagged")):] + f""", fam AS (
 SELECT 'location_buffer' AS diagnostic_family, NULL AS analysis_tier, region, NULL AS wrong_region, variable, buffer_km, NULL AS lag_group, n_units, m AS effect, p_fdr, coalesce({SUPP}, false) AS supported FROM loc
 UNION ALL SELECT 'lead_lag', NULL, region, NULL, variable, NULL, lag_group, n_units, m, p_fdr, significant FROM lc
 UNION ALL SELECT 'wrong_region_control', NULL, region, sample_region, variable, buffer_km, NULL, paired_n, mean_specificity, p_fdr, control_passed FROM st
 UNION ALL SELECT 'year_block_robustness', NULL, region, NULL, variable, buffer_km, NULL, y.n, y.m, NULL, lo * hi > 0 FROM yc JOIN (SELECT region, buffer_km, variable, count(*) AS n, sum(s) / sum(c) AS m FROM ys GROUP BY 1, 2, 3) y USING (region, buffer_km, variable)
 UNION ALL SELECT 'cyclone_proximity', NULL, region, NULL, variable, NULL, NULL, n_units, m, p_fdr, coalesce(n_units >= 3 AND p_fdr < 0.05 AND ci_excludes_zero AND CASE WHEN variable LIKE 'nearest%' THEN m < 0 ELSE m > 0 END, false) FROM prx
 UNION ALL SELECT 'ice_edge_relative_wind', analysis_tier, region, NULL, variable, NULL, lag_group, n_units, m, p_fdr, coalesce(analysis_tier = 'primary' AND p_fdr < 0.05 AND ci_excludes_zero AND n_units >= 3, false) FROM fr)"""


@query("evi_01_joi_27_flt_14_assembled", FAMILIES + " SELECT diagnostic_family, analysis_tier, region, wrong_region, variable, CAST(buffer_km AS INTEGER) AS buffer_km, lag_group, CAST(n_units AS BIGINT) AS n_units, round(effect, 6) + 0.0 AS effect, round(p_fdr, 6) + 0.0 AS p_fdr, supported AS supported_or_significant FROM fam")
def _(spark, sf):
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return families(spark, sf).select("diagnostic_family", text("analysis_tier"), "region", text("wrong_region"), "variable", "buffer_km", text("lag_group"), "n_units", *rr(["effect", "p_fdr"]), "supported_or_significant")


@query("evi_01_family_counts", FAMILIES + """, kept AS (SELECT * FROM fam WHERE NOT (diagnostic_family = 'lead_lag' AND region = 'R3')), want AS (SELECT * FROM (VALUES ('location_buffer', 20), ('lead_lag', 30), ('wrong_region_control', 80), ('year_block_robustness', 20), ('cyclone_proximity', 20), ('ice_edge_relative_wind', 60)) v(f, n))
SELECT f AS diagnostic_family, CAST(n AS INTEGER) AS expected, count(diagnostic_family) AS actual, CASE WHEN count(diagnostic_family) = n THEN 'PASS' ELSE 'FAIL' END AS status FROM want LEFT JOIN kept ON diagnostic_family = f GROUP BY f, n""")
def _(spark, sf):
    # defect: one region's leads are missing
    return E.family_counts(families(spark, sf).filter("NOT (diagnostic_family = 'lead_lag' AND region = 'R3')"), EXPECTED)


@query("evi_02_region_summary", SPEC.replace(EM, YB, 1) + LEAD[len(FL):] + f""", lw AS (SELECT region, variable, bool_or({SUPP}) AS prim FROM loc GROUP BY 1, 2), yw AS (SELECT region, variable, bool_or(lo * hi > 0) AS yr FROM yc GROUP BY 1, 2), tw AS (SELECT region, variable, bool_or(significant) AS tmp FROM lc GROUP BY 1, 2),
 sw AS (SELECT region, variable, bool_or(p = 4) AS spx FROM (SELECT region, buffer_km, variable, count(*) FILTER (control_passed) AS p FROM st GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT region, variable, prim AS primary_supported, CASE WHEN prim AND tmp AND spx AND yr THEN 'SUPPORTED_WITH_ROBUSTNESS' WHEN prim THEN 'SUPPORTED_PRIMARY_ONLY' ELSE 'NOT_SUPPORTED' END AS manuscript_status FROM lw JOIN yw USING (region, variable) JOIN sw USING (region, variable) JOIN tw USING (region, variable)""")
def _(spark, sf):
    stored = once(spark, sf)
    s = E.region_summary(families(spark, sf, stored=stored, only=SUMMED), E.specificity_summary(stored[1]))
    return s.select("region", "variable", "primary_supported", "manuscript_status")


TEXT = lambda c: f"coalesce(printf('%.12g', {c} + 0.0), 'NA')"
SUMMARY = FAMILIES + f""", t1 AS (SELECT region, variable, string_agg(buffer_km || 'km:effect=' || {TEXT('m')} || ',CI=[' || {TEXT('ci_low')} || ',' || {TEXT('ci_high')} || '],p_FDR=' || {TEXT('round(p_fdr, 9)')}, ';' ORDER BY buffer_km) AS primary_effect_ci_p_fdr, bool_or(coalesce({SUPP}, false)) AS primary_supported FROM loc GROUP BY 1, 2),
t2 AS (SELECT region, variable, max(t) FILTER (lag_group = 'pre-event') AS pre_event_support, max(t) FILTER (lag_group = 'event-time') AS event_time_support, max(t) FILTER (lag_group = 'post-event') AS post_event_support, bool_or(significant) AS tmp FROM (SELECT *, 'significant=' || significant || ';effect=' || {TEXT('m')} AS t FROM lc) GROUP BY 1, 2),
t3 AS (SELECT region, variable, string_agg(buffer_km || 'km:confirmed=' || (lo * hi > 0), ';' ORDER BY buffer_km) AS year_block_confirmation, bool_or(lo * hi > 0) AS yr FROM yc GROUP BY 1, 2),
t4 AS (SELECT region, variable, string_agg(buffer_km || 'km:' || p || '/4;all=' || (p = 4), ';' ORDER BY buffer_km) AS wrong_region_specificity, bool_or(p = 4) AS spx FROM (SELECT region, buffer_km, variable, count(*) FILTER (control_passed) AS p FROM st GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("evi_02_region_summary_text", SUMMARY + """ SELECT region, variable, primary_effect_ci_p_fdr, primary_supported, pre_event_support, event_time_support, post_event_support, year_block_confirmation, wrong_region_specificity,
 CASE WHEN primary_supported AND tmp AND spx AND yr THEN 'SUPPORTED_WITH_ROBUSTNESS' WHEN primary_supported THEN 'SUPPORTED_PRIMARY_ONLY' ELSE 'NOT_SUPPORTED' END AS manuscript_status FROM t1 JOIN t2 USING (region, variable) JOIN t3 USING (region, variable) JOIN t4 USING (region, variable)""")
def _(spark, sf):
    # the SQL side knows small p values to nine decimals only
    stored = once(spark, sf)
    return E.region_summary(families(spark, sf, stored=stored, only=SUMMED).withColumn("p_fdr", R("p_fdr", 9)), E.specificity_summary(stored[1]))


@query("evi_03_completeness", FAMILIES + """, kept AS (SELECT * FROM fam WHERE NOT (diagnostic_family = 'wrong_region_control' AND region = 'R2' AND buffer_km = (SELECT max(buffer_km) FROM loc))), p AS (SELECT region, variable, count(*) FILTER (diagnostic_family = 'location_buffer') AS location_buffer, count(*) FILTER (diagnostic_family = 'lead_lag') AS lead_lag, count(*) FILTER (diagnostic_family = 'wrong_region_control') AS wrong_region_control,
 count(*) FILTER (diagnostic_family = 'year_block_robustness') AS year_block_robustness FROM kept WHERE variable IN ('v1', 'v2') GROUP BY 1, 2) SELECT *, CASE WHEN location_buffer = 2 AND lead_lag = 3 AND wrong_region_control = 8 AND year_block_robustness = 2 THEN 'COMPLETE_SYMMETRIC' ELSE 'INCOMPLETE' END AS comparison_status FROM p""")
def _(spark, sf):
    rows = families(spark, sf).filter(F.col("variable").isin(*VARS))
    # defect: one region's controls at the widest radius are missing
    rows = rows.filter(~((F.col("diagnostic_family") == "wrong_region_control") & (F.col("region") == "R2") & (F.col("buffer_km") == max(BUFFERS))))
    return E.completeness(rows, {"location_buffer": 2, "lead_lag": 3, "wrong_region_control": 8, "year_block_robustness": 2})


def floored(spark, sf):
    """the same samples with the low values left out: the second scenario"""
    return I.lagged(spark, sf).withColumn("v1", F.when(F.col("v1") >= 0.75, F.col("v1")))


FL2 = ", fl2 AS (SELECT region, buffer_km, event_id, lag, variable, CASE WHEN variable = 'v2' OR v >= 0.75 THEN v END AS v FROM fl), em2 AS (SELECT region, buffer_km, event_id, variable, avg(v) FILTER (lag IN (-1, 0)) - avg(v) FILTER (lag IN (-10, -7, -5)) AS difference FROM fl2 GROUP BY 1, 2, 3, 4), " + tests_sql("em2", ["region", "buffer_km", "variable"], "lof", [])
CMP = """,
cmp AS (SELECT region, buffer_km, variable, l.m AS primary_effect, f.m AS floor_effect, coalesce(l.n_units >= 3 AND l.p_fdr < 0.05 AND l.ci_excludes_zero AND abs(l.std) >= 0.2, false) AS primary_supported, coalesce(f.n_units >= 3 AND f.p_fdr < 0.05 AND f.ci_excludes_zero AND abs(f.std) >= 0.2, false) AS floor_supported FROM loc l JOIN lof f USING (region, buffer_km, variable))"""
FLOOR = LOC + FL2 + CMP


def scenario_rows(primary, floor):
    pick = lambda t: t.select("region", "buffer_km", "variable", F.col("mean_difference").alias("effect"), "supported")
    p = J.paired_tables(pick(primary), pick(floor), ["region", "buffer_km", "variable"])
    return E.scenario_comparison(p, ["region", "buffer_km", "variable"])


@query("evi_06_evi_10_scenario_comparison", FLOOR + " SELECT region, buffer_km, variable, round(primary_effect, 6) + 0.0 AS primary_effect, round(floor_effect, 6) + 0.0 AS floor_effect, primary_supported, floor_supported, sign(primary_effect) = sign(floor_effect) AS direction_preserved, primary_supported = floor_supported AS status_preserved FROM cmp")
def _(spark, sf):
    return scenario_rows(loc(spark, sf), loc(spark, sf, floored)).select("region", "buffer_km", "variable", *rr(["primary_effect", "floor_effect"]), "primary_supported", "floor_supported", "direction_preserved", "status_preserved")


_LAGGED = I.with_ctes("lagged")
FLOORED_INPUT = _LAGGED.replace("lagged AS (", "lagged0 AS (", 1) + ", lagged AS (SELECT * REPLACE (CASE WHEN v1 >= 0.75 THEN v1 END AS v1) FROM lagged0)"
FLOORED = FLOORED_INPUT + FAMILIES[len(_LAGGED):]
KEY = ["diagnostic_family", "analysis_tier", "region", "wrong_region", "variable", "buffer_km", "lag_group"]


@query("evi_10_scenario_families", f"WITH a AS ({FAMILIES} SELECT * FROM fam), b AS ({FLOORED} SELECT * FROM fam) SELECT " + ", ".join(f"CAST(a.{c} AS INTEGER) AS {c}" if c == "buffer_km" else f"a.{c}" for c in KEY) + """, round(a.effect, 6) + 0.0 AS primary_effect, round(b.effect, 6) + 0.0 AS floor_effect, a.supported AS primary_supported, b.supported AS floor_supported,
 coalesce(sign(a.effect) = sign(b.effect), false) AS direction_preserved, a.supported = b.supported AS status_preserved FROM a JOIN b ON """ + " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in KEY))
def _(spark, sf):
    """all six families under both scenarios, row by row"""
    pick = lambda t: t.select("evidence_id", *[F.nullif(F.col(c), F.lit("")).alias(c) if c in ("analysis_tier", "wrong_region", "lag_group") else F.col(c) for c in KEY], "effect", F.col("supported_or_significant").alias("supported"))
    p = J.paired_tables(pick(families(spark, sf)), pick(families(spark, sf, floored)).drop(*KEY), ["evidence_id"])
    r = E.scenario_comparison(p.withColumnsRenamed({f"primary_{c}": c for c in KEY}), ["evidence_id"])
    return r.select(*KEY, *rr(["primary_effect", "floor_effect"]), "primary_supported", "floor_supported", F.coalesce("direction_preserved", F.lit(False)).alias("direction_preserved"), "status_preserved")


@query("agg_42_comparison_by_region", FLOOR + " SELECT region, 'location_buffer' AS diagnostic, count(*) FILTER (primary_supported) AS n_primary_supported, count(*) FILTER (floor_supported) AS n_floor_supported, count(*) AS n_rows, bool_and(primary_supported = floor_supported) AS status_preserved, bool_and(sign(primary_effect) = sign(floor_effect)) AS direction_preserved FROM cmp GROUP BY 1")
def _(spark, sf):
    return E.comparison_by_region(scenario_rows(loc(spark, sf), loc(spark, sf, floored)).withColumn("diagnostic", F.lit("location_buffer")))


STABLE = SPEC.replace(EM, YB, 1) + f""", g4 AS (SELECT region, buffer_km, variable, count(*) FILTER (control_passed) = 4 AS sp FROM st GROUP BY 1, 2, 3), g5 AS (SELECT region, buffer_km, variable, count(*) >= 2 AND sum(c) >= 3 AS enough FROM ys GROUP BY 1, 2, 3)
SELECT region, buffer_km, variable, {SUPP} AS supported, coalesce(sp, false) AS sp, coalesce(enough AND lo * hi > 0, false) AS confirmed FROM loc LEFT JOIN g4 USING (region, buffer_km, variable) LEFT JOIN yc USING (region, buffer_km, variable) LEFT JOIN g5 USING (region, buffer_km, variable)"""


@query("evi_04_stable_specificity", f"WITH a AS ({STABLE}), b AS ({STABLE.replace(_LAGGED, FLOORED_INPUT, 1)}), " + """c AS (SELECT region, buffer_km, variable, a.supported AS primary_supported, b.supported AS floor_supported, a.sp AS primary_specific, b.sp AS floor_specific, a.confirmed AS primary_confirmed, b.confirmed AS floor_confirmed,
 a.supported AND b.supported AND a.sp AND b.sp AND a.confirmed AND b.confirmed AS stable_spatial_specificity FROM a JOIN b USING (region, buffer_km, variable)), n AS (SELECT variable, count(DISTINCT region) FILTER (stable_spatial_specificity) AS n_regions FROM c GROUP BY 1)
SELECT c.*, n_regions, (SELECT max(n_regions) FROM n) AS max_regions FROM c JOIN n USING (variable)""")
def _(spark, sf):
    """support, specificity and confirmation of both scenarios, each from its own samples"""
    keys = ["region", "buffer_km", "variable"]
    tests, sp, y = {}, None, None
    for tag, src in (("primary", I.lagged), ("floor", floored)):
        tests[tag] = durable(loc(spark, sf, src))
        one = E.specificity_summary(spec(spark, sf, src, tests[tag])).select(*keys, F.col("all_passed").alias(f"{tag}_specific"))
        sp = one if sp is None else sp.join(one, keys, "full")
        one = year_tests(spark, sf, src).select(*keys, F.col("confirmed").alias(f"{tag}_confirmed"))
        y = one if y is None else y.join(one, keys, "full")
    rows = scenario_rows(tests["primary"], tests["floor"]).select(*keys, "primary_supported", "floor_supported")
    checks, regions = E.stable_specificity(rows, sp, y)
    return checks.join(regions, "variable").select(*keys, "primary_supported", "floor_supported", "primary_specific", "floor_specific", "primary_confirmed", "floor_confirmed", "stable_spatial_specificity", "n_regions", "max_regions")


SCORES = SPEC.replace(EM, YB, 1) + LEAD[len(FL):] + ", " + I.EVENTS + """, c0 AS (SELECT dominant_region AS region, avg(CAST(cumulative_loss > 400 AS INTEGER)) AS f, count(*) FILTER (cumulative_loss > 400) AS n, count(*) AS k FROM ev GROUP BY 1),
s0 AS (SELECT region, count(DISTINCT variable) AS sv FROM sup GROUP BY 1), g4 AS (SELECT region, buffer_km, variable FROM st GROUP BY 1, 2, 3 HAVING count(*) FILTER (control_passed) = 4), s1 AS (SELECT DISTINCT region FROM sup JOIN g4 USING (region, buffer_km, variable)), s2 AS (SELECT DISTINCT region FROM sup JOIN yc USING (region, buffer_km, variable) WHERE lo * hi > 0), s3 AS (SELECT DISTINCT region FROM lc WHERE significant AND variable = 'v1' AND lag_group IN ('pre-event', 'event-time')),
m0 AS (SELECT c0.region, CASE WHEN f >= 0.2 AND n >= 30 AND k >= 25 THEN 4 WHEN f >= 0.1 AND n >= 20 AND k >= 15 THEN 3 ELSE 1 END AS a, CASE WHEN coalesce(sv, 0) >= 3 THEN 4 WHEN coalesce(sv, 0) >= 1 THEN 3 ELSE 1 END AS b, CASE WHEN s3.region IS NOT NULL THEN 3 ELSE 1 END AS l, CASE WHEN s1.region IS NOT NULL THEN 3 ELSE 1 END AS w, CASE WHEN s2.region IS NOT NULL THEN 3 ELSE 1 END AS y
 FROM c0 LEFT JOIN s0 ON s0.region = c0.region LEFT JOIN s1 ON s1.region = c0.region LEFT JOIN s2 ON s2.region = c0.region LEFT JOIN s3 ON s3.region = c0.region)"""


FOCUS = {"R0": "beaufort_sea", "R1": "laptev_sea", "R2": "kara_sea", "R3": "barents_sea", "R4": "central_arctic"}
REGIME = """, pxs AS (SELECT region, bool_or(coalesce(n_units >= 3 AND p_fdr < 0.05 AND ci_excludes_zero AND CASE WHEN variable LIKE 'nearest%' THEN m < 0 ELSE m > 0 END, false)) AS supported FROM prx GROUP BY 1),
m1 AS (SELECT CASE m0.region WHEN 'R0' THEN 'beaufort_sea' WHEN 'R1' THEN 'laptev_sea' WHEN 'R2' THEN 'kara_sea' WHEN 'R3' THEN 'barents_sea' ELSE 'central_arctic' END AS region, a, b, l, w, y, coalesce(pxs.supported, false) AS px FROM m0 LEFT JOIN pxs USING (region)),
m2 AS (SELECT *, CASE region WHEN 'beaufort_sea' THEN CASE WHEN a >= 4 AND b >= 4 AND w >= 3 AND y >= 3 THEN 'Strong preconditioned/compound regime' WHEN a >= 3 AND b >= 3 AND (w >= 3 OR y >= 3) THEN 'Moderate preconditioned/compound regime' ELSE 'Preconditioned/compound suggestive regime' END
 WHEN 'laptev_sea' THEN CASE WHEN l >= 3 AND w >= 2 THEN 'Dynamic-loss regime with contemporaneous forcing' ELSE 'Dynamic-loss suggestive regime' END WHEN 'kara_sea' THEN CASE WHEN px AND l >= 3 AND b >= 3 THEN 'Moderate atmospheric-dynamic regime' ELSE 'Atmospheric-dynamic suggestive regime' END
 WHEN 'barents_sea' THEN 'Barents Sea atmospheric/compound suggestive regime; ocean heat not tested' ELSE '@CENTRAL weak/threshold-sensitive regime' END AS assigned_regime, CASE WHEN region = 'central_arctic' THEN least(a, 1) ELSE a END AS a2, (a + b + l + w + y) / 5.0 AS mean0 FROM m1)""".replace("@CENTRAL", fixed.REGION_LABELS["central_arctic"]["en"])


@query("evi_05_score_matrix", SCORES + PROX[len(I.with_ctes("lagged")):] + REGIME + """ SELECT region, a2 AS major_severe_cluster_support, b AS location_buffer_support, l AS lead_lag_directionality, w AS wrong_region_control, y AS year_block_bootstrap, round((a2 + b + l + w + y) / 5.0::DOUBLE, 6) AS mean_score,
 CASE WHEN region IN ('central_arctic', 'barents_sea') THEN 'weak' WHEN assigned_regime = 'Atmospheric-dynamic suggestive regime' THEN 'suggestive' WHEN mean0 >= 3.5 THEN 'strong' WHEN mean0 >= 2.7 THEN 'moderate' WHEN mean0 >= 1.8 THEN 'suggestive' ELSE 'weak' END AS confidence_level, assigned_regime FROM m2""")
def _(spark, sf):
    e = I.events(spark, sf).withColumnRenamed("dominant_region", "region")
    counts = e.groupBy("region").agg(F.avg((F.col("cumulative_loss") > 400).cast("int")).alias("fraction"), F.count_if(F.col("cumulative_loss") > 400).alias("major"), F.count(F.lit(1)).alias("clusters"))
    keys = ["region", "variable", "buffer_km"]
    tests, controls = once(spark, sf)
    sup = tests.filter("supported").select(*keys)
    ctl = E.specificity_summary(controls).select(*keys, F.col("all_passed").alias("ok"))
    yb = year_tests(spark, sf).select(*keys, F.col("ci_excludes_zero").alias("ok"))
    m = E.score_matrix(counts, sup, ctl, yb, lead(spark, sf), dynamic_variables=("v1",))
    prox = E.proximity_status(E.proximity_tests(prox_rows(spark, sf), B, SEED), counts.select("region"))
    named = lambda t: t.replace(FOCUS, subset=["region"])  # the focus regions have rules of their own
    return E.regime(named(m), named(prox)).withColumn("mean_score", R("mean_score"))


@query("evi_07_cross_scale_map", I.with_ctes("ev", "pan") + ", " + EVF + f""", c AS (SELECT e.event_id, {hav('e.', 'q.')} AS km FROM evf e JOIN pnf q ON abs(q.event_date - e.event_date) <= 3), n AS (SELECT event_id, min(km) AS km FROM c GROUP BY 1)
SELECT evf.event_id, n.event_id IS NOT NULL AS temporal_link, coalesce(km <= 300, false) AS link_300km, coalesce(km <= 500, false) AS link_500km, CAST(evf.event_id[2:] AS BIGINT) % 3 = 0 AS footprint_linked FROM evf LEFT JOIN n USING (event_id)""")
def _(spark, sf):
    links = I.events(spark, sf).filter("overlap_with_series_event").select(F.col("unique_local_event_id").alias("event_id"))
    m = E.cross_scale_map(ev_frame(spark, sf), I.pan(spark, sf), links)
    return m.select("event_id", "temporal_link", "link_300km", "link_500km", "footprint_linked")


@query("evi_09_effect_display", I.with_ctes("diffs") + """, n AS (SELECT metric, unit_id, difference, row_number() OVER (PARTITION BY metric ORDER BY difference, unit_id) AS rn FROM diffs), s AS (SELECT metric, avg(difference) AS m, quantile_cont(difference, 0.5) AS md FROM diffs GROUP BY 1)
SELECT metric, unit_id, difference, rn, (rn % 9 - 4) / 10.0::DOUBLE AS offset_y, round(m, 6) + 0.0 AS mean_line, round(md, 6) + 0.0 AS median_line, CASE WHEN difference > 0 THEN 'above' WHEN difference < 0 THEN 'below' ELSE 'at' END AS side FROM n JOIN s USING (metric)""")
def _(spark, sf):
    from ..operators import display as D
    d = D.effect_points(I.diffs(spark, sf), ["metric"], "difference", "unit_id")
    return d.select("metric", "unit_id", "difference", "rn", "offset_y", *rr(["mean_line", "median_line"]), "side")


@query("evi_09_paired_deltas", I.with_ctes("lagged") + """, t AS (SELECT region, lag, buffer_km, avg(v1) AS m FROM lagged GROUP BY 1, 2, 3) SELECT a.region, a.lag, a.buffer_km, round(a.m, 6) + 0.0 AS value, round(a.m - b.m, 6) + 0.0 AS delta_to_reference FROM t a JOIN t b ON b.region = a.region AND b.lag = a.lag AND b.buffer_km = 100""")
def _(spark, sf):
    from ..operators import display as D
    t = I.lagged(spark, sf).groupBy("region", "lag", "buffer_km").agg(F.avg("v1").alias("value"))
    return D.delta_to_reference(t, ["region", "lag"], F.col("buffer_km") == 100, "value").select("region", "lag", "buffer_km", *rr(["value", "delta_to_reference"]))


@query("evi_09_status_counts", LOC + f" SELECT CASE WHEN {SUPP} THEN 'supported' ELSE 'not_supported' END AS status, count(*) AS n FROM loc GROUP BY 1")
def _(spark, sf):
    return loc(spark, sf).groupBy(F.when(F.col("supported"), "supported").otherwise("not_supported").alias("status")).agg(F.count(F.lit(1)).alias("n"))
