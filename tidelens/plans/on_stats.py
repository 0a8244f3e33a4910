"""Statistics queries: WIN-11, AGG-33..35, SCA-17, STA-01..08/10/11, FLT-13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S, stats as ST
from ..operators import resample as RS
from . import inputs as I
from .registry import query

R = S.rounded
B, SEED = 200, 11


def rr(cols, digits=6):
    return [R(c, digits).alias(c) for c in cols]


U32 = lambda text, slot: f"('0x' || substr(md5({text}), CAST(1 + 8 * ({slot} % 4) AS INTEGER), 8))::BIGINT"
DI = I.with_ctes("diffs")
BOOT = DI + f""", ix AS (SELECT *, row_number() OVER (PARTITION BY family, metric ORDER BY unit_id) - 1 AS i, count(*) OVER (PARTITION BY family, metric) AS n FROM diffs),
dr AS (SELECT family, metric, rep.range AS rep, {U32("'11|' || family || '|' || metric || '|' || rep.range || '|' || (i // 4)", 'i')} % n AS j FROM ix, range(0, {B}) rep),
bm AS (SELECT dr.family, dr.metric, rep, avg(difference) AS mean FROM dr JOIN ix ON ix.family = dr.family AND ix.metric = dr.metric AND ix.i = dr.j GROUP BY 1, 2, 3),
ci AS (SELECT family, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM bm GROUP BY 1, 2)"""
FLIP = f""", fm AS (SELECT family, metric, rep.range AS rep, avg(difference * ({U32("'11|' || family || '|' || metric || '|s|' || unit_id || '|' || (rep.range // 4)", 'rep.range')} % 2 * 2 - 1)) AS mean FROM diffs, range(0, {B}) rep GROUP BY 1, 2, 3),
ob AS (SELECT family, metric, avg(difference) AS obs, count(*) AS n FROM diffs GROUP BY 1, 2)"""
KEYS = ["family", "metric"]


@query("sta_02_bootstrap_ci", BOOT + " SELECT family, metric, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high FROM ci")
def _(spark, sf):
    return RS.bootstrap_ci(I.diffs(spark, sf), KEYS, "difference", "unit_id", B, SEED).select(*KEYS, *rr(["ci_low", "ci_high"]))


@query("sta_02_bootstrap_ci_pages", BOOT + " SELECT family, metric, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high FROM ci")
def _(spark, sf):
    return RS.bootstrap_ci(I.diffs(spark, sf), KEYS, "difference", "unit_id", B, SEED, page=10).select(*KEYS, *rr(["ci_low", "ci_high"]))


@query("sta_02_bootstrap_difference", DI + f""", s AS (SELECT metric, CASE WHEN year < 1996 THEN 'a' ELSE 'b' END AS side, unit_id, difference FROM diffs), ix AS (SELECT *, row_number() OVER (PARTITION BY metric, side ORDER BY unit_id) - 1 AS i, count(*) OVER (PARTITION BY metric, side) AS n FROM s),
dr AS (SELECT metric, side, rep.range AS rep, {U32("'11|' || metric || '|' || side || '|' || rep.range || '|' || (i // 4)", 'i')} % n AS j FROM ix, range(0, {B}) rep),
bm AS (SELECT dr.metric, dr.side, rep, avg(difference) AS mean FROM dr JOIN ix ON ix.metric = dr.metric AND ix.side = dr.side AND ix.i = dr.j GROUP BY 1, 2, 3), d AS (SELECT metric, rep, max(mean) FILTER (side = 'a') - max(mean) FILTER (side = 'b') AS d FROM bm GROUP BY 1, 2)
SELECT metric, round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high FROM d GROUP BY 1""")
def _(spark, sf):
    d = I.diffs(spark, sf).withColumn("side", F.when(F.col("year") < 1996, "a").otherwise("b"))
    return RS.bootstrap_ci_of_difference(d, ["metric"], "side", "difference", "unit_id", B, SEED).select("metric", *rr(["ci_low", "ci_high"]))


for _alt, _cond in (("greater", "mean >= obs - 1e-12"), ("less", "mean <= obs + 1e-12"), ("two-sided", "abs(mean) >= abs(obs) - 1e-12")):
    @query(f"sta_03_sign_flip_{_alt.replace('-', '_')}", DI + FLIP + f" SELECT family, metric, round((count(*) FILTER ({_cond}) + 1) / {B + 1}.0::DOUBLE, 9) AS p_raw, round(avg(CAST(mean < obs - 1e-12 AS INTEGER)), 6) + 0.0 AS effect_percentile FROM fm JOIN ob USING (family, metric) GROUP BY 1, 2")
    def _(spark, sf, alt=_alt):
        return RS.sign_flip_p(I.diffs(spark, sf), KEYS, "difference", "unit_id", B, SEED, alt).select(*KEYS, R("p_raw", 9).alias("p_raw"), R("effect_percentile").alias("effect_percentile"))


YEARS = DI + f""", per AS (SELECT family, metric, year, sum(difference) AS s, count(*) AS c FROM diffs GROUP BY 1, 2, 3), ix AS (SELECT *, row_number() OVER (PARTITION BY family, metric ORDER BY CAST(year AS VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY family, metric) AS n FROM per),
dr AS (SELECT family, metric, rep.range AS rep, {U32("'11|' || family || '|' || metric || '|' || rep.range || '|' || (i // 4)", 'i')} % n AS j FROM ix, range(0, {B}) rep), bm AS (SELECT dr.family, dr.metric, rep, sum(s) / sum(c) AS mean FROM dr JOIN ix ON ix.family = dr.family AND ix.metric = dr.metric AND ix.i = dr.j GROUP BY 1, 2, 3),
yb AS (SELECT family, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM bm GROUP BY 1, 2), hd AS (SELECT family, metric, count(*) AS n_years, sum(c) AS n_events, sum(s) / sum(c) AS primary_mean FROM per GROUP BY 1, 2)"""


@query("sta_04_year_block_ci", YEARS + " SELECT family, metric, CAST(n_events AS BIGINT) AS n_events, n_years, round(primary_mean, 6) + 0.0 AS primary_mean, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high FROM hd JOIN yb USING (family, metric)")
def _(spark, sf):
    return RS.year_block_ci(I.diffs(spark, sf), KEYS, "difference", "year", B, SEED).select(*KEYS, "n_events", "n_years", *rr(["primary_mean", "ci_low", "ci_high"]))


@query("sta_05_confirmation", YEARS + """ SELECT family, metric, CASE WHEN primary_mean > 0 THEN 'positive' WHEN primary_mean < 0 THEN 'negative' ELSE 'zero' END AS primary_direction, CASE WHEN ci_low > 0 THEN 'positive' WHEN ci_high < 0 THEN 'negative' ELSE 'crosses_zero' END AS ci_direction,
 CASE WHEN n_years < 2 THEN 'supported_but_year_block_confirmation_insufficient' WHEN primary_mean = 0 THEN 'supported_but_year_block_confirmation_insufficient' WHEN NOT (ci_low > 0 OR ci_high < 0) THEN 'supported_but_not_year_block_confirmed'
 WHEN (ci_low > 0) <> (primary_mean > 0) THEN 'supported_but_year_block_direction_conflict' ELSE 'supported_year_block_confirmed' END AS final_interpretation_status FROM hd JOIN yb USING (family, metric)""")
def _(spark, sf):
    c = RS.confirmation(RS.year_block_ci(I.diffs(spark, sf), KEYS, "difference", "year", B, SEED))
    return c.select(*KEYS, "primary_direction", "ci_direction", "final_interpretation_status")


def infer(spark, sf):
    from ..operators import controls as C
    return C.infer_family(I.diffs(spark, sf), B, SEED, unit="unit_id", alternatives={"coloss": "greater"})


INFER = BOOT + FLIP + f""", pr AS (SELECT family, metric, (count(*) FILTER (CASE WHEN family = 'coloss' THEN mean >= obs - 1e-12 ELSE abs(mean) >= abs(obs) - 1e-12 END) + 1) / {B + 1}.0::DOUBLE AS p_raw FROM fm JOIN ob USING (family, metric) GROUP BY 1, 2),
ad AS (SELECT *, p_raw * count(*) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p_raw) + count(*) OVER (PARTITION BY family, p_raw) - 1) AS a FROM pr),
fd AS (SELECT *, least(1.0::DOUBLE, min(a) OVER (PARTITION BY family ORDER BY p_raw RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM ad), md AS (SELECT family, metric, quantile_cont(difference, 0.5) AS median_difference FROM diffs GROUP BY 1, 2)"""


@query("sta_06_family_inference", INFER + """ SELECT family, metric, n AS n_events, round(obs, 6) + 0.0 AS mean_difference, round(median_difference, 6) + 0.0 AS median_difference, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_raw, 9) AS p_raw, round(p_fdr, 9) AS p_fdr,
 CASE WHEN n < 10 THEN 'insufficient_samples' WHEN p_fdr < 0.05 THEN 'supported' ELSE 'not_supported' END AS status FROM fd JOIN ob USING (family, metric) JOIN ci USING (family, metric) JOIN md USING (family, metric)""")
def _(spark, sf):
    return infer(spark, sf).select(*KEYS, "n_events", *rr(["mean_difference", "median_difference", "ci_low", "ci_high"]), *rr(["p_raw", "p_fdr"], 9), "status")


@query("win_11_fdr_by_family", I.with_ctes("lagged") + """, t AS (SELECT region AS family, event_id || '-' || lag || '-' || buffer_km AS test_id, (sum(v1) * 1024 % 997) / 997.0::DOUBLE AS p FROM lagged GROUP BY region, event_id, lag, buffer_km),
a AS (SELECT *, p * count(p) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1) AS adj FROM t)
SELECT family, test_id, round(least(1.0::DOUBLE, min(adj) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_fdr FROM a""")
def _(spark, sf):
    g = I.lagged(spark, sf).groupBy(F.col("region").alias("family"), "event_id", "lag", "buffer_km").agg(F.sum("v1").alias("s"))
    t = g.select("family", F.concat_ws("-", "event_id", "lag", "buffer_km").alias("test_id"), (F.col("s") * 1024 % 997 / 997.0).alias("p"))
    return RS.fdr_bh_large(t, ["family"], "p").select("family", "test_id", R("p_fdr", 9).alias("p_fdr"))


L = I.with_ctes("lagged")
EMB = """, fl AS (SELECT region, buffer_km, event_id, year, lag, 'v1' AS variable, v1 AS v FROM lagged UNION ALL SELECT region, buffer_km, event_id, year, lag, 'v2', v2 FROM lagged),
em AS (SELECT region, buffer_km, event_id, variable, avg(v) FILTER (lag IN (-1, 0)) AS event_mean, avg(v) FILTER (lag IN (-10, -7, -5)) AS background_mean, count(v) FILTER (lag IN (-1, 0)) AS event_observations, count(v) FILTER (lag IN (-10, -7, -5)) AS background_observations FROM fl GROUP BY 1, 2, 3, 4)"""


def units(spark, sf, keys=("region", "buffer_km")):
    from ..functions import fixed
    return RS.event_minus_background(I.lagged(spark, sf), list(keys), "event_id", ["v1", "v2"], fixed.EVENT_LAGS, fixed.BACKGROUND_LAGS)


@query("agg_35_event_minus_background", L + EMB + " SELECT region, buffer_km, event_id, variable, event_observations, background_observations, round(event_mean - background_mean, 9) + 0.0 AS difference FROM em")
def _(spark, sf):
    return units(spark, sf).select("region", "buffer_km", "event_id", "variable", "event_observations", "background_observations", R("difference", 9).alias("difference"))


@query("agg_33_lag_composites", L + " SELECT region, buffer_km, lag, round(avg(v1), 6) + 0.0 AS v1, round(avg(v2), 6) + 0.0 AS v2 FROM lagged GROUP BY 1, 2, 3")
def _(spark, sf):
    return I.lagged(spark, sf).groupBy("region", "buffer_km", "lag").agg(R(F.avg("v1")).alias("v1"), R(F.avg("v2")).alias("v2"))


ONE = EMB + """, st AS (SELECT region, buffer_km, variable, count(event_mean - background_mean) AS n_units, avg(event_mean - background_mean) AS m, stddev_samp(event_mean - background_mean) AS sd FROM em GROUP BY 1, 2, 3)"""


@query("sta_01_one_sample", L + ONE + " SELECT region, buffer_km, variable, n_units, round(m, 6) + 0.0 AS mean_difference, CASE WHEN n_units >= 2 AND sd > 0 THEN round(m / sd, 6) + 0.0 END AS standardized FROM st")
def _(spark, sf):
    s = RS.one_sample(units(spark, sf), ["region", "buffer_km", "variable"], "difference")
    return s.select("region", "buffer_km", "variable", "n_units", R("mean_difference").alias("mean_difference"), R("standardized_mean_difference_zero").alias("standardized"))


@query("agg_34_buffer_sensitivity", L + ONE + " SELECT region, variable, round(max(abs(m / sd)), 6) + 0.0 AS max_abs_effect, CAST(max(n_units) AS BIGINT) AS max_units FROM st GROUP BY 1, 2")
def _(spark, sf):
    s = RS.one_sample(units(spark, sf), ["region", "buffer_km", "variable"], "difference")
    return s.groupBy("region", "variable").agg(R(F.max(F.abs("standardized_mean_difference_zero"))).alias("max_abs_effect"), F.max("n_units").alias("max_units"))


@query("sta_08_effect_sizes", DI + """, s AS (SELECT metric, count(*) FILTER (year < 1996) AS n_a, count(*) FILTER (year >= 1996) AS n_b, avg(difference) FILTER (year < 1996) AS ma, avg(difference) FILTER (year >= 1996) AS mb, var_samp(difference) FILTER (year < 1996) AS va, var_samp(difference) FILTER (year >= 1996) AS vb FROM diffs GROUP BY 1)
SELECT metric, n_a, n_b, CASE WHEN n_a >= 2 AND n_b >= 2 THEN round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) + 0.0 END AS cohen_d FROM s""")
def _(spark, sf):
    d = I.diffs(spark, sf).withColumn("side", F.when(F.col("year") < 1996, "a").otherwise("b"))
    return RS.effect_sizes(d, ["metric"], "side", "difference").select("metric", "n_a", "n_b", R("cohen_d").alias("cohen_d"))


REG = I.with_ctes("ev") + ", g AS (SELECT dominant_region AS region, year(event_start) AS year, cumulative_loss / 64.0::DOUBLE AS y, max_area_cells / 32.0::DOUBLE AS x1, max_intensity AS x2 FROM ev)"


def reg(spark, sf):
    return I.events(spark, sf).select(F.col("dominant_region").alias("region"), F.year("event_start").alias("year"), (F.col("cumulative_loss") / 64.0).alias("y"), (F.col("max_area_cells") / 32.0).alias("x1"), F.col("max_intensity").alias("x2"))


@query("sta_10_least_squares", REG + " SELECT region, count(*) AS n_cases, round(regr_intercept(y, x1), 5) + 0.0 AS intercept, round(regr_slope(y, x1), 5) + 0.0 AS slope, CAST(2 AS INTEGER) AS matrix_rank FROM g GROUP BY 1")
def _(spark, sf):
    f = RS.least_squares(reg(spark, sf), ["region"], "y", ["x1"])
    return f.select("region", "n_cases", R(F.col("beta")[0], 5).alias("intercept"), R(F.col("beta")[1], 5).alias("slope"), "matrix_rank")


MANY = REG + """, m AS (SELECT region, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(y) AS t0, sum(x1 * y) AS t1, sum(x2 * y) AS t2 FROM g GROUP BY 1),
d AS (SELECT *, n * (s11 * s22 - s12 * s12) - s1 * (s1 * s22 - s12 * s2) + s2 * (s1 * s12 - s11 * s2) AS det, (n + s11 + s22) / 3 AS q FROM m),
e AS (SELECT *, sqrt(((n - q) * (n - q) + (s11 - q) * (s11 - q) + (s22 - q) * (s22 - q) + 2 * (s1 * s1 + s2 * s2 + s12 * s12)) / 6) AS p FROM d),
f AS (SELECT *, acos(greatest(-1, least(1, ((n - q) * ((s11 - q) * (s22 - q) - s12 * s12) - s1 * (s1 * (s22 - q) - s12 * s2) + s2 * (s1 * s12 - (s11 - q) * s2)) / (2 * p * p * p)))) / 3 AS phi FROM e)"""


@query("sta_10_least_squares_many", MANY + """ SELECT region, n AS n_cases, round((t0 * (s11 * s22 - s12 * s12) - s1 * (t1 * s22 - s12 * t2) + s2 * (t1 * s12 - s11 * t2)) / det, 6) + 0.0 AS intercept, round((n * (t1 * s22 - s12 * t2) - t0 * (s1 * s22 - s12 * s2) + s2 * (s1 * t2 - t1 * s2)) / det, 6) + 0.0 AS slope_1,
 round((n * (s11 * t2 - t1 * s12) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s12 - s11 * s2)) / det, 6) + 0.0 AS slope_2, CAST(3 AS INTEGER) AS matrix_rank, round(sqrt((q + 2 * p * cos(phi)) / (q + 2 * p * cos(phi + 2 * pi() / 3))), 4) + 0.0 AS condition_number FROM f""")
def _(spark, sf):
    f = RS.least_squares(reg(spark, sf), ["region"], "y", ["x1", "x2"])
    b = F.col("beta")
    return f.select("region", "n_cases", *[R(b[i], 6).alias(n) for i, n in enumerate(("intercept", "slope_1", "slope_2"))], "matrix_rank", R("condition_number", 4).alias("condition_number"))


@query("sta_11_year_block_intercept", REG + f""", per AS (SELECT region, year, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(y) AS sy, sum(x1 * y) AS sxy FROM g GROUP BY 1, 2), ix AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY region) AS k FROM per),
dr AS (SELECT region, rep.range AS rep, {U32("'11|' || region || '|' || rep.range || '|' || (i // 4)", 'i')} % k AS j FROM ix, range(0, {B}) rep),
s AS (SELECT dr.region, rep, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy FROM dr JOIN ix ON ix.region = dr.region AND ix.i = dr.j GROUP BY 1, 2), b AS (SELECT region, (sy * sxx - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM s WHERE n * sxx - sx * sx > 1e-6)
SELECT region, round(quantile_cont(b0, 0.025), 4) + 0.0 AS ci_low, round(quantile_cont(b0, 0.5), 4) + 0.0 AS bootstrap_median, round(quantile_cont(b0, 0.975), 4) + 0.0 AS ci_high, count(*) AS n_bootstrap_valid FROM b GROUP BY 1""")
def _(spark, sf):
    b = RS.year_block_intercept(reg(spark, sf), ["region"], "y", ["x1"], "year", B, SEED)
    return b.select("region", *rr(["ci_low", "bootstrap_median", "ci_high"], 4), "n_bootstrap_valid")
