"""Evidence tables: lag-group tests, specificity, proximity and front tests, assembly, status ladders, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import fixed, scalar as S
from ..session import durable
from . import joins as J, resample as RS

# The evidence schema.
EVIDENCE = T.StructType([
    T.StructField("evidence_id", T.StringType()), T.StructField("diagnostic_family", T.StringType()), T.StructField("analysis_tier", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("wrong_region", T.StringType()), T.StructField("mechanism", T.StringType()),
    T.StructField("variable", T.StringType()), T.StructField("buffer_km", T.IntegerType()), T.StructField("lag_group", T.StringType()),
    T.StructField("test_lags", T.StringType()), T.StructField("background_lags", T.StringType()), T.StructField("event_population", T.StringType()),
    T.StructField("statistical_unit", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("effect", T.DoubleType()),
    T.StructField("standardized_effect", T.DoubleType()), T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType()),
    T.StructField("p_raw", T.DoubleType()), T.StructField("p_fdr", T.DoubleType()), T.StructField("supported_or_significant", T.BooleanType()),
    T.StructField("workflow_label", T.StringType()), T.StructField("bootstrap_resamples", T.IntegerType()), T.StructField("fdr_scope", T.StringType()),
    T.StructField("evaluated", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("source_file", T.StringType()), T.StructField("source_row_key", T.StringType()),
])


def to_schema(df: DataFrame, schema: T.StructType = EVIDENCE) -> DataFrame:
    """FLT-14: project to a fixed schema; an absent column is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def excludes_zero(lo: str = "ci_low", hi: str = "ci_high") -> Column:
    return F.coalesce(F.col(lo) * F.col(hi) > 0, F.lit(False))


def is_supported(n="n_units", p="p_fdr", ci="ci_excludes_zero", effect="standardized_mean_difference_zero") -> Column:
    """FLT-13: enough units, small p, interval off zero, effect of at least 0.2."""
    return F.coalesce((F.col(n) >= 3) & (F.col(p) < 0.05) & S.parse_bool(ci) & (F.abs(F.col(effect)) >= 0.2), F.lit(False))


def lag_differences(df: DataFrame, keys: Sequence[str], event: str, variables: Sequence[str], groups: dict[str, Sequence[int]], background: Sequence[int] = fixed.BACKGROUND_LAGS, lag: str = "lag") -> DataFrame:
    """AGG-35 for several lag groups in one pass: (keys, event, variable, lag_group, event_mean, background_mean, difference)."""
    flat = df.select(*keys, event, lag, F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("_v")) for v in variables])))
    at = lambda ls: F.when(F.col(lag).isin(*ls), F.col("_v"))
    names = list(groups)
    a = flat.groupBy(*keys, event, "variable").agg(F.avg(at(background)).alias("background_mean"), *[F.avg(at(groups[g])).alias(f"_g{i}") for i, g in enumerate(names)])
    each = F.inline(F.array(*[F.struct(F.lit(g).alias("lag_group"), F.col(f"_g{i}").alias("event_mean")) for i, g in enumerate(names)]))
    return a.select(*keys, event, "variable", "background_mean", each).withColumn("difference", F.col("event_mean") - F.col("background_mean"))


def test_differences(diffs: DataFrame, keys: Sequence[str], unit: str, reps: int, seed: int, family: Sequence[str] = ()) -> DataFrame:
    """One-sample tests per key with bootstrap interval and false discovery over the family (the whole table by default)."""
    # the differences feed the moments and the resampling: cut once
    t = RS.one_sample(durable(diffs), keys, "difference", unit, reps, seed)
    return RS.fdr_bh(t, family).withColumn("ci_excludes_zero", excludes_zero())


def location_tests(df: DataFrame, variables: Sequence[str], reps: int, seed: int, event="event_id") -> DataFrame:
    """STA-15: event time against background per (region, radius, variable); FDR over all rows."""
    u = RS.event_minus_background(df, ["region", "buffer_km"], event, variables, fixed.EVENT_LAGS, fixed.BACKGROUND_LAGS)
    return test_differences(u, ["region", "buffer_km", "variable"], event, reps, seed).withColumn("supported", is_supported())


def lead_lag_tests(df: DataFrame, variables: Sequence[str], reps: int, seed: int, event="event_id") -> DataFrame:
    """STA-16: pre, at and post groups per (region, variable), with a class; "persistent" when all groups are significant."""
    u = lag_differences(df, ["region"], event, variables, fixed.LAG_GROUPS)
    t = test_differences(u, ["region", "variable", "lag_group"], event, reps, seed)
    t = t.withColumn("significant", F.coalesce(F.col("ci_excludes_zero") & (F.col("p_fdr") < 0.05) & (F.col("n_units") >= 3), F.lit(False)))
    words = {"pre-event": "precondition / precursor", "event-time": "contemporaneous forcing", "post-event": "response / adjustment"}
    every = t.groupBy("region", "variable").agg((F.bool_and("significant") & (F.count(F.lit(1)) == len(words))).alias("_all"))
    label = S.ladder([(F.col("_all"), "persistent background state"), *[(F.col("significant") & (F.col("lag_group") == g), w) for g, w in words.items()]], "weak / unreliable")
    return t.join(every, ["region", "variable"]).withColumn("classification", label).drop("_all")


def strongest_lag_group(tests: DataFrame) -> DataFrame:
    """TOP-06: class of the significant group with the largest effect per (region, variable), and the group means."""
    one = lambda g, c: F.max(F.when(F.col("lag_group") == g, F.col(c)))
    sig = F.when(F.col("significant"), F.struct(F.abs("mean_difference"), F.col("lag_group")))
    return tests.groupBy("region", "variable").agg(
        F.coalesce(F.max_by(F.when(F.col("significant"), F.col("classification")), sig), F.lit("weak / unreliable")).alias("lag_classification"),
        *[one(g, "mean_difference").alias(f"{n}_mean") for g, n in (("pre-event", "pre_event"), ("event-time", "event_time"), ("post-event", "post_event"))],
        *[F.sum(F.when(F.col("lag_group") == g, F.col("n_units")).otherwise(0)).alias(f"n_{n}_units") for g, n in (("pre-event", "pre"), ("event-time", "event"), ("post-event", "post"))])


# ---- displaced controls -----------------------------------------------------------

def paired_specificity(source: DataFrame, displaced: DataFrame, supported: DataFrame, variables: Sequence[str], reps: int, seed: int) -> DataFrame:
    """STA-09: |source| - |displaced| of the same event, bootstrap and sign flip, FDR per source region, pair gate.

    source (event_id, region, buffer_km, lag, variables); displaced adds sample_region;
    supported (region, buffer_km, variable) lists the pairs with primary support.
    """
    ev, bg = fixed.EVENT_LAGS, fixed.BACKGROUND_LAGS
    a = RS.event_minus_background(source, ["region", "buffer_km"], "event_id", variables, ev, bg).select("region", "buffer_km", "event_id", "variable", F.col("difference").alias("source_difference"))
    b = RS.event_minus_background(displaced, ["region", "sample_region", "buffer_km"], "event_id", variables, ev, bg).select("region", "sample_region", "buffer_km", "event_id", "variable", F.col("difference").alias("wrong_difference"))
    p = b.join(a, ["region", "buffer_km", "event_id", "variable"])
    p = durable(p.withColumn("specificity", F.abs("source_difference") - F.abs("wrong_difference")))
    keys = ["region", "sample_region", "buffer_km", "variable"]
    ok = p.filter("specificity is not null")
    t = p.groupBy(*keys).agg(F.count("specificity").alias("paired_n"), F.avg(F.when(F.col("specificity").isNotNull(), F.col("source_difference"))).alias("source_effect"),
                             F.avg(F.when(F.col("specificity").isNotNull(), F.col("wrong_difference"))).alias("wrong_region_effect"), F.avg("specificity").alias("mean_specificity"))
    t = t.join(RS.bootstrap_ci(ok, keys, "specificity", "event_id", reps, seed, min_units=3), keys, "left").join(RS.sign_flip_p(ok, keys, "specificity", "event_id", reps, seed).drop("effect_percentile"), keys, "left")
    t = t.withColumn("p_raw", F.when(F.col("paired_n") >= 3, F.col("p_raw")))
    t = RS.fdr_bh(t, ["region"]).join(supported.select("region", "buffer_km", "variable").withColumn("source_primary_supported", F.lit(True)), ["region", "buffer_km", "variable"], "left").fillna(False, ["source_primary_supported"])
    enough = F.col("paired_n") >= 3
    passed = F.coalesce(enough & F.col("source_primary_supported") & (F.col("mean_specificity") > 0) & (F.col("ci_low") > 0) & (F.col("p_fdr") < 0.05), F.lit(False))
    t = t.withColumn("control_passed", passed)
    return t.withColumn("control_status", S.ladder([(~enough, "insufficient_paired_event_units"), (~F.col("source_primary_supported"), "source_primary_not_supported"), (F.col("control_passed"), "passed_same_event_displaced_control")], "specificity_not_supported"))


def specificity_summary(tests: DataFrame, expected: int = 4) -> DataFrame:
    """STA-09: the every-displaced-region gate per (region, radius, variable)."""
    a = tests.groupBy("region", "buffer_km", "variable").agg(F.bool_and("source_primary_supported").alias("source_primary_supported"), F.count(F.lit(1)).alias("_n"),
                                                              F.count_if((F.col("paired_n") >= 3) & F.col("p_fdr").isNotNull()).alias("n_evaluable"), F.count_if("control_passed").alias("n_passed"))
    full = (F.col("n_evaluable") == expected) & (F.col("n_passed") == expected) & (F.col("_n") == expected)
    a = a.withColumn("all_passed", full)
    return a.withColumn("pair_status", S.ladder([((F.col("n_evaluable") < expected) | (F.col("_n") < expected), "insufficient_wrong_region_coverage"), (F.col("all_passed"), "passed_all_wrong_regions")], "failed_one_or_more_wrong_regions")).drop("_n")


# ---- pressure centres and fronts -----------------------------------------------------

def proximity_tests(rows: DataFrame, reps: int, seed: int, event="event_id") -> DataFrame:
    """STA-17: centre distance, pressure and counts at lags -1..1 against background; FDR over the table."""
    u = RS.event_minus_background(rows, ["region"], event, list(fixed.CYCLONE_DIRECTION), fixed.CYCLONE_LAGS, fixed.BACKGROUND_LAGS)
    return test_differences(u, ["region", "variable"], event, reps, seed)


def proximity_status(tests: DataFrame, regions: DataFrame, min_units: int = 3) -> DataFrame:
    """STA-17: supported when a variable is significant in its expected direction."""
    want = S.ladder([(F.col("variable") == v, d) for v, d in fixed.CYCLONE_DIRECTION.items()], F.lit(None).cast("string"))
    usable = (F.col("n_units") >= min_units) & F.col("p_fdr").isNotNull() & F.col("mean_difference").isNotNull()
    hit = usable & (F.col("p_fdr") < 0.05) & F.col("ci_excludes_zero") & S.matches_direction("mean_difference", F.col("_want"))
    # four variables at most per region
    a = tests.withColumn("_want", want).groupBy("region").agg(F.count_if(usable).alias("evaluated_test_count"), F.max("n_units").alias("max_n_units"),
                                                              F.array_sort(F.collect_set(F.when(F.coalesce(hit, F.lit(False)), F.col("variable")))).alias("_v"))
    a = regions.select("region").join(a, "region", "left")
    status = S.ladder([(F.col("evaluated_test_count").isNull(), "unavailable"), (F.col("evaluated_test_count") == 0, "insufficient_samples"), (F.size("_v") > 0, "supported")], "not_supported")
    return a.select("region", status.alias("evidence_status"), F.coalesce(F.concat_ws(";", "_v"), F.lit("")).alias("supported_variables"), F.coalesce("evaluated_test_count", F.lit(0)).alias("evaluated_test_count"), F.coalesce("max_n_units", F.lit(0)).alias("max_n_units"))


FRONT_VARIABLES = ("outward_edge_normal_wind_ms", "abs_edge_normal_wind_ms", "edge_tangential_wind_ms", "wind_speed_ms")


def front_tests(samples: DataFrame, reps: int, seed: int, event="event_id", variables: Sequence[str] = FRONT_VARIABLES) -> DataFrame:
    """STA-18: lag-group tests in two quality tiers (ok only; ok and degraded), FDR inside each tier, status per test."""
    tier = F.when(F.col("qa_status") == "ok", F.array(F.lit("primary"), F.lit("sensitivity"))).when(F.col("qa_status") == "degraded", F.array(F.lit("sensitivity"))).otherwise(F.array().cast("array<string>"))
    s = samples.withColumn("analysis_tier", F.explode(tier))
    u = lag_differences(s, ["analysis_tier", "region"], event, variables, fixed.LAG_GROUPS)
    keys = ["analysis_tier", "region", "variable", "lag_group"]
    t = test_differences(u, keys, event, reps, seed, ["analysis_tier"])
    grp = F.explode(F.array_compact(F.array(*[F.when(F.col("lag").isin(*ls), F.lit(g)) for g, ls in fixed.LAG_GROUPS.items()])))
    n = s.withColumn("lag_group", grp).groupBy("analysis_tier", "region", "lag_group").agg(F.count_if(F.col("qa_status") == "ok").alias("qa_ok_samples"), F.count_if(F.col("qa_status") == "degraded").alias("qa_degraded_samples"))
    t = t.join(n, ["analysis_tier", "region", "lag_group"], "left").fillna(0, ["qa_ok_samples", "qa_degraded_samples"])
    sig = F.coalesce((F.col("p_fdr") < 0.05) & F.col("ci_excludes_zero") & (F.col("n_units") >= 3), F.lit(False))
    first = F.col("analysis_tier") == "primary"
    return t.withColumn("mechanism_evidence_status", S.ladder([(first & sig & (F.col("qa_ok_samples") > 0), "statistically_supported_dynamic_indicator"), (first & (F.col("qa_ok_samples") <= 0), "unsupported_zero_ok_samples"), (~first & sig, "sensitivity_dependent_suggestive")], "weak_or_insufficient"))


def front_status(tests: DataFrame, regions: DataFrame, variable: str = FRONT_VARIABLES[0]) -> DataFrame:
    """STA-18: supported when the outward wind is significant and positive before or at event time in the primary tier."""
    s = tests.filter((F.col("variable") == variable) & (F.col("analysis_tier") == "primary") & F.col("lag_group").isin("pre-event", "event-time"))
    usable = (F.col("n_units") >= 3) & F.col("p_fdr").isNotNull() & F.col("mean_difference").isNotNull()
    hit = usable & (F.col("mean_difference") > 0) & (F.col("mechanism_evidence_status") == "statistically_supported_dynamic_indicator")
    a = s.groupBy("region").agg(F.count_if(usable).alias("evaluated_test_count"), F.max("n_units").alias("max_n_units"), F.count_if(F.coalesce(hit, F.lit(False))).alias("supported_test_count"),
                                F.array_sort(F.collect_set(F.when(F.coalesce(hit, F.lit(False)), F.col("lag_group")))).alias("_g"))
    a = regions.select("region").join(a, "region", "left")
    status = S.ladder([(F.col("evaluated_test_count").isNull(), "unavailable"), (F.col("evaluated_test_count") == 0, "insufficient_samples"), (F.size("_g") > 0, "supported")], "not_supported")
    return a.select("region", status.alias("evidence_status"), F.coalesce(F.concat_ws(";", "_g"), F.lit("")).alias("supported_lag_groups"), F.coalesce("supported_test_count", F.lit(0)).alias("supported_test_count"), F.coalesce("evaluated_test_count", F.lit(0)).alias("evaluated_test_count"))


# ---- assembly ----------------------------------------------------------------------------

def key_grid(spark, family: str, **axes: Sequence) -> DataFrame:
    """Expected keys of a family: every combination of small literal lists (made on the driver, a few hundred rows)."""
    import itertools
    names = list(axes)
    rows = [tuple(v) for v in itertools.product(*axes.values())]
    kinds = ["int" if isinstance(axes[n][0], int) else "string" for n in names]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).withColumn("diagnostic_family", F.lit(family))


def fill_family(keys: DataFrame, tests: DataFrame, on: Sequence[str], supported: Column, label: Column, n="n_units", effect="mean_difference", standard="standardized_mean_difference_zero",
                status: Column | None = None, reason: Column | None = None) -> DataFrame:
    """JOI-27: each expected key gets exactly one test row; a missing or doubled row fails the task that sees it."""
    none = F.lit(None).cast("double")
    pick = lambda c: F.col(c) if c in tests.columns else none
    rows = tests.select(*on, F.col(n).cast("bigint").alias("n_units"), F.col(effect).alias("effect"), (pick(standard)).alias("standardized_effect"), pick("ci_low").alias("ci_low"), pick("ci_high").alias("ci_high"),
                        pick("p_raw").alias("p_raw"), pick("p_fdr").alias("p_fdr"), supported.alias("supported_or_significant"), label.alias("workflow_label"),
                        (status if status is not None else F.lit("evaluated")).alias("status"), (reason if reason is not None else F.lit("")).alias("reason"), F.lit(True).alias("evaluated"))
    joined = J.checked_join(keys, rows, on, "one_to_one", "left")
    ok = F.when(F.col("evaluated"), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no test row for"), *[F.col(c).cast("string") for c in on])))
    return joined.withColumn("evaluated", ok.cast("boolean"))


def with_ids(df: DataFrame, cols: Sequence[str] = ("diagnostic_family", "analysis_tier", "region", "wrong_region", "variable", "buffer_km", "lag_group")) -> DataFrame:
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols if c in df.columns])
    return df.withColumn("source_row_key", key).withColumn("evidence_id", F.concat(F.lit("EV"), F.upper(F.substring(F.sha2(key, 256), 1, 10))))


def family_counts(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """EVI-01: rows per family against the expected number."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), "diagnostic_family string, expected int")
    have = rows.groupBy("diagnostic_family").agg(F.count(F.lit(1)).alias("actual"))
    return want.join(have, "diagnostic_family", "full_outer").fillna(0).withColumn("status", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))


def number_text(c: str) -> Column:
    """Text of a number with twelve significant digits, NA when missing."""
    return F.coalesce(S.significant_text(c, 12), F.lit("NA"))


def region_summary(rows: DataFrame, specificity: DataFrame) -> DataFrame:
    """EVI-02: one row per (region, variable): primary text, lag-group text, specificity, confirmation and the status ladder."""
    rows = rows.filter(F.col("diagnostic_family").isin("location_buffer", "lead_lag", "wrong_region_control", "year_block_robustness"))
    sup = F.col("supported_or_significant")
    fam = lambda f: F.col("diagnostic_family") == f
    item = F.struct("buffer_km", F.concat(F.col("buffer_km").cast("string"), F.lit("km:effect="), number_text("effect"), F.lit(",CI=["), number_text("ci_low"), F.lit(","), number_text("ci_high"), F.lit("],p_FDR="), number_text("p_fdr")).alias("t"))
    # the design gives three radii, three lag groups and three blocks per key
    lag_text = lambda g: F.max(F.when(fam("lead_lag") & (F.col("lag_group") == g), F.concat(F.lit("significant="), sup.cast("string"), F.lit(";effect="), number_text("effect"))))
    year = F.struct("buffer_km", F.concat(F.col("buffer_km").cast("string"), F.lit("km:confirmed="), sup.cast("string")).alias("t"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"]), ";")
    a = rows.groupBy("region", "variable").agg(
        text(F.when(fam("location_buffer"), item)).alias("primary_effect_ci_p_fdr"), F.bool_or(fam("location_buffer") & sup).alias("primary_supported"),
        lag_text("pre-event").alias("pre_event_support"), lag_text("event-time").alias("event_time_support"), lag_text("post-event").alias("post_event_support"),
        F.bool_or(fam("lead_lag") & sup).alias("_temporal"), text(F.when(fam("year_block_robustness"), year)).alias("year_block_confirmation"), F.bool_or(fam("year_block_robustness") & sup).alias("_year"))
    sp = F.struct("buffer_km", F.concat(F.col("buffer_km").cast("string"), F.lit("km:"), F.col("n_passed").cast("string"), F.lit("/4;all="), F.col("all_passed").cast("string")).alias("t"))
    s = specificity.groupBy("region", "variable").agg(text(sp).alias("wrong_region_specificity"), F.bool_or("all_passed").alias("_spec"))
    a = a.join(s, ["region", "variable"], "left").fillna(False, ["_spec"])
    robust = F.col("primary_supported") & F.col("_temporal") & F.col("_spec") & F.col("_year")
    return a.withColumn("manuscript_status", S.ladder([(robust, "SUPPORTED_WITH_ROBUSTNESS"), (F.col("primary_supported"), "SUPPORTED_PRIMARY_ONLY")], "NOT_SUPPORTED")).drop("_temporal", "_year", "_spec")


def completeness(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """EVI-03: rows per family for each (region, variable) and whether the design is complete."""
    p = rows.groupBy("region", "variable").pivot("diagnostic_family", list(expected)).count().fillna(0)
    ok = F.lit(True)
    for f, n in expected.items():
        ok = ok & (F.col(f) == n)
    return p.withColumn("comparison_status", F.when(ok, "COMPLETE_SYMMETRIC").otherwise("INCOMPLETE"))


def year_confirmed(n_years="n_years", n_events="n_events", ci="ci_excludes_zero") -> Column:
    """Interval of drawn years off zero; fewer than two years or three differences confirm nothing."""
    return F.coalesce((F.col(n_years) >= 2) & (F.col(n_events) >= 3) & F.col(ci), F.lit(False))


def stable_specificity(location: DataFrame, specificity: DataFrame, year: DataFrame, prefix_variable: str = "v") -> tuple[DataFrame, DataFrame]:
    """EVI-04: all six checks (support, specificity, confirmation in both scenarios) per key, and regions per variable with the most of any."""
    keys = ["region", "buffer_km", "variable"]
    checks = [f"{s}_{c}" for c in ("specific", "confirmed") for s in ("primary", "floor")]
    c = location.join(specificity, keys, "left").join(year, keys, "left").fillna(False, checks)
    six = F.col("primary_supported") & F.col("floor_supported")
    for name in checks:
        six = six & F.col(name)
    c = c.withColumn("stable_spatial_specificity", six)
    rv = c.filter(F.col("variable").startswith(prefix_variable)).groupBy("region", "variable").agg(F.bool_or("stable_spatial_specificity").alias("s"))
    n = rv.groupBy("variable").agg(F.count_if("s").alias("n_regions"))
    return c, n.join(n.agg(F.max("n_regions").alias("max_regions")))


def score_matrix(counts: DataFrame, supported: DataFrame, controlled: DataFrame, confirmed: DataFrame, leads: DataFrame, dynamic_variables: Sequence[str] = fixed.DYNAMIC_VARIABLES) -> DataFrame:
    """EVI-05: five scores per region, their mean and the confidence ladder.

    counts (region, fraction, major, clusters); supported (region, variable, buffer_km);
    controlled / confirmed (region, variable, buffer_km, ok); leads (region, variable, lag_group, significant), of which
    only ``dynamic_variables`` count.
    """
    pairs = ["region", "variable", "buffer_km"]
    sup = supported.groupBy("region").agg(F.count_distinct("variable").alias("_sv"))
    ctl = supported.join(controlled.filter("ok"), pairs, "left_semi").select("region").distinct().withColumn("_c", F.lit(True))
    yb = supported.join(confirmed.filter("ok"), pairs, "left_semi").select("region").distinct().withColumn("_y", F.lit(True))
    ld = leads.filter(F.col("significant") & F.col("variable").isin(*dynamic_variables) & F.col("lag_group").isin("pre-event", "event-time")).select("region").distinct().withColumn("_l", F.lit(True))
    m = counts.join(sup, "region", "left").join(ctl, "region", "left").join(yb, "region", "left").join(ld, "region", "left").fillna(0, ["_sv"]).fillna(False, ["_c", "_y", "_l"])
    f, n, k = F.col("fraction"), F.col("major"), F.col("clusters")
    m = m.withColumn("major_severe_cluster_support", S.ladder([((f >= 0.2) & (n >= 30) & (k >= 25), 4), ((f >= 0.1) & (n >= 20) & (k >= 15), 3)], 1))
    m = m.withColumn("location_buffer_support", S.ladder([(F.col("_sv") >= 3, 4), (F.col("_sv") >= 1, 3)], 1))
    for c, src in (("lead_lag_directionality", "_l"), ("wrong_region_control", "_c"), ("year_block_bootstrap", "_y")):
        m = m.withColumn(c, F.when(F.col(src), 3).otherwise(1))
    cols = ["major_severe_cluster_support", "location_buffer_support", "lead_lag_directionality", "wrong_region_control", "year_block_bootstrap"]
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / 5.0
    m = m.withColumn("mean_score", mean)
    conf = S.ladder([(F.col("mean_score") >= 3.5, "strong"), (F.col("mean_score") >= 2.7, "moderate"), (F.col("mean_score") >= 1.8, "suggestive")], "weak")
    return m.withColumn("confidence_level", conf).select("region", *cols, "mean_score", "confidence_level")


def regime(matrix: DataFrame, proximity: DataFrame, rules=fixed.REGIME_RULES, otherwise: str = fixed.REGIME_OTHERWISE, confidence_caps=fixed.CONFIDENCE_CAPS, score_caps=fixed.SCORE_CAPS, n_scores: int = 5) -> DataFrame:
    """EVI-05: regime label per region by the first rule that holds; then capped scores, their mean, and capped confidence."""
    m = matrix.join(proximity.select("region", F.col("evidence_status").alias("_p")), "region", "left")

    def holds(region, least, status):
        out = F.col("region") == region
        for name, score in least.items():
            out = out & (F.col(name) >= score)
        return out if status is None else out & F.coalesce(F.col("_p") == status, F.lit(False))

    m = m.withColumn("assigned_regime", S.ladder([(holds(*r[:3]), r[3]) for r in rules], otherwise)).drop("_p")
    caps = [((F.col("region") == r) & F.col("assigned_regime").startswith(begins), level) for r, begins, level in confidence_caps]
    m = m.withColumn("confidence_level", S.ladder(caps, F.col("confidence_level")))
    for region, name, most in score_caps:
        over = F.when((F.col("region") == region) & (F.col(name) > most), F.col(name) - most).otherwise(0)
        m = m.withColumn("mean_score", F.col("mean_score") - over / float(n_scores)).withColumn(name, F.col(name) - over)
    return m


def scenario_comparison(paired: DataFrame, keys: Sequence[str], tags=("primary", "floor")) -> DataFrame:
    """EVI-06 / AGG-42: direction and status preserved between scenarios, row by row and per region."""
    a, b = tags
    both = F.col("seen_in") == "both"
    return (paired.withColumn("direction_preserved", both & (F.signum(f"{a}_effect") == F.signum(f"{b}_effect")))
            .withColumn("status_preserved", both & (F.col(f"{a}_supported") == F.col(f"{b}_supported"))))


def comparison_by_region(rows: DataFrame, tags=("primary", "floor")) -> DataFrame:
    """AGG-42."""
    a, b = tags
    return rows.groupBy("region", "diagnostic").agg(F.count_if(f"{a}_supported").alias("n_primary_supported"), F.count_if(f"{b}_supported").alias("n_floor_supported"), F.count(F.lit(1)).alias("n_rows"),
                                                   F.bool_and(F.col(f"{a}_supported") == F.col(f"{b}_supported")).alias("status_preserved"), F.bool_and("direction_preserved").alias("direction_preserved"))


def cross_scale_map(events: DataFrame, series_events: DataFrame, footprint_links: DataFrame, days: int = 3, radii=(300, 500), id_col="event_id") -> DataFrame:
    """EVI-07: per local event, links in time, in time and place, and by footprint."""
    e = J.flag_near_day(J.nearest_within(events, series_events, days, float(max(radii))), series_events, days, "temporal_link")
    near = F.col(f"nearest_km_{days}d")
    for r in radii:
        e = e.withColumn(f"link_{r}km", F.coalesce(near <= r, F.lit(False)))
    links = footprint_links.select(id_col).distinct().withColumn("footprint_linked", F.lit(True))
    return e.join(links, id_col, "left").fillna(False, ["footprint_linked"])
