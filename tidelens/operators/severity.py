"""Severity tiers of events and the summaries built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, scalar as S
from ..session import durable
from . import ordered

LOSS, AREA, INTENSITY = "cumulative_loss", "max_area_cells", "max_intensity"


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), regional: Sequence[str] | None = None) -> DataFrame:
    """(keep, metric, scope, value): every column once for all events (scope *) and once per region, so one rank pass serves all."""
    v = lambda c: F.col(c).cast("double").alias("value")
    whole = [F.struct(F.lit(c).alias("metric"), F.lit("*").alias("scope"), v(c)) for c in columns]
    local = [F.struct(F.lit(c).alias("metric"), F.concat(F.lit("r:"), F.col("dominant_region")).alias("scope"), v(c)) for c in (columns if regional is None else regional)]
    return df.select(*keep, F.inline(F.array(*whole, *local)))


def with_cuts(events: DataFrame, percentiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Attach global and region quantiles of loss, area and intensity for each percentile (WIN-06).

    All quantiles come from one distributed rank pass; they reach the rows through one
    scalar row and one small join.  With ``by`` every catalogue has its own quantiles.
    """
    probs, by = {f"q{i}": 1 - p / 100 for i, p in enumerate(percentiles)}, list(by)
    q = ordered.quantiles(_long(events, [LOSS, AREA, INTENSITY], by, regional=[LOSS, AREA]), [*by, "metric", "scope"], "value", probs)
    pick = lambda c, pre: F.max(F.when(F.col("metric") == c, F.struct(*probs))).alias(f"{pre}{c}")
    whole = q.filter("scope = '*'").groupBy(*by).agg(*[pick(c, "_g_") for c in (LOSS, AREA, INTENSITY)])
    local = q.filter("scope <> '*'").groupBy(*by, F.substring("scope", 3, 10000).alias("dominant_region")).agg(*[pick(c, "_r_") for c in (LOSS, AREA)])
    if by:
        return events.join(whole, by).join(local, [*by, "dominant_region"], "left")
    out = events.withColumn("_q", whole.select(F.struct("*")).scalar())
    for c in (LOSS, AREA, INTENSITY):
        out = out.withColumn(f"_g_{c}", F.col(f"_q._g_{c}"))
    return out.drop("_q").join(local, "dominant_region", "left")


def severe_flags(cut: DataFrame, at: int, min_cells, min_days, threshold) -> dict:
    """SEV-01 as three boolean columns for the quantile set number ``at``."""
    g = lambda c: F.col(f"_g_{c}")[f"q{at}"]
    r = lambda c: F.col(f"_r_{c}")[f"q{at}"]
    held = F.col("sic_change_threshold") <= threshold + 1e-12
    size = F.col(AREA) >= min_cells
    lasting = (F.col("duration_days") >= min_days) | (F.col(INTENSITY) >= g(INTENSITY))
    glob = ((F.col(LOSS) >= g(LOSS)) | (F.col(AREA) >= g(AREA))) & size & lasting & held
    reg = ((F.col(LOSS) >= r(LOSS)) | (F.col(AREA) >= r(AREA))) & size & lasting & held
    return {"global": glob, "region_normalized": reg, "primary_union": glob | reg}


def mark_severe(events: DataFrame, percentile: float = 20.0, min_cells: int = 100, min_days: int = 2, threshold: float = -0.10, by: Sequence[str] = ()) -> DataFrame:
    """SEV-01, for every catalogue named by ``by`` on its own."""
    cut = with_cuts(events, [percentile], by)
    f = severe_flags(cut, 0, min_cells, min_days, threshold)
    return (cut.withColumn("severity_loss_threshold", F.col(f"_g_{LOSS}")["q0"]).withColumn("severity_area_threshold_cells", F.col(f"_g_{AREA}")["q0"])
            .withColumn("is_severe_global", f["global"]).withColumn("is_severe_region_normalized", f["region_normalized"]).withColumn("is_severe_primary", f["primary_union"])
            .drop(*[c for c in cut.columns if c.startswith(("_g_", "_r_"))]))


def severity_grid(events: DataFrame, percentiles, sizes, days, thresholds) -> DataFrame:
    """SEV-02: counts for every setting and scope in one pass: settings are columns of one aggregate, then rows."""
    cut = with_cuts(events, percentiles)
    settings = [(i, p, n, d, t) for i, p in enumerate(percentiles) for n in sizes for d in days for t in thresholds]
    aggs, keys = [F.count(F.lit(1)).alias("broad")], []
    for k, (i, _, n, d, t) in enumerate(settings):
        for scope, cond in severe_flags(cut, i, n, d, t).items():
            keys.append((k, scope, f"c{k}_{scope}"))
            aggs.append(F.count_if(cond).alias(f"c{k}_{scope}"))
    # per region first (few rows), so regions with events can be counted without a distinct
    per = cut.groupBy("dominant_region").agg(*aggs)
    total = per.agg(F.sum("broad").alias("broad"), *[F.sum(c).alias(c) for *_, c in keys], *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for *_, c in keys])
    rows = [F.struct(F.lit(float(settings[k][1])).alias("severity_percentile"), F.lit(settings[k][2]).alias("min_cells"), F.lit(settings[k][3]).alias("min_duration"),
                     F.lit(float(settings[k][4])).alias("sic_threshold"), F.lit(scope).alias("scope"), F.col(c).alias("severe_event_count"), F.col("broad").alias("broad_event_count"),
                     F.col(f"n_{c}").alias("n_regions_with_events")) for k, scope, c in keys]
    return total.select(F.inline(F.array(*rows))).withColumn("severe_fraction_of_broad", S.ratio("severe_event_count", "broad_event_count"))


RANKED = ("cumulative_loss", "max_area_km2", "max_intensity", "duration_days")


def with_severity_index(severe: DataFrame, id_col: str = "unique_local_event_id", by: Sequence[str] = ()) -> DataFrame:
    """Average-rank percentiles (global and per region) and their means (WIN-05), from one rank pass."""
    by = list(by)
    flat = _long(severe, RANKED, [*by, id_col])
    table = ordered.value_ranks(flat, [*by, "metric", "scope"], "value")
    pct = (F.col("n_before") + (F.col("n_equal") + 1) / 2) / F.col("n_total")
    seen = flat.join(table, [*by, "metric", "scope", "value"]).withColumn("pct", pct)
    one = lambda c, whole: F.max(F.when((F.col("metric") == c) & ((F.col("scope") == "*") == F.lit(whole)), F.col("pct")))
    wide = seen.groupBy(*by, id_col).agg(*[one(c, True).alias(f"global_rank_{c}") for c in RANKED], *[one(c, False).alias(f"region_rank_{c}") for c in RANKED])
    out = severe.join(wide, [*by, id_col])
    mean = lambda p: sum((F.col(f"{p}_rank_{c}") for c in RANKED[1:]), F.col(f"{p}_rank_{RANKED[0]}")) / 4
    return out.withColumn("severity_index_global", mean("global")).withColumn("severity_index_region", mean("region"))


def with_major_cuts(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach the quantiles that the major rules compare with, as ``_cuts``."""
    probs, by = {"q80": 0.8, "q85": 0.85, "q90": 0.9}, list(by)
    names = ("cumulative_loss", "max_area_km2", "severity_index_global")
    q = ordered.quantiles(_long(ranked, names, by, regional=[]), [*by, "metric", "scope"], "value", probs)
    wide = q.groupBy(*by).agg(F.struct(*[F.max(F.when(F.col("metric") == c, F.struct(*probs))).alias(c) for c in names]).alias("_cuts"))
    return ranked.join(wide, by) if by else ranked.withColumn("_cuts", wide.scalar())


def major_rules() -> list[tuple[str, str, object]]:
    """SEV-03: seven (family, name, condition) rules in the order in which they claim an event; they read ``_cuts``."""
    cut = lambda c: F.col("_cuts")[c]
    loss, area, index = cut("cumulative_loss"), cut("max_area_km2")["q80"], cut("severity_index_global")
    lasting = F.col("duration_days") >= 2
    rules = []
    for top in (10, 15):
        rules.append(("global", f"global_loss_top{top}_area_top20_duration2", (F.col("cumulative_loss") >= loss[f"q{100 - top}"]) & (F.col("max_area_km2") >= area) & lasting))
    for top in (10, 15):
        rules.append(("region_normalized", f"region_loss_top{top}_area_top20_duration2", (F.col("region_rank_cumulative_loss") >= 1 - top / 100) & (F.col("region_rank_max_area_km2") >= 0.80) & lasting))
    for top in (10, 15, 20):
        rules.append(("severity_index", f"severity_index_top{top}", F.col("severity_index_global") >= index[f"q{100 - top}"]))
    return rules


def select_major(severe: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """SEV-03 / SET-02: events that satisfy at least one rule, carrying the first rule they met, and the counts per rule.

    One row per event goes in and at most one comes out: the first true rule is a
    conditional expression, so no union and no de-duplication is needed.
    """
    by = list(by)
    ranked = durable(with_severity_index(durable(severe), by=by))
    rules = major_rules()
    hits = F.array(*[F.coalesce(c, F.lit(False)) for *_, c in rules])
    ranked = with_major_cuts(ranked, by).withColumn("_hits", hits).drop("_cuts")
    names = F.array(*[F.lit(n) for _, n, _ in rules])
    first = F.get(F.filter(F.transform(F.arrays_zip(F.col("_hits").alias("h"), names.alias("n")), lambda z: F.when(z["h"], z["n"])), lambda v: v.isNotNull()), F.lit(0))
    major = ranked.withColumn("major_definition", first).filter(F.col("major_definition").isNotNull()).drop("_hits")
    tops = [10, 15, 10, 15, 10, 15, 20]
    counts = ranked.groupBy(*by).agg(*[F.count_if(F.col("_hits")[i]).alias(f"c{i}") for i in range(len(rules))]).select(*by, F.inline(F.array(*[
        F.struct(F.lit(rules[i][0]).alias("family"), F.lit(tops[i] / 100).alias("threshold"), F.col(f"c{i}").alias("event_count")) for i in range(len(rules))])))
    return major, counts


def index_ranks(major: DataFrame) -> DataFrame:
    """WIN-07: descending first-come ranks of the severity index, global and per region."""
    a = ordered.row_numbers(major, [], [F.col("severity_index_global").desc(), "unique_local_event_id"], "global_severity_rank").drop("n_total")
    return ordered.row_numbers(a, ["dominant_region"], [F.col("severity_index_region").desc(), "unique_local_event_id"], "region_normalized_severity_rank").drop("n_total")


# ---- summaries --------------------------------------------------------------------

def medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "median_") -> DataFrame:
    """Median of every column per key, all columns in one pass over the values."""
    keys = list(keys)
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in cols]))
    q = ordered.quantiles(df.select(*keys, values), [*keys, "_name"], "_value", {"_median": 0.5})
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(f"{prefix}{c}") for c in cols])


def severe_summary(broad: DataFrame, severe: DataFrame, region="dominant_region") -> DataFrame:
    """AGG-10: broad against severe counts and medians per region, with the interpretation flag."""
    b = broad.groupBy(region).agg(F.count(F.lit(1)).alias("broad_event_count")).join(medians(broad, [region], ["cumulative_loss", "max_area_cells"], "broad_median_"), region)
    s = severe.groupBy(region).agg(F.count(F.lit(1)).alias("severe_event_count"), F.count_if("overlap_with_series_event").alias("severe_overlap_panarctic"),
                                   F.count_if("overlap_with_regional_event_v1").alias("severe_overlap_regional"))
    s = s.join(medians(severe, [region], ["cumulative_loss", "max_area_cells"], "severe_median_"), region)
    out = b.join(s, region, "left").fillna(0).withColumn("severe_fraction_of_broad", S.ratio("severe_event_count", "broad_event_count"))
    flag = S.ladder([(F.col("severe_event_count") == 0, "weak_or_not_supported_by_severe_definition"),
                     (F.col("severe_fraction_of_broad") < 0.05, "broad-dominated_or_threshold-sensitive")], "supported_by_severe_definition")
    return out.withColumn("interpretation_flag", flag)


def major_summary(severe: DataFrame, major: DataFrame, region="dominant_region") -> DataFrame:
    """AGG-10: major counts and medians beside the severe counts."""
    s = severe.groupBy(region).agg(F.count(F.lit(1)).alias("severe_event_count"))
    m = major.groupBy(region).agg(F.count(F.lit(1)).alias("major_event_count")).join(medians(major, [region], ["cumulative_loss", "max_area_km2", "duration_days"]), region)
    return s.join(m, region, "left").fillna(0).withColumn("major_fraction_of_severe", S.ratio("major_event_count", "severe_event_count"))


def patch_summary(patches: DataFrame, events: DataFrame) -> DataFrame:
    """AGG-10: patches per event and event means per region."""
    p = patches.groupBy("region").agg(F.count(F.lit(1)).alias("daily_patch_count"))
    e = events.groupBy(F.col("dominant_region").alias("region")).agg(
        F.count(F.lit(1)).alias("unique_event_count"), F.avg("duration_days").alias("mean_duration_days"), F.avg("max_area_km2").alias("mean_max_area_km2"),
        F.avg("cumulative_loss").alias("mean_cumulative_loss"), F.avg(F.col("overlap_with_series_event").cast("int")).alias("panarctic_overlap_fraction"))
    out = p.join(e, "region", "full_outer").fillna(0, ["daily_patch_count", "unique_event_count"])
    return out.withColumn("patch_to_event_ratio", S.ratio("daily_patch_count", "unique_event_count"))


def object_summary(objects: DataFrame, regions: Sequence[str], whole: str = "pan_arctic") -> DataFrame:
    """AGG-10: object counts and means for the listed regions; the aggregate region takes every object."""
    sets = objects.withColumn("region", F.explode(F.array(F.col("region"), F.lit(whole))))
    a = sets.groupBy("region").agg(
        F.count(F.lit(1)).alias("object_count"), F.count_distinct(F.year("date")).alias("years_with_objects"), F.avg("object_area_km2").alias("mean_area_km2"),
        F.avg("mean_sic_change").alias("mean_sic_change"), F.avg("cumulative_sic_loss").alias("mean_cumulative_sic_loss"),
        F.avg(F.col("overlap_with_series_event").cast("int")).alias("panarctic_overlap_fraction"))
    want = objects.sparkSession.createDataFrame([(r,) for r in regions], "region string")
    return want.join(a, "region", "left").fillna(0, ["object_count", "years_with_objects"])


def level_counts(levels: DataFrame, keys=("level",), region="dominant_region") -> DataFrame:
    """AGG-11: counts per level for all regions together and for each region, in one grouping-sets pass."""
    keys = list(keys)
    g = levels.groupingSets([[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col(region)]], *[F.col(k) for k in keys], F.col(region))
    a = g.agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("event_start").alias("unique_start_dates"), F.grouping(F.col(region)).alias("_all"))
    return a.select(*keys, F.when(F.col("_all") == 1, "all").otherwise(F.col(region)).alias("region"), "event_count", "unique_start_dates")


def two_by_two(df: DataFrame, a: str, b: str, names=("both", "temporal_only", "footprint_only", "neither", "temporal_margin", "footprint_margin")) -> DataFrame:
    """AGG-12: the four cells and the two margins of two flags, empty cells as 0."""
    x, y = F.col(a), F.col(b)
    conds = [x & y, x & ~y, ~x & y, ~x & ~y, x, y]
    one = df.agg(*[F.count_if(c).alias(n) for c, n in zip(conds, names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("cell_label"), F.col(n).alias("n_events")) for n in names])))


def half_month_grid(events: DataFrame, classes: Sequence[str], date="event_start", cls="exclusive_class", first_month: int = 6, n_months: int = 3) -> DataFrame:
    """AGG-13: counts by year and half month, one column per class, every cell present."""
    e = events.filter(F.month(date).between(first_month, first_month + n_months - 1))
    c = e.groupBy(F.year(date).alias("year"), S.half_month(date, first_month).alias("half_month_index")).pivot(cls, list(classes)).count()
    span = e.agg(F.min(F.year(date)).alias("a"), F.max(F.year(date)).alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    grid = span.withColumn("half_month_index", F.explode(F.sequence(F.lit(0), F.lit(2 * n_months - 1))))
    out = grid.join(c, ["year", "half_month_index"], "left").fillna(0)
    return out.withColumn("total_events", sum((F.col(x) for x in classes[1:]), F.col(classes[0])))


def taxonomy(spark) -> DataFrame:
    """SEV-06: which role every region name plays."""
    rows = [(r, "physical_region", True, True, True, r in fixed.FOCUS_REGIONS) for r in fixed.REGION_CODES]
    rows += [(r, "aggregate_reference", False, r == "pan_arctic", False, False) for r in fixed.AGGREGATE_REGIONS]
    return spark.createDataFrame(rows, "region_name string, region_type string, used_in_ranking boolean, used_in_matching boolean, used_in_evidence_matrix boolean, used_in_mechanism_classification boolean")
