"""Matched controls: window selection for events, event selection for events, differences, balance and inference.

Everything a match depends on (initial value, season day, year) is a function of the
date, so matching runs on distinct dates: both sides are bounded by the calendar however
many events share a day.  Events are attached at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, scalar as S
from ..sources.catalog import first_per_group
from ..session import durable
from . import joins as J, ordered, resample as RS


def status_of(n: Column, target: int, least: int) -> Column:
    return S.ladder([(n >= target, "matched_controls"), (n >= least, "limited_background_controls")], "insufficient_background_controls")


def candidate_windows(events: DataFrame, daily: DataFrame, readable: DataFrame, months, days: int = 5, date="event_date") -> DataFrame:
    """Anchor days whose window [anchor - days, anchor] has a start value, is readable at both ends and touches no event window."""
    start = daily.select(F.date_add("date", days).alias("anchor"), F.col("value").alias("control_initial"))
    seen = readable.select("date").distinct()
    a = daily.filter(S.in_months("date", months)).select(F.col("date").alias("anchor")).join(start, "anchor")
    a = a.join(seen.select(F.col("date").alias("anchor")), "anchor", "left_semi").join(seen.select(F.date_add("date", days).alias("anchor")), "anchor", "left_semi")
    a = a.withColumn("window_start", F.date_sub("anchor", days)).withColumn("window_end", F.col("anchor"))
    w = events.select(F.date_sub(date, days).alias("window_start"), F.col(date).alias("window_end"))
    return J.flag_overlap_any(a, w, "_hit").filter(~F.col("_hit")).drop("_hit")


def select_control_windows(events: DataFrame, daily: DataFrame, readable: DataFrame, months="jja", days: int = 5, tiers: Sequence[int] = fixed.CONTROL_TIERS,
                           target: int = fixed.CONTROL_TARGET, least: int = fixed.CONTROL_MIN, id_col="pan_event_id", date="event_date") -> tuple[DataFrame, DataFrame]:
    """WIN-10 forward: per event, candidate windows of the same year in the first tier with ``target`` of them, the closest
    initial values first; otherwise every candidate of the widest tier.  Returns (summary, anchors)."""
    cand = candidate_windows(events, daily, readable, months, days, date)
    d = events.select(F.col(date).alias("_d")).distinct().join(daily.select(F.date_add("date", days).alias("_d"), F.col("value").alias("event_initial")), "_d", "left")
    d = d.withColumn("event_initial", F.when(F.col("event_initial").isNotNull(), F.col("event_initial")).otherwise(F.raise_error(F.lit("an event has no initial value"))))
    pairs = d.withColumn("_y", F.year("_d")).join(cand.withColumn("_y", F.year("anchor")), "_y", "left").drop("_y")
    gap = F.abs(F.datediff("anchor", "_d"))
    pairs = pairs.withColumn("abs_day_difference", gap).withColumn("abs_initial_difference", F.abs(F.col("control_initial") - F.col("event_initial")))
    w = W.partitionBy("_d")
    for t in tiers:
        pairs = pairs.withColumn(f"candidate_count_{t}", F.count(F.when(F.col("abs_day_difference") <= t, 1)).over(w))
    tier = S.ladder([(F.col(f"candidate_count_{t}") >= target, t) for t in tiers], tiers[-1])
    full = F.lit(False)
    for t in tiers:
        full = full | (F.col(f"candidate_count_{t}") >= target)
    pairs = pairs.withColumn("selected_tier_days", tier).withColumn("_full", full)
    inside = F.coalesce(F.col("abs_day_difference") <= F.col("selected_tier_days"), F.lit(False))
    rank = F.row_number().over(w.orderBy(F.when(inside, 0).otherwise(1), "abs_initial_difference", "anchor"))
    # read by the summary and by the anchors: cut once
    pairs = durable(pairs.withColumn("selected_rank", F.when(inside, rank)).withColumn("_keep", inside & (~F.col("_full") | (rank <= target))))
    head = pairs.groupBy("_d").agg(F.any_value("event_initial").alias("event_initial"), *[F.max(f"candidate_count_{t}").alias(f"candidate_count_{t}") for t in tiers],
                                   F.max("selected_tier_days").alias("selected_tier_days"), F.count_if("_keep").alias("selected_control_count"), F.bool_or("_full").alias("_full"))
    n = F.col("selected_control_count")
    head = head.withColumn("matching_status", S.ladder([(F.col("_full"), "matched_controls"), (n >= least, "limited_background_controls")], "insufficient_background_controls")).drop("_full")
    ids = events.select(id_col, F.col(date).alias("_d"))
    summary = ids.join(head, "_d").withColumnRenamed("_d", date)
    kept = pairs.filter("_keep").select("_d", "selected_rank", F.col("anchor").alias("control_anchor_date"), "window_start", "window_end", "control_initial", "abs_initial_difference", "abs_day_difference")
    anchors = ids.join(head.select("_d", "event_initial", "matching_status", "selected_tier_days"), "_d").join(kept, "_d").withColumnRenamed("_d", date)
    return summary, anchors


def classify_events(events: DataFrame, linked: DataFrame, pan: DataFrame, daily: DataFrame, readable: DataFrame, months="jja", days: int = 5,
                    id_col="unique_local_event_id", date="event_start") -> DataFrame:
    """STA-20: linked or not, eligible or why not, and whether the window touches a series-event window.

    ``linked`` holds (id, pan_event_id) relations; ``pan`` the series events with ``event_date``.
    """
    e = events.select(id_col, F.col(date).alias("event_date"), "dominant_region")
    counts = linked.groupBy(id_col).agg(F.count_distinct("pan_event_id").alias("n_linked_pan_events"))
    e = e.join(counts, id_col, "left").fillna(0, ["n_linked_pan_events"])
    e = e.join(daily.select(F.date_add("date", days).alias("event_date"), F.col("value").alias("initial_value")), "event_date", "left")
    seen = readable.select("date").distinct()
    ends = seen.select(F.col("date").alias("event_date")).join(seen.select(F.date_add("date", days).alias("event_date")), "event_date").withColumn("_r", F.lit(True))
    e = e.join(ends, "event_date", "left")
    e = e.withColumn("window_start", F.date_sub("event_date", days)).withColumn("window_end", F.col("event_date"))
    w = pan.select(F.date_sub("event_date", days).alias("window_start"), F.col("event_date").alias("window_end"))
    e = J.flag_overlap_any(e, w, "_touch")
    reasons = F.array_compact(F.array(F.when(~S.in_months("event_date", months), F.lit("non_jja_event_date")), F.when(F.col("_r").isNull(), F.lit("cdr_endpoints_unreadable")),
                                      F.when(F.col("initial_value").isNull(), F.lit("initial_sie_unavailable"))))
    e = e.withColumn("pan_linked", F.col("n_linked_pan_events") > 0).withColumn("event_eligible", F.size(reasons) == 0)
    e = e.withColumn("eligibility_status", F.when(F.col("event_eligible"), "eligible").otherwise(F.concat_ws(";", reasons)))
    touch = ~F.col("pan_linked") & F.col("_touch")
    return (e.withColumn("control_window_excluded", touch).withColumn("control_eligible", ~F.col("pan_linked") & F.col("event_eligible") & ~touch)
            .withColumn("analysis_group", F.when(F.col("pan_linked"), "case").otherwise("control")).withColumn("season_day", S.season_day("event_date")).drop("_r", "_touch"))


def select_control_events(classified: DataFrame, tiers: Sequence[int] = fixed.CONTROL_TIERS, target: int = fixed.CONTROL_TARGET, least: int = fixed.CONTROL_MIN,
                          id_col="unique_local_event_id") -> tuple[DataFrame, DataFrame]:
    """WIN-10 reverse: per case, the best ``target`` control events of its region by (initial value, year, season) distance, date and id.

    First tier of season distance with ``target`` candidates, else all.  Cases and controls
    are matched as distinct (region, date); a running count over control dates finds
    where the target is reached, and only then are events read back.
    """
    r = "dominant_region"
    cases = classified.filter("pan_linked and event_eligible")
    controls = classified.filter("control_eligible")
    state = [F.any_value("initial_value").alias("v"), F.any_value("season_day").alias("s")]
    cd = cases.groupBy(r, "event_date").agg(*state)
    kd = controls.groupBy(r, F.col("event_date").alias("k_date")).agg(F.any_value("initial_value").alias("kv"), F.any_value("season_day").alias("ks"), F.count(F.lit(1)).alias("kn"))
    p = cd.join(kd, r, "left")
    p = p.withColumn("season_day_distance", F.abs(F.col("ks") - F.col("s"))).withColumn("abs_initial_difference", F.abs(F.col("kv") - F.col("v"))).withColumn("abs_year_difference", F.abs(F.year("k_date") - F.year("event_date")))
    w = W.partitionBy(r, "event_date")
    for t in tiers:
        p = p.withColumn(f"candidate_count_{t}", F.coalesce(F.sum(F.when(F.col("season_day_distance") <= t, F.col("kn"))).over(w), F.lit(0)))
    p = p.withColumn("candidate_count_all", F.coalesce(F.sum("kn").over(w), F.lit(0)))
    p = p.withColumn("_tier", S.ladder([(F.col(f"candidate_count_{t}") >= target, F.lit(t)) for t in tiers], F.lit(None).cast("int")))
    inside = F.col("kn").isNotNull() & F.coalesce(F.col("season_day_distance") <= F.col("_tier"), F.lit(True))
    before = F.coalesce(F.sum(F.when(inside, F.col("kn")).otherwise(0)).over(w.orderBy("abs_initial_difference", "abs_year_difference", "season_day_distance", "k_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p = durable(p.withColumn("_inside", inside).withColumn("_before", before))
    head = p.groupBy(r, "event_date").agg(*[F.max(f"candidate_count_{t}").alias(f"candidate_count_{t}") for t in tiers], F.max("candidate_count_all").alias("candidate_count_all"), F.max("_tier").alias("_tier"),
                                          F.least(F.sum(F.when(F.col("_inside"), F.col("kn")).otherwise(0)), F.lit(target)).alias("n_selected_controls"))
    head = head.withColumn("selected_tier", F.coalesce(F.col("_tier").cast("string"), F.lit("all"))).withColumn("matching_status", status_of(F.col("n_selected_controls"), target, least)).drop("_tier")
    summary = cases.select(id_col, r, "event_date", F.col("initial_value").alias("event_initial")).join(head, [r, "event_date"])
    dates = p.filter(F.col("_inside") & (F.col("_before") < target))
    first = first_per_group(controls.select(r, F.col("event_date").alias("k_date"), F.col(id_col).alias("control_id")), [r, "k_date"], ["control_id"], target)
    first = first.withColumn("_k", F.row_number().over(W.partitionBy(r, "k_date").orderBy("control_id")))
    picked = dates.join(first, [r, "k_date"]).withColumn("selected_rank", (F.col("_before") + F.col("_k")).cast("int")).filter(F.col("selected_rank") <= target)
    picked = picked.select(r, "event_date", "selected_rank", "control_id", F.col("k_date").alias("control_event_date"), F.col("kv").alias("control_initial"), "abs_initial_difference", "abs_year_difference", "season_day_distance")
    anchors = summary.select(id_col, r, "event_date", "event_initial", "matching_status", "selected_tier").join(picked, [r, "event_date"])
    return summary, anchors


def matching_quality(anchors: DataFrame, id_col: str, initial="event_initial", control="control_initial") -> DataFrame:
    """AGG-39: median, p90 and maximum of absolute and relative differences, signed median (at most ``target`` rows per case)."""
    d = F.abs(F.col(control) - F.col(initial))
    rel = d / F.abs(F.col(initial))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return anchors.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_selected_controls"), q(d, 0.5).alias("median_abs"), q(d, 0.9).alias("p90_abs"), F.max(d).alias("max_abs"),
        q(rel, 0.5).alias("median_rel"), q(rel, 0.9).alias("p90_rel"), F.max(rel).alias("max_rel"), q(F.col(control) - F.col(initial), 0.5).alias("median_signed"))


def case_minus_controls(case_values: DataFrame, control_values: DataFrame, id_col: str, metrics: Sequence[str], counts: Sequence[int] = (fixed.CONTROL_TARGET,), least: int = fixed.CONTROL_MIN) -> DataFrame:
    """AGG-36 / STA-07: per case, metric and control count k: case value minus the median of its k best controls.

    ``control_values`` carries (id, selected_rank, metrics); a group holds at most the target number of rows.
    """
    flat = lambda df, extra: df.select(id_col, *extra, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v")) for m in metrics])))
    k = F.explode(F.array(*[F.lit(int(c)) for c in counts]))
    c = flat(control_values, ["selected_rank"]).withColumn("control_count", k).filter(F.col("selected_rank") <= F.col("control_count"))
    med = c.groupBy(id_col, "metric", "control_count").agg(F.percentile("_v", F.lit(0.5)).alias("_m"), F.count("_v").alias("n_valid_controls"))
    e = flat(case_values, []).withColumnRenamed("_v", "case_value").withColumn("control_count", k)
    out = e.join(med, [id_col, "metric", "control_count"], "left").fillna(0, ["n_valid_controls"])
    ok = F.col("case_value").isNotNull() & (F.col("n_valid_controls") >= least)
    return out.withColumn("control_median", F.when(ok, F.col("_m"))).withColumn("difference", F.col("case_value") - F.col("control_median")).withColumn("status", F.when(ok, "ok").otherwise("insufficient_controls")).drop("_m")


def synchronisation(case_regions: DataFrame, control_regions: DataFrame, id_col: str, n_regions: int = 18, least: int = fixed.CONTROL_MIN) -> tuple[DataFrame, DataFrame]:
    """AGG-37: per event and region the median, anomaly and background percentile; per event how many regions exceed the median.

    case_regions (id, region_code, loss); control_regions (id, selected_rank, region_code, loss).
    """
    c = control_regions.join(case_regions.withColumnRenamed("loss", "_e"), [id_col, "region_code"])
    m = c.groupBy(id_col, "region_code").agg(F.percentile("loss", F.lit(0.5)).alias("_m"), F.avg((F.col("loss") <= F.col("_e")).cast("int")).alias("_p"), F.count("loss").alias("n_valid_controls"))
    r = case_regions.join(m, [id_col, "region_code"], "left").fillna(0, ["n_valid_controls"])
    ok = F.col("n_valid_controls") >= least
    r = r.withColumn("control_median", F.when(ok, F.col("_m"))).withColumn("loss_anomaly", F.col("loss") - F.col("control_median")).withColumn("background_percentile", F.when(ok, F.col("_p")))
    r = r.withColumn("status", F.when(ok, "ok").otherwise("insufficient_controls")).drop("_m", "_p")
    above = F.count_if(F.col("loss") > F.col("control_median"))
    s = r.groupBy(id_col).agg(above.alias("n_regions_above"), (above / n_regions).alias("fraction_regions_above"), F.percentile("background_percentile", F.lit(0.5)).alias("median_background_percentile"), F.count("background_percentile").alias("n_regions_evaluable"))
    return r, s


def balance(differences: DataFrame, universe: DataFrame, descriptors: Sequence[str]) -> DataFrame:
    """AGG-38: matched difference of each descriptor against the inter-quartile range of the eligible universe."""
    flat = universe.select(F.inline(F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).cast("double").alias("_v")) for d in descriptors])))
    q = ordered.quantiles(flat, ["metric"], "_v", {"a": 0.25, "b": 0.75}).select("metric", (F.col("b") - F.col("a")).alias("eligible_universe_iqr"))
    d = durable(differences.filter(F.col("metric").isin(*descriptors))).join(q, "metric")
    d = d.withColumn("_s", F.abs(F.try_divide("difference", F.when(F.col("eligible_universe_iqr") > 0, F.col("eligible_universe_iqr")))))
    a = d.groupBy("metric").agg(F.count("difference").alias("n_cases"), F.avg("difference").alias("mean_difference"), F.avg("_s").alias("mean_abs_scaled"), F.count_if(F.col("difference").isNull()).alias("missing_count"),
                                F.avg(F.col("difference").isNull().cast("int")).alias("missing_fraction"), F.max("eligible_universe_iqr").alias("eligible_universe_iqr"))
    m = ordered.quantiles(d, ["metric"], "difference", {"median_difference": 0.5, "q25_difference": 0.25, "q75_difference": 0.75}).drop("n_values")
    s = ordered.quantiles(d, ["metric"], "_s", {"median_abs_scaled": 0.5}).drop("n_values")
    return a.join(m, "metric", "left").join(s, "metric", "left")


def infer_family(differences: DataFrame, reps: int, seed: int, unit: str, alternatives: dict[str, str], family="family", metric="metric", value="difference", extra: Sequence[str] = (), least: int = 10) -> DataFrame:
    """STA-06: per metric n, mean, median, interval and sign-flip p; false discovery inside the family; status."""
    keys = [*extra, family, metric]
    d = durable(differences.filter(F.col(value).isNotNull()).select(*keys, unit, value))
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("mean_difference"))
    a = a.join(ordered.quantiles(d, keys, value, {"median_difference": 0.5}).drop("n_values"), keys).join(RS.bootstrap_ci(d, keys, value, unit, reps, seed), keys)
    alt = S.ladder([(F.col(family) == f, v) for f, v in alternatives.items()], "two-sided")
    a = a.join(RS.sign_flip_p(d, keys, value, unit, reps, seed, alt).drop("effect_percentile"), keys)
    a = RS.fdr_bh(a, [*extra, family])
    return a.withColumn("status", S.ladder([(F.col("n_events") < least, "insufficient_samples"), (F.col("p_fdr") < 0.05, "supported")], "not_supported"))


def count_sensitivity(differences: DataFrame, primary_count: int, reps: int, seed: int, unit: str, alternatives: dict[str, str], metric="metric") -> DataFrame:
    """STA-07: inference for every control count with direction and status compared to the primary count."""
    t = durable(infer_family(differences, reps, seed, unit, alternatives, metric=metric, extra=["control_count"]))
    p = t.filter(F.col("control_count") == primary_count).select("family", metric, F.col("mean_difference").alias("_m"), F.col("status").alias("_s"))
    out = t.join(p, ["family", metric], "left")
    return (out.withColumn("direction_consistent_with_primary", F.signum("mean_difference") == F.signum("_m")).withColumn("status_consistent_with_primary", F.col("status") == F.col("_s"))
            .withColumn("analysis_role", F.when(F.col("control_count") == primary_count, "primary_regression").otherwise("control_count_sensitivity")).drop("_m", "_s"))


def adjustment_models(rows: DataFrame, outcomes: Sequence[str], base: str, extended: Sequence[str], year: str, reps: int, seed: int, min_cases: int = 100, max_condition: float = 30.0) -> DataFrame:
    """STA-13: intercept of each outcome after adjusting for the focal difference alone (BASE) and with all descriptors (EXTENDED)."""
    flat = rows.select(year, base, *[c for c in extended if c != base], F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("_y")) for o in outcomes])))
    flat = durable(flat)
    parts = []
    for label, xs in (("BASE", [base]), ("EXTENDED", list(extended))):
        f = RS.least_squares(flat, ["outcome"], "_y", xs)
        b = RS.year_block_intercept(flat, ["outcome"], "_y", xs, year, reps, seed)
        m = f.join(b, "outcome").withColumn("model", F.lit(label)).withColumn("intercept", F.col("beta")[0]).drop("beta")
        stable = F.lit(True) if label == "BASE" else (F.col("n_cases") >= min_cases) & (F.col("matrix_rank") == len(xs) + 1) & (F.col("condition_number") <= max_condition)
        for c in ("bootstrap_mean", "bootstrap_median", "ci_low", "ci_high"):
            m = m.withColumn(c, F.when(stable, F.col(c)))
        parts.append(m.withColumn("model_status", F.when(stable, "INTERPRETABLE").otherwise("UNSTABLE_NOT_INTERPRETED")))
    return parts[0].unionByName(parts[1])


def robustness_class(models: DataFrame) -> DataFrame:
    """STA-13: does the intercept stay above zero in both models?"""
    v = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    a = models.groupBy("outcome").agg(v("BASE", "intercept").alias("b"), v("BASE", "ci_low").alias("bl"), v("BASE", "ci_high").alias("bh"), v("EXTENDED", "intercept").alias("e"), v("EXTENDED", "ci_low").alias("el"))
    both = (F.col("b") > 0) & (F.col("bl") > 0) & F.coalesce((F.col("e") > 0) & (F.col("el") > 0), F.lit(False))
    return a.select("outcome", S.ladder([((F.col("b") <= 0) | (F.col("bh") < 0), "NOT_ROBUST"), (both, "ROBUST_TO_FOCAL_STRENGTH")], "PARTIAL").alias("robustness"))
