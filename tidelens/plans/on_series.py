"""Series queries: SRC-01/10/14, FLT-01..04, WIN-01..04/09, AGG-01..03/15/45, SEQ-04/05, SET-01."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, Window as W

from ..functions import scalar as S
from ..operators import timeseries as ts
from ..session import ensure_checkpoint_dir
from ..sources import series as src
from . import inputs as I, walks as WK
from .registry import query

R = S.rounded

SETTINGS = ts.DetectionSettings(first_year=1995, last_year=2001, climatology_first=1996, climatology_last=2000, percentile=10.0)

# SQL building blocks; every name matches an operator step
FILLED = """known AS (SELECT series_id, date, value, lead(date) OVER w AS d1, lead(value) OVER w AS v1 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)),
filled AS (SELECT series_id, CAST(u.d AS DATE) AS date, CASE WHEN CAST(u.d AS DATE) = k.date THEN value ELSE (v1 - value) / (d1 - k.date) * (CAST(u.d AS DATE) - k.date) + value END AS value
  FROM known k, LATERAL (SELECT unnest(generate_series(CAST(k.date AS TIMESTAMP), CAST(coalesce(k.d1 - 1, k.date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d) u)"""


def delta_sql(src_cte: str, out: str, k: int, value: str = "value", name: str = "delta") -> str:
    base = f"lag({value}, {k - 1}) OVER w" if k > 1 else value
    return f"""{out}_raw AS (SELECT *, lead({value}, 1) OVER w - {base} AS raw FROM {src_cte} WINDOW w AS (PARTITION BY series_id ORDER BY date)),
{out} AS (SELECT * EXCLUDE (raw), coalesce(raw, last_value(raw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(raw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS {name} FROM {out}_raw)"""


EDGE = "(day(date) = 1 OR day(date) >= day(last_day(date)) - 1)"
BASE = I.with_ctes("daily") + ",\n" + FILLED + ",\n" + delta_sql("filled", "withdelta", 3) + f""",
base AS (SELECT *, NOT {EDGE} AS candidate FROM withdelta WHERE year(date) BETWEEN 1995 AND 2001 AND NOT (month(date) = 2 AND day(date) = 29)),
clim AS (SELECT series_id, month(date) AS month, day(date) AS day, avg(value) AS value_climo, avg(delta) AS delta_climo, quantile_cont(delta, 0.05) AS delta_p05,
  quantile_cont(delta, 0.95) AS delta_p95, count(delta) AS n FROM base WHERE year(date) BETWEEN 1996 AND 2000 AND NOT {EDGE} GROUP BY 1, 2, 3)"""
ANOM = """, anom0 AS (SELECT b.*, b.value - c.value_climo AS a, row_number() OVER (PARTITION BY b.series_id ORDER BY b.date) AS p
  FROM base b LEFT JOIN clim c ON b.series_id = c.series_id AND month(b.date) = c.month AND day(b.date) = c.day),
anom1 AS (SELECT *, CASE WHEN a IS NOT NULL THEN p END AS kp FROM anom0),
anom2 AS (SELECT *, last_value(kp IGNORE NULLS) OVER b AS p0, last_value(a IGNORE NULLS) OVER b AS a0, first_value(kp IGNORE NULLS) OVER f AS p1, first_value(a IGNORE NULLS) OVER f AS a1 FROM anom1
  WINDOW b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
anom AS (SELECT series_id, date, value, delta, candidate, CASE WHEN a IS NOT NULL THEN a ELSE coalesce((a1 - a0) / (p1 - p0) * (p - p0) + a0, a0, a1) END AS anomaly FROM anom2),
""" + delta_sql("anom", "mr", 3, "anomaly", "delta_mean_removed")


def _daily(spark, sf):
    return I.daily(spark, sf)


@query("src_01_series_csv_scan", I.with_ctes("daily") + " SELECT date, round(sum(value), 6) + 0.0 AS value FROM daily GROUP BY date")
def _(spark, sf):
    total = _daily(spark, sf).groupBy("date").agg(R(F.sum("value")).alias("extent"))
    path = f"{ensure_checkpoint_dir(spark)}/series-{uuid.uuid4().hex}"
    wide = total.select(F.year("date").alias("Year"), F.month("date").alias("Month"), F.dayofmonth("date").alias("Day"), F.col("extent").alias("Extent"))
    wide.write.option("header", True).csv(path)
    return src.read_series_csv(spark, path)


@query("src_10_event_csv_sink", BASE + ANOM + """, cut AS (SELECT series_id, quantile_cont(delta_mean_removed, 0.1) FILTER (candidate) AS threshold FROM mr GROUP BY 1)
SELECT series_id, strftime(date, '%Y-%m-%d') AS date, round(delta_mean_removed, 6) + 0.0 AS event_value FROM mr JOIN cut USING (series_id) WHERE candidate AND delta_mean_removed <= threshold""")
def _(spark, sf):
    import dataclasses
    found = ts.detect(_daily(spark, sf), dataclasses.replace(SETTINGS, gap_days=0), "mean_removed").select("series_id", "date", R("event_value").alias("event_value"))
    path = f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    src.write_events(found, path)
    return spark.read.csv(path, header=True, schema="series_id string, date string, event_value double")


@query("src_11_plain_tsv_sink", I.with_ctes("daily") + " SELECT series_id, round(sum(value), 6) + 0.0 AS total FROM daily GROUP BY 1")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/tsv-{uuid.uuid4().hex}"
    src.write_plain_tsv(_daily(spark, sf).groupBy("series_id").agg(R(F.sum("value")).alias("total")), path)
    return spark.read.csv(path, sep="\t", schema="series_id string, total double")


@query("src_14_calendar", I.with_ctes("daily") + """, b AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1)
SELECT series_id, CAST(u.d AS DATE) AS date FROM b, LATERAL (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d) u WHERE month(u.d) IN (6, 7, 8)""")
def _(spark, sf):
    span = _daily(spark, sf).groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return span.select("series_id", F.explode(F.sequence("lo", "hi")).alias("date")).filter(S.in_months("date", "jja"))


@query("flt_01_months", I.with_ctes("daily") + " SELECT series_id, date, value FROM daily WHERE month(date) IN (12, 1, 2)")
def _(spark, sf):
    return _daily(spark, sf).filter(S.in_months("date", "djf"))


@query("flt_02_months_label", I.with_ctes("daily") + """ SELECT series_id, count(*) FILTER (month(date) IN (12, 1, 2)) AS djf, count(*) FILTER (month(date) IN (3, 4, 5)) AS mam,
  count(*) FILTER (month(date) IN (6, 7, 8)) AS jja, count(*) FILTER (month(date) IN (5, 10)) AS "m05-10" FROM daily GROUP BY 1""")
def _(spark, sf):
    picks = ["djf", "mam", "summer", (10, 5)]
    return _daily(spark, sf).groupBy("series_id").agg(*[F.count_if(S.in_months("date", p)).alias(S.months_label(p)) for p in picks])


@query("flt_03_leap_days_and_years", I.with_ctes("daily") + " SELECT series_id, date FROM daily WHERE year(date) BETWEEN 1996 AND 2000 AND NOT (month(date) = 2 AND day(date) = 29)")
def _(spark, sf):
    return _daily(spark, sf).filter(S.keep_year_range_without_leap_day("date", 1996, 2000)).select("series_id", "date")


@query("flt_04_month_edge_flag", I.with_ctes("daily") + f" SELECT series_id, date, {EDGE} AS edge FROM daily")
def _(spark, sf):
    return _daily(spark, sf).select("series_id", "date", S.month_edge("date").alias("edge"))


for _k in (1, 2, 3):
    @query(f"win_01_delta_{_k}_days", I.with_ctes("daily") + ",\n" + FILLED + ",\n" + delta_sql("filled", "d", _k) + " SELECT series_id, date, round(value, 6) + 0.0 AS value, round(delta, 6) + 0.0 AS delta FROM d")
    def _(spark, sf, k=_k):
        return ts.k_day_delta(ts.fill_days(_daily(spark, sf)), k).select("series_id", "date", R("value").alias("value"), R("delta").alias("delta"))


@query("win_02_fill_days", I.with_ctes("daily") + ",\n" + FILLED + " SELECT series_id, date, round(value, 6) + 0.0 AS value FROM filled")
def _(spark, sf):
    return ts.fill_days(_daily(spark, sf)).select("series_id", "date", R("value").alias("value"))


@query("win_03_fill_positions", BASE + ANOM + " SELECT series_id, date, round(anomaly, 6) + 0.0 AS anomaly FROM mr")
def _(spark, sf):
    base = ts.prepared(_daily(spark, sf), SETTINGS)
    return ts.mean_removed_delta(base, ts.day_climatology(ts.climatology_rows(base, SETTINGS))).select("series_id", "date", R("anomaly").alias("anomaly"))


@query("win_04_mean_removed_delta", BASE + ANOM + " SELECT series_id, date, round(delta_mean_removed, 6) + 0.0 AS delta_mean_removed FROM mr")
def _(spark, sf):
    base = ts.prepared(_daily(spark, sf), SETTINGS)
    return ts.mean_removed_delta(base, ts.day_climatology(ts.climatology_rows(base, SETTINGS))).select("series_id", "date", R("delta_mean_removed").alias("delta_mean_removed"))


@query("agg_01_day_climatology", BASE + " SELECT series_id, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, round(value_climo, 6) + 0.0 AS value_climo, round(delta_climo, 6) + 0.0 AS delta_climo, round(delta_p05, 6) + 0.0 AS delta_p05, round(delta_p95, 6) + 0.0 AS delta_p95, n FROM clim")
def _(spark, sf):
    c = ts.day_climatology(ts.climatology_rows(ts.prepared(_daily(spark, sf), SETTINGS), SETTINGS))
    return c.select("series_id", "month", "day", *[R(x).alias(x) for x in ("value_climo", "delta_climo", "delta_p05", "delta_p95")], "n")


@query("agg_02_month_percentiles", BASE + f""" SELECT series_id, CAST(month(date) AS INTEGER) AS month, round(quantile_cont(delta, 0.05), 6) + 0.0 AS delta_month_p05, round(quantile_cont(delta, 0.10), 6) + 0.0 AS delta_month_p10,
  round(quantile_cont(delta, 0.95), 6) + 0.0 AS delta_month_p95, round(quantile_cont(delta, 0.025), 6) + 0.0 AS delta_month_custom, count(delta) AS n FROM base WHERE year(date) BETWEEN 1996 AND 2000 AND NOT {EDGE} GROUP BY 1, 2""")
def _(spark, sf):
    m = ts.month_percentiles(ts.climatology_rows(ts.prepared(_daily(spark, sf), SETTINGS), SETTINGS), 2.5)
    return m.select("series_id", "month", *[R(x).alias(x) for x in ("delta_month_p05", "delta_month_p10", "delta_month_p95", "delta_month_custom")], "n")


@query("agg_03_thresholds", BASE + """ SELECT series_id, round(quantile_cont(delta, 0.05), 6) + 0.0 AS all_rows, round(quantile_cont(delta, 0.05) FILTER (candidate), 6) + 0.0 AS masked_rows FROM base GROUP BY 1""")
def _(spark, sf):
    base = ts.prepared(_daily(spark, sf), SETTINGS)
    both = ts.series_threshold(base, "delta", 5.0, out="all_rows").join(ts.series_threshold(base, "delta", 5.0, F.col("candidate"), out="masked_rows"), "series_id")
    return both.select("series_id", R("all_rows").alias("all_rows"), R("masked_rows").alias("masked_rows"))


DETECT = BASE + ANOM + """, cut AS (SELECT series_id, quantile_cont(delta_mean_removed, 0.1) FILTER (candidate) AS threshold FROM mr GROUP BY 1),
hit AS (SELECT mr.*, threshold FROM mr JOIN cut USING (series_id) WHERE candidate AND delta_mean_removed <= threshold),
nxt AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS nd FROM hit),
kept AS (SELECT * FROM nxt WHERE nd IS NULL OR nd - date > 1)"""


@query("seq_05_detect_mean_removed", DETECT + """ SELECT series_id, date, round(value, 6) + 0.0 AS value, round(delta, 6) + 0.0 AS delta, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
  'mean_removed' AS method, round(delta_mean_removed, 6) + 0.0 AS event_value, round(threshold, 6) + 0.0 AS threshold FROM kept""")
def _(spark, sf):
    d = ts.detect(_daily(spark, sf), SETTINGS, "mean_removed")
    return d.select("series_id", "date", R("value").alias("value"), R("delta").alias("delta"), "year", "month", "day", "method", R("event_value").alias("event_value"), R("threshold").alias("threshold"))


HIGHPASS = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + WK.highpass_walk(18.0, 12)


@query("seq_04_highpass", HIGHPASS + " SELECT series_id, date, round(delta_highpass, 6) + 0.0 AS delta_highpass FROM hp")
def _(spark, sf):
    base = ts.prepared(_daily(spark, sf), SETTINGS)
    return ts.highpass(base).select("series_id", "date", R("delta_highpass").alias("delta_highpass"))


@query("seq_05_detect_both", DETECT.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + WK.highpass_walk(18.0, 12) + """, hc AS (SELECT series_id, quantile_cont(delta_highpass, 0.1) AS threshold FROM hp GROUP BY 1),
both_ AS (SELECT series_id, date, value, delta, 'mean_removed' AS method, delta_mean_removed AS event_value, threshold FROM hit UNION ALL SELECT b.series_id, b.date, b.value, b.delta, 'butterworth', delta_highpass, threshold FROM base b JOIN hp ON hp.series_id = b.series_id AND hp.date = b.date JOIN hc ON hc.series_id = b.series_id WHERE candidate AND delta_highpass <= threshold),
nb AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date, method) AS nd2 FROM both_)
SELECT series_id, date, method, round(value, 6) + 0.0 AS value, round(delta, 6) + 0.0 AS delta, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, round(event_value, 6) + 0.0 AS event_value, round(threshold, 6) + 0.0 AS threshold FROM nb WHERE nd2 IS NULL OR nd2 - date > 1""")
def _(spark, sf):
    d = ts.detect(_daily(spark, sf), SETTINGS, "both")
    return d.select("series_id", "date", "method", *[R(c).alias(c) for c in ("value", "delta")], "year", "month", "day", *[R(c).alias(c) for c in ("event_value", "threshold")])


@query("set_01_union_of_branches", BASE + ANOM + """, cut AS (SELECT series_id, quantile_cont(delta_mean_removed, 0.1) FILTER (candidate) AS t1, quantile_cont(delta, 0.1) AS t2 FROM mr GROUP BY 1),
u AS (SELECT series_id, date, 'mean_removed' AS method FROM mr JOIN cut USING (series_id) WHERE candidate AND delta_mean_removed <= t1 UNION ALL
      SELECT series_id, date, 'plain' AS method FROM mr JOIN cut USING (series_id) WHERE candidate AND delta <= t2)
SELECT series_id, date, method, row_number() OVER (PARTITION BY series_id ORDER BY date, method) AS pos FROM u""")
def _(spark, sf):
    import dataclasses
    base = ts.prepared(_daily(spark, sf), SETTINGS)
    a = ts.detect(_daily(spark, sf), dataclasses.replace(SETTINGS, gap_days=0), "mean_removed").select("series_id", "date", "method")
    cut = F.percentile("delta", F.lit(0.1)).over(W.partitionBy("series_id"))
    b = base.withColumn("t", cut).filter("candidate and delta <= t").select("series_id", "date", F.lit("plain").alias("method"))
    return a.unionByName(b).withColumn("pos", F.row_number().over(W.partitionBy("series_id").orderBy("date", "method")).cast("long"))


@query("win_09_keep_last_of_block", I.with_ctes("daily") + """, n AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS nd FROM daily WHERE value < 0.1)
SELECT series_id, date FROM n WHERE nd IS NULL OR nd - date > 2""")
def _(spark, sf):
    low = _daily(spark, sf).filter("value < 0.1")
    return ts.keep_last_of_block(low, 2, order=()).select("series_id", "date")


@query("agg_15_median_year", I.with_ctes("daily") + """, a AS (SELECT series_id, year(date) AS year, avg(value) AS m FROM daily GROUP BY 1, 2), q AS (SELECT series_id, quantile_cont(m, 0.5) AS med FROM a GROUP BY 1)
SELECT series_id, CAST(arg_min(year, abs(m - med) * 1e6::DOUBLE + year / 1e6::DOUBLE) AS INTEGER) AS year, round(any_value(med), 6) + 0.0 AS median_of_years FROM a JOIN q USING (series_id) GROUP BY 1""")
def _(spark, sf):
    annual = _daily(spark, sf).groupBy("series_id", F.year("date").alias("year")).agg(F.avg("value").alias("m"))
    w = annual.withColumn("med", F.percentile("m", F.lit(0.5)).over(W.partitionBy("series_id")))
    return w.groupBy("series_id").agg(F.min_by("year", F.struct(F.abs(F.col("m") - F.col("med")), F.col("year"))).alias("year"), R(F.max("med")).alias("median_of_years"))


@query("agg_45_event_counts_by_year", BASE + ANOM + """, cut AS (SELECT series_id, quantile_cont(delta_mean_removed, 0.1) FILTER (candidate) AS threshold FROM mr GROUP BY 1),
h AS (SELECT year(date) AS year, series_id FROM mr JOIN cut USING (series_id) WHERE candidate AND delta_mean_removed <= threshold)
SELECT CAST(year AS INTEGER) AS year, count(*) FILTER (series_id = '1-URGENT') AS urgent, count(*) FILTER (series_id = '5-LOW') AS low, count(*) FILTER (series_id NOT IN ('1-URGENT', '5-LOW')) AS other FROM h GROUP BY 1""")
def _(spark, sf):
    import dataclasses
    d = ts.detect(_daily(spark, sf), dataclasses.replace(SETTINGS, gap_days=0), "mean_removed")
    label = S.ladder([(F.col("series_id") == "1-URGENT", "urgent"), (F.col("series_id") == "5-LOW", "low")], "other")
    return d.withColumn("label", label).groupBy("year").pivot("label", ["urgent", "low", "other"]).count().fillna(0)
