"""Engine inputs derived from the given tables, once as DataFrames and once as SQL for the oracle.

Amounts are scaled by powers of two so that sums are exact in double precision and
do not depend on the order in which partitions are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import numbered_id
from ..session import shuffled

EPOCH = "1995-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plus_days(c):
    """1995-01-01 plus a whole number of days."""
    return F.date_add(F.lit(EPOCH).cast("date"), c.cast("int"))


def whole_cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def daily(spark, sf) -> DataFrame:
    """daily_series: order value per priority and day (days without orders are missing)."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
        .agg((F.sum(whole_cents("o_totalprice")).cast("double") / 134217728.0).alias("value"))
    )


DAILY = """daily AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
  CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 134217728.0::DOUBLE AS value FROM orders GROUP BY 1, 2)"""


def field(spark, sf) -> DataFrame:
    """field_daily: mean discount on a (supplier row, part column) strip, one frame per quarter.

    Frames are numbered as consecutive days; the strip grows with the part table.
    """
    li = table(spark, sf, "lineitem")
    frame = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    return (
        li.groupBy(
            plus_days(frame).alias("date"),
            (F.col("l_suppkey") % 25).cast("int").alias("y"),
            F.floor(F.col("l_partkey") / 50).cast("int").alias("x"),
        )
        .agg((F.floor(F.sum(whole_cents("l_discount")).cast("double") * 102.4 / F.count(F.lit(1)) + 0.5).cast("double") / 1024.0).alias("value"))
        .select("date", "y", "x", F.least("value", F.lit(1.0)).alias("value"))
    )


FIELD = """field AS (SELECT DATE '1995-01-01' + CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS date,
  CAST(l_suppkey % 25 AS INTEGER) AS y, CAST(l_partkey // 50 AS INTEGER) AS x,
  least(CAST(floor(CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 102.4::DOUBLE / COUNT(*) + 0.5::DOUBLE) AS DOUBLE) / 1024.0::DOUBLE, 1.0::DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""


def grid(spark, sf) -> DataFrame:
    """grid_cell: the strip behind ``field`` with areas, region codes and coordinates."""
    columns = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("x")).distinct()
    y, x = F.col("y"), F.col("x")
    code = F.floor(y / 5) * 4 + F.floor(x / 10) % 4
    return columns.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(
        "y", "x",
        (x * 25000.0 - 500000.0).alias("x_m"),
        (F.lit(300000.0) - y * 25000.0).alias("y_m"),
        ((x * 9) % 360 - 180.0).alias("lon"),
        (y + 60.0).alias("lat"),
        (y * 7 + (x % 40) * 3 + 500.0).alias("area_km2"),
        F.when(code == 19, 30).otherwise(code).cast("int").alias("region_code"),
    )


GRID = """grid AS (SELECT CAST(r.y AS INTEGER) AS y, c.x, c.x * 25000.0::DOUBLE - 500000.0::DOUBLE AS x_m, 300000.0::DOUBLE - r.y * 25000.0::DOUBLE AS y_m,
  ((c.x * 9) % 360) - 180.0::DOUBLE AS lon, r.y + 60.0::DOUBLE AS lat, r.y * 7 + (c.x % 40) * 3 + 500.0::DOUBLE AS area_km2,
  CAST(CASE WHEN (r.y // 5) * 4 + (c.x // 10) % 4 = 19 THEN 30 ELSE (r.y // 5) * 4 + (c.x // 10) % 4 END AS INTEGER) AS region_code
  FROM (SELECT DISTINCT CAST(p_partkey // 50 AS INTEGER) AS x FROM part) c, (SELECT range AS y FROM range(0, 25)) r)"""


def coded(spark, sf) -> DataFrame:
    """coded_daily: 1 where the field is at least 0.5, 0 below, 254 on land, 255 where a cell has no value."""
    f, g = field(spark, sf), grid(spark, sf)
    frames = f.select(F.array_sort(F.collect_set("date"))).scalar()  # one entry per day of the calendar
    full = g.select("y", "x", "region_code", F.explode(frames).alias("date"))
    return (
        full.join(shuffled(f), ["date", "y", "x"], "left")
        .select("date", "y", "x", F.when(F.col("region_code") > 18, 254).when(F.col("value").isNull(), 255)
                .when(F.col("value") >= 0.5, 1).otherwise(0).cast("int").alias("code"))
    )


CODED = """coded AS (SELECT d.date, g.y, g.x, CAST(CASE WHEN g.region_code > 18 THEN 254 WHEN f.value IS NULL THEN 255 WHEN f.value >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS code
  FROM grid g CROSS JOIN (SELECT DISTINCT date FROM field) d LEFT JOIN field f ON f.date = d.date AND f.y = g.y AND f.x = g.x)"""


def events(spark, sf) -> DataFrame:
    """event: one tracked event per customer, from that customer's orders."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("event_start"),
        F.count(F.lit(1)).alias("n"),
        F.sum(whole_cents("o_totalprice")).alias("cents"),
        F.max(whole_cents("o_totalprice")).alias("top"),
    )
    k = F.col("c_custkey")
    return (
        per.join(c, per.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            numbered_id("E", k, 8).alias("unique_local_event_id"),
            F.concat(F.lit("R"), F.col("n_regionkey")).alias("dominant_region"),
            "event_start",
            F.date_add("event_start", (F.col("n") % 6).cast("int")).alias("event_end"),
            (F.col("n") % 6 + 1).cast("int").alias("duration_days"),
            (F.col("n") * 20 + k % 13).cast("int").alias("max_area_cells"),
            ((F.col("n") * 20 + k % 13) * 625.0).alias("max_area_km2"),
            (F.col("top") / 134217728.0).alias("max_intensity"),
            (-0.125 - (k % 5) * 0.0625).alias("min_sic_change"),
            (F.col("cents") / 65536.0).alias("cumulative_loss"),
            ((k * 37) % 360 - 180.0).alias("track_centroid_lon"),
            ((k * 17) % 40 + 50.0).alias("track_centroid_lat"),
            F.lit(-0.125).alias("sic_change_threshold"),
            (k % 3 == 0).alias("overlap_with_series_event"),
            (k % 4 == 0).alias("overlap_with_regional_event_v1"),
        )
    )


EVENTS = """ev AS (SELECT 'E' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS unique_local_event_id, 'R' || n_regionkey AS dominant_region, event_start,
  event_start + CAST(n % 6 AS INTEGER) AS event_end, CAST(n % 6 + 1 AS INTEGER) AS duration_days, CAST(n * 20 + c_custkey % 13 AS INTEGER) AS max_area_cells,
  (n * 20 + c_custkey % 13) * 625.0::DOUBLE AS max_area_km2, CAST(top AS DOUBLE) / 134217728.0::DOUBLE AS max_intensity,
  -0.125::DOUBLE - (c_custkey % 5) * 0.0625::DOUBLE AS min_sic_change, CAST(cents AS DOUBLE) / 65536.0::DOUBLE AS cumulative_loss,
  (c_custkey * 37) % 360 - 180.0::DOUBLE AS track_centroid_lon, (c_custkey * 17) % 40 + 50.0::DOUBLE AS track_centroid_lat, -0.125::DOUBLE AS sic_change_threshold,
  c_custkey % 3 = 0 AS overlap_with_series_event, c_custkey % 4 = 0 AS overlap_with_regional_event_v1
  FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS event_start, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
        max(CAST(round(o_totalprice * 100) AS BIGINT)) AS top FROM orders GROUP BY 1) p
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def pan(spark, sf) -> DataFrame:
    """series events with a place: one per supplier."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        numbered_id("PAN", k, 6).alias("event_id"),
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("region"),
        plus_days((k * 23) % 2400).alias("event_date"),
        ((k * 53) % 360 - 180.0).alias("centroid_lon"),
        ((k * 13) % 40 + 50.0).alias("centroid_lat"),
    )


PAN = """pan AS (SELECT 'PAN' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS event_id, 'R' || n_regionkey AS region,
  DATE '1995-01-01' + CAST((s_suppkey * 23) % 2400 AS INTEGER) AS event_date, (s_suppkey * 53) % 360 - 180.0::DOUBLE AS centroid_lon,
  (s_suppkey * 13) % 40 + 50.0::DOUBLE AS centroid_lat FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def pan_frames(spark, sf) -> DataFrame:
    """series events dated on the frames of ``field`` (so every window can be read)."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(numbered_id("PAN", k, 6).alias("pan_event_id"), plus_days(k % 22 + 5).alias("event_date"))


PANF = """panf AS (SELECT 'PAN' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS pan_event_id, DATE '1995-01-01' + CAST(s_suppkey % 22 + 5 AS INTEGER) AS event_date FROM supplier)"""


def patches(spark, sf) -> DataFrame:
    """patch: one per row of the events table, dated on the frames of ``field``."""
    e, u = F.col("event_id"), F.col("user_id")
    cells = (F.lit(4) + e % 40).cast("int")
    return table(spark, sf, "events").select(
        numbered_id("OBJ", e, 8).alias("object_id"),
        F.col("event_type").alias("region"),
        plus_days(F.dayofmonth("ts") - 1).alias("date"),
        plus_days(F.dayofmonth("ts") - 4).alias("start_date"),
        ((u * 47) % 360 - 180.0 + (e % 5) * 0.5).alias("centroid_lon"),
        ((u * 7) % 29 + 60.0 + (e % 3) * 0.25).alias("centroid_lat"),
        cells.alias("object_area_cells"),
        (cells * 625.0).alias("object_area_km2"),
        (-0.125 - (e % 9) * 0.03125).alias("mean_sic_change"),
        (-0.25 - (e % 7) * 0.0625).alias("min_sic_change"),
        (F.round(F.col("value") * 100).cast("bigint") / 128.0).alias("cumulative_sic_loss"),
        F.lit(3).alias("window_days"),
        F.lit(-0.1).alias("threshold"),
        (e % 5 == 0).alias("overlap_with_series_event"),
        (u % 4 == 0).alias("overlap_with_regional_event"),
        e.alias("k"), u.alias("u"),
    )


PATCHES = """patch AS (SELECT 'OBJ' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS object_id, event_type AS region,
  DATE '1995-01-01' + CAST(day(ts) - 1 AS INTEGER) AS date, DATE '1995-01-01' + CAST(day(ts) - 4 AS INTEGER) AS start_date,
  (user_id * 47) % 360 - 180.0::DOUBLE + (event_id % 5) * 0.5::DOUBLE AS centroid_lon, (user_id * 7) % 29 + 60.0::DOUBLE + (event_id % 3) * 0.25::DOUBLE AS centroid_lat,
  CAST(4 + event_id % 40 AS INTEGER) AS object_area_cells, (4 + event_id % 40) * 625.0::DOUBLE AS object_area_km2,
  -0.125::DOUBLE - (event_id % 9) * 0.03125::DOUBLE AS mean_sic_change, -0.25::DOUBLE - (event_id % 7) * 0.0625::DOUBLE AS min_sic_change,
  CAST(round(value * 100) AS BIGINT) / 128.0::DOUBLE AS cumulative_sic_loss, 3 AS window_days, -0.1::DOUBLE AS threshold,
  event_id % 5 = 0 AS overlap_with_series_event, user_id % 4 = 0 AS overlap_with_regional_event, event_id AS k, user_id AS u FROM events)"""


def patch_cells(spark, sf) -> DataFrame:
    """patch_cell: the sparse footprint of every patch."""
    p = patches(spark, sf).select("object_id", "k", "u", "object_area_cells", "start_date", "date")
    j = F.col("j")
    return p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("object_area_cells") - 1))).select(
        "object_id", "date", "start_date",
        ((F.col("u") + F.floor(j / 6)) % 25).cast("int").alias("y"),
        ((F.col("k") * 3) % 35 + j % 6).cast("int").alias("x"),
        (-0.125 - (j % 7) * 0.03125).alias("delta"),
    )


PATCH_CELLS = """pcell AS (SELECT object_id, date, start_date, CAST((u + j // 6) % 25 AS INTEGER) AS y, CAST((k * 3) % 35 + j % 6 AS INTEGER) AS x,
  -0.125::DOUBLE - (j % 7) * 0.03125::DOUBLE AS delta FROM (SELECT *, unnest(range(0, object_area_cells)) AS j FROM patch))"""


def members(spark, sf) -> DataFrame:
    """event_member: patches grouped into events by (user, region), with a level per event (1 broad, 2 severe, 3 major)."""
    p = patches(spark, sf)
    uid = F.concat(F.lit("L"), F.col("u"), F.lit("-"), F.col("region"))
    level = F.when(F.col("u") % 7 == 0, 3).when(F.col("u") % 3 == 0, 2).otherwise(1)
    return p.select(uid.alias("unique_local_event_id"), "object_id", "date", "start_date", level.alias("level"),
                    (F.col("u") % 18 + 1).cast("int").alias("event_region_code"), "cumulative_sic_loss")


MEMBERS = """member AS (SELECT 'L' || u || '-' || region AS unique_local_event_id, object_id, date, start_date,
  CASE WHEN u % 7 = 0 THEN 3 WHEN u % 3 = 0 THEN 2 ELSE 1 END AS level, CAST(u % 18 + 1 AS INTEGER) AS event_region_code, cumulative_sic_loss FROM patch)"""


def lagged(spark, sf) -> DataFrame:
    """lagged event samples: order values of a customer by day lag around that customer's first order.

    Lags are folded onto the nine diagnostic lags so every event has values in each group.
    """
    o = table(spark, sf, "orders")
    k, ok = F.col("o_custkey"), F.col("o_orderkey")
    lag = F.element_at(F.array(*[F.lit(v) for v in (-10, -7, -5, -3, -1, 0, 1, 3, 5)]), (ok % 9 + 1).cast("int"))
    return o.select(
        numbered_id("E", k, 8).alias("event_id"),
        F.concat(F.lit("R"), k % 5).alias("region"),
        (F.lit(100) + (ok % 2) * 200).cast("int").alias("buffer_km"),
        F.year("o_orderdate").alias("year"),
        lag.cast("int").alias("lag"),
        (whole_cents("o_totalprice") / 16777216.0).alias("v1"),
        F.when(ok % 11 != 0, (ok % 97) / 64.0 + F.when((ok % 9).isin(4, 5) & (k % 5 < 3), 0.5).otherwise(0.0)).alias("v2"),
    )


LAGGED = """lagged AS (SELECT 'E' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS event_id, 'R' || (o_custkey % 5) AS region, CAST(100 + (o_orderkey % 2) * 200 AS INTEGER) AS buffer_km,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST([-10, -7, -5, -3, -1, 0, 1, 3, 5][o_orderkey % 9 + 1] AS INTEGER) AS lag,
  CAST(round(o_totalprice * 100) AS BIGINT) / 16777216.0::DOUBLE AS v1, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 97) / 64.0::DOUBLE + CASE WHEN o_orderkey % 9 IN (4, 5) AND o_custkey % 5 < 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS v2 FROM orders)"""


def diffs(spark, sf) -> DataFrame:
    """case differences: one unit per customer, split into families and metrics."""
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    per = o.groupBy("o_custkey").agg(F.avg(whole_cents("o_totalprice") / 1048576.0).alias("m"), F.count(F.lit(1)).alias("n"),
                                     F.min(F.year("o_orderdate")).alias("year"))
    metric = (k % 6).cast("int")
    return per.select(
        F.when(metric < 3, "coloss").otherwise("compensation").alias("family"),
        F.concat(F.lit("m"), metric).alias("metric"),
        k.cast("string").alias("unit_id"),
        F.col("year").cast("int").alias("year"),
        (F.floor((F.col("m") - 24.0 + metric * 0.25) * 1024.0).cast("double") / 1024.0).alias("difference"),
    )


DIFFS = """diffs AS (SELECT CASE WHEN o_custkey % 6 < 3 THEN 'coloss' ELSE 'compensation' END AS family, 'm' || (o_custkey % 6) AS metric, CAST(o_custkey AS VARCHAR) AS unit_id,
  CAST(min(year(o_orderdate)) AS INTEGER) AS year,
  floor((avg(CAST(round(o_totalprice * 100) AS BIGINT) / 1048576.0::DOUBLE) - 24.0::DOUBLE + (o_custkey % 6) * 0.25::DOUBLE) * 1024.0::DOUBLE) / 1024.0::DOUBLE AS difference
  FROM orders GROUP BY o_custkey)"""

CTES = {
    "daily": (DAILY, ()), "field": (FIELD, ()), "grid": (GRID, ()), "coded": (CODED, ("field", "grid")), "ev": (EVENTS, ()), "pan": (PAN, ()),
    "panf": (PANF, ()), "patch": (PATCHES, ()), "pcell": (PATCH_CELLS, ("patch",)), "member": (MEMBERS, ("patch",)),
    "lagged": (LAGGED, ()), "diffs": (DIFFS, ()),
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """WITH clause holding the named inputs and whatever they need, in order; ends with a comma-free list."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n][0] for n in order)


def met(spark, sf) -> DataFrame:
    """met_daily on a 10 x 18 latitude/longitude grid, from the orders table; (i, j) are grid indices."""
    o = table(spark, sf, "orders")
    i, j = (F.col("o_custkey") % 10).cast("int"), (F.col("o_orderkey") % 18).cast("int")
    frame = (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1
    g = o.groupBy(plus_days(frame).alias("date"), i.alias("i"), j.alias("j")).agg(
        F.sum(whole_cents("o_totalprice")).alias("cents"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    return g.select(
        "date", "i", "j", (F.col("i") * 4 + 50.0).alias("lat"), (F.col("j") * 20 - 180.0).alias("lon"),
        (96000.0 + F.floor(F.col("cents").cast("double") / F.col("n") / 8192.0)).alias("msl"),
        ((F.col("s") % 41 - 20) / 2.0).alias("u10"), ((F.col("s") % 37 - 18) / 2.0).alias("v10"),
    )


MET = """met AS (SELECT date, i, j, i * 4 + 50.0::DOUBLE AS lat, j * 20 - 180.0::DOUBLE AS lon, 96000.0::DOUBLE + floor(CAST(cents AS DOUBLE) / n / 8192.0::DOUBLE) AS msl,
  CAST(s % 41 - 20 AS DOUBLE) / 2.0::DOUBLE AS u10, CAST(s % 37 - 18 AS DOUBLE) / 2.0::DOUBLE AS v10
  FROM (SELECT DATE '1995-01-01' + CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS date, CAST(o_custkey % 10 AS INTEGER) AS i, CAST(o_orderkey % 18 AS INTEGER) AS j,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n, sum(o_orderkey) AS s FROM orders GROUP BY 1, 2, 3))"""
CTES["met"] = (MET, ())


def plane_points(spark, sf) -> DataFrame:
    """points on the projected strip, one per supplier, dated on the frames of ``field``."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        numbered_id("PAN", k, 6).alias("point_id"), plus_days(k % 22 + 5).alias("event_date"),
        ((k * 7 % 40) * 25000.0 - 500000.0 + 9000.0).alias("px_m"), (F.lit(300000.0) - (k * 3 % 25) * 25000.0 + 4000.0).alias("py_m"))


def met_points(spark, sf) -> DataFrame:
    k = F.substring("event_id", 4, 20).cast("bigint")
    return pan(spark, sf).select(F.col("event_id").alias("point_id"), plus_days(k % 27).alias("sample_date"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
