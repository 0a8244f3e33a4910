"""Number text, frames of the coded field, missing regions of clusters."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidelens.functions import scalar as S
from tidelens.operators import tracking as T
from tidelens.plans import inputs as I


def test_significant_text_matches_printf(spark):
    r = random.Random(4)
    values = [0.0, -0.1, 0.25, 2.0, 1e-8, -3.5e-5, 1e-4, 123456789012.0, 1234567890123.0, 999999999999.9, 0.1 + 0.2, 1 / 3, -2e300, 1e-300, 999999.5, 9.9999999999996, 0.5 + 2.0**-13, 4349.3051910400390625, *[k / 1024 + 0.0009765625 / 2 for k in range(900, 960)]]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 14) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.significant_text("v", 12).alias("a"), S.significant_text("v", 6).alias("b")).collect()
    for row in rows:
        assert row["a"] == "%.12g" % row["v"] and row["b"] == "%.6g" % row["v"], row
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(S.significant_text("v").alias("t")).collect()
    assert [x["t"] for x in odd] == ["nan", "inf", None]


def test_coded_field_keeps_every_frame(spark, sf, monkeypatch):
    days = [dt.date(1995, 1, 6), dt.date(1995, 2, 20), dt.date(2003, 5, 1)]
    few = I.grid(spark, sf).filter("y = 3 AND x < 4").select("y", "x")
    rows = few.withColumn("date", F.explode(F.array(*[F.lit(d) for d in days]))).withColumn("value", F.lit(0.75))
    monkeypatch.setattr(I, "field", lambda s, d: rows)
    got = {r["date"] for r in I.coded(spark, sf).filter("code = 1").collect()}
    ocean = I.grid(spark, sf).filter("y = 3 AND x < 4 AND region_code <= 18").count()
    assert ocean == 0 or got == set(days)
    assert {r["date"] for r in I.coded(spark, sf).select("date").distinct().collect()} == set(days)


def test_missing_regions_never_match(spark):
    rows = [(f"E{i}", dt.date(2001, 1, 1 + i), region, 10.0, 70.0, 5.0) for i, region in enumerate(["a", None, None, "a"])]
    events = spark.createDataFrame(rows, "unique_local_event_id string, event_start date, dominant_region string, track_centroid_lon double, track_centroid_lat double, cumulative_loss double")
    out = T.cluster_events(events, {"a": ()}).collect()
    opener = {r["unique_local_event_id"]: r["opener"] for r in out}
    assert opener == {"E0": "E0", "E1": "E1", "E2": "E2", "E3": "E0"}
