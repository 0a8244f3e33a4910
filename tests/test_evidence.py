from pyspark.sql import functions as F

from tidelens.operators import evidence as E
from tidelens.plans import inputs as I, on_evidence as OE
from tidelens.plans.registry import QUERIES

KEYS = "region string, buffer_km int, variable string"


def test_a_scenario_without_control_or_years_is_not_stable(spark):
    keys = [(f"R{i}", 100, "v1") for i in range(4)]
    location = spark.createDataFrame([(*k, True, True) for k in keys], KEYS + ", primary_supported boolean, floor_supported boolean")
    sp = spark.createDataFrame([(*k, True, i != 1) for i, k in enumerate(keys)], KEYS + ", primary_specific boolean, floor_specific boolean")
    year = spark.createDataFrame([(*k, True, i != 2) for i, k in enumerate(keys[:3])], KEYS + ", primary_confirmed boolean, floor_confirmed boolean")
    checks, regions = E.stable_specificity(location, sp, year)
    assert {r.region: r.stable_spatial_specificity for r in checks.collect()} == {"R0": True, "R1": False, "R2": False, "R3": False}
    assert [tuple(r) for r in regions.collect()] == [("v1", 1, 1)]


def test_one_year_or_two_differences_confirm_nothing(spark):
    t = spark.createDataFrame([(1, 9, True), (2, 2, True), (2, 3, True), (2, 3, False), (2, 3, None)], "n_years int, n_events int, ci_excludes_zero boolean")
    assert [r[0] for r in t.select(E.year_confirmed()).collect()] == [False, False, True, False, False]


def test_the_floor_scenario_is_checked_on_its_own_samples(spark, sf, monkeypatch):
    """with constant floor samples no interval leaves zero, whatever the primary samples say"""
    plain = I.lagged
    up = lambda spark, sf: plain(spark, sf).withColumn("v2", F.when(F.col("lag").isin(-1, 0), 2.0).otherwise(1.0) + F.substring("event_id", 8, 2).cast("int") / 640.0)
    monkeypatch.setattr(I, "lagged", up)
    monkeypatch.setattr(OE, "floored", lambda spark, sf: up(spark, sf).withColumn("v2", F.lit(1.0)))
    rows = [r for r in QUERIES["evi_04_stable_specificity"](spark, sf).collect() if r.variable == "v2"]
    assert rows and all(r.primary_confirmed for r in rows)
    assert not any(r.floor_confirmed or r.floor_specific or r.stable_spatial_specificity for r in rows)


def test_a_summary_makes_each_table_of_tests_once(spark, sf, monkeypatch):
    made = []
    for name in ("location_tests", "paired_specificity", "front_tests", "proximity_tests"):
        plain = getattr(E, name)
        monkeypatch.setattr(E, name, lambda *a, _p=plain, _n=name, **k: made.append(_n) or _p(*a, **k))
    QUERIES["evi_02_region_summary"](spark, sf)
    assert made == ["location_tests", "paired_specificity"]
