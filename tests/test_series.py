import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.functions import scalar as S
from tidelens.operators import timeseries as ts
from tidelens.sources import series as src

D0 = dt.date(2001, 3, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, day(i), float(v)) for i, v in values], "series_id string, date date, value double")


def test_csv_scan_two_headers_duplicate_and_bad_value(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Year, Month, Day, Extent\nYYYY, MM, DD, 10^6\n2001,03,01, 10.0\n2001,03,02, bad\n2001,03,03, 12.0\n2001,03,03, 99.0\n2001,03,01, 50.0\n2001,03,05, 14.0\n")
    rows = {(r.date, r.value) for r in src.read_series_csv(spark, str(p)).collect()}
    assert rows == {(day(0), 10.0), (day(2), 12.0), (day(4), 14.0)}


def test_csv_scan_named_columns(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("Extent,DATE\n1.5,2001-03-01\nx,2001-03-02\n2.5,2001-03-02\n")
    rows = {(r.date, r.value) for r in src.read_series_csv(spark, str(p)).collect()}
    assert rows == {(day(0), 1.5), (day(1), 2.5)}


def test_event_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(day(0), "m")], "date date, method string")
    path = str(tmp_path / "out")
    src.write_events(df, path)
    assert spark.read.csv(path, header=True).first()["date"] == "2001-03-01"
    with pytest.raises(Exception):
        src.write_events(df, path)


def test_fill_days_linear_and_flat_ends(spark):
    df = spark.createDataFrame([("a", day(0), None), ("a", day(1), 1.0), ("a", day(4), 4.0), ("a", day(5), None)], "series_id string, date date, value double")
    got = [r.value for r in ts.fill_days(df).orderBy("date").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("k,want", [(3, [6, 6, 6, 9, 12, 15, 18, 18]), (2, [3, 3, 5, 7, 9, 11, 13, 13]), (1, [1, 2, 3, 4, 5, 6, 7, 7])])
def test_delta_edges(spark, k, want):
    df = series(spark, enumerate([0, 1, 3, 6, 10, 15, 21, 28]))
    got = [r.delta for r in ts.k_day_delta(df, k).orderBy("date").collect()]
    x = np.array([0, 1, 3, 6, 10, 15, 21, 28], float)
    assert got == [float(v) for v in want]
    assert got[k - 1] == x[k] - x[0]


def test_delta_rejects_other_k(spark):
    with pytest.raises(ValueError):
        ts.k_day_delta(series(spark, [(0, 1)]), 4)


def test_month_edges_and_leap_day(spark):
    days = ["2000-02-28", "2000-02-29", "2000-03-01", "2000-07-30", "2000-07-31", "2000-08-01", "2000-07-29"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    edge = {str(r.d): r.e for r in df.select("d", S.month_edge("d").alias("e")).collect()}
    assert [d for d in days if edge[d]] == ["2000-02-28", "2000-02-29", "2000-03-01", "2000-07-30", "2000-07-31", "2000-08-01"]
    kept = df.filter(S.keep_year_range_without_leap_day("d", 2000, 2000)).count()
    assert kept == 6
    assert df.select(S.season_day("d").alias("s")).filter("s is null").count() == 1


def test_months():
    assert S.month_numbers("djf") == (12, 1, 2) and S.months_label("summer") == "jja" and S.months_label([10, 5, 5]) == "m05-10"
    with pytest.raises(ValueError):
        S.month_numbers("13")


def test_keep_last_of_block(spark):
    rows = [(0, "b"), (0, "m"), (1, "b"), (3, "b"), (4, "m")]
    df = spark.createDataFrame([("a", day(d), m) for d, m in rows], "series_id string, date date, method string")
    got = sorted((r.date, r.method) for r in ts.keep_last_of_block(df, 1).collect())
    assert got == [(day(1), "b"), (day(4), "m")]
    assert ts.keep_last_of_block(df, 0).count() == 5
    assert ts.keep_last_of_block(df, 2).count() == 1


def test_highpass_keeps_fast_and_removes_slow():
    t = np.arange(400)
    inner = slice(80, 320)
    fast, slow = np.sin(2 * np.pi * t / 10), np.sin(2 * np.pi * t / 60)
    assert np.abs(ts.zero_phase(np.full(400, 7.0), 18.0, 12)).max() < 1e-3
    assert np.abs(ts.zero_phase(fast, 18.0, 12) - fast)[inner].max() < 1e-2
    assert np.abs(ts.zero_phase(slow, 18.0, 12))[inner].max() < 1e-2
    with pytest.raises(ValueError):
        ts.zero_phase(np.arange(39.0), 18.0, 12)
    assert ts.zero_phase(np.arange(40.0), 18.0, 12).shape == (40,)


def test_highpass_response_matches_the_design():
    b, a = ts.highpass_coefficients(18.0, 12)
    for period in (9.0, 12.0, 18.0, 24.0, 40.0):
        z = np.exp(2j * np.pi / period)
        gain = abs(np.polyval(b, z) / np.polyval(a, z))
        ratio = np.tan(np.pi / 18.0) / np.tan(np.pi / period)
        assert gain == pytest.approx(1 / np.sqrt(1 + ratio ** 24), rel=1e-4, abs=1e-5)


def test_detect_is_independent_of_partitioning(spark):
    rng = np.random.default_rng(5)
    df = series(spark, enumerate(rng.normal(size=800))).unionByName(series(spark, enumerate(rng.normal(size=800)), "b"))
    st = ts.DetectionSettings(first_year=2001, last_year=2003, climatology_first=2001, climatology_last=2003, percentile=10.0)
    key = lambda d: sorted((r.series_id, r.date, r.method, round(r.event_value, 9)) for r in d.collect())
    one = key(ts.detect(df, st))
    two = key(ts.detect(df.repartition(13).orderBy(F.rand(3)), st))
    assert one == two and one
