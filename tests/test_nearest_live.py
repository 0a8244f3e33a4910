"""Equally far objects: the first opened is taken, whatever the last bits of a distance formula say."""

import datetime as dt
import random

import duckdb

from tidelens.operators import tracking as T
from tidelens.plans.walks import km

D0 = dt.date(2001, 6, 1)


def test_patch_between_two_events_joins_the_first_opened(spark):
    rows = []
    for i in range(100):
        lat = 60.0 + i / 4
        for name, there, loss in (("a", lat - 1.5, 3.0), ("b", lat + 1.5, 2.0), ("p", lat, 1.0)):
            rows.append((f"{name}{i:03d}", f"g{i:03d}", D0, 10.0, there, loss))
    df = spark.createDataFrame(rows, "object_id string, region string, date date, centroid_lon double, centroid_lat double, cumulative_sic_loss double")
    got = {r.object_id: r.opener for r in T.track_patches(df).collect()}
    assert [i for i in range(100) if got[f"p{i:03d}"] != f"a{i:03d}"] == []


def test_nearest_equals_sql_over_many_places():
    random.seed(5)
    place = lambda: (random.randrange(-360, 360) / 2, random.randrange(240, 360) / 4)
    con = duckdb.connect()
    for size in (3, 70, 300):
        live = T._Live()
        for i in range(size):
            live.open(i, 0, *((None, None) if i == 1 else place()), i % 3)
        asks = [place() for _ in range(40)]
        objects = [{"i": i, "lon": x, "lat": y} for i, (x, y) in enumerate(live.places) if x is not None]
        for lon, lat in asks:
            for allowed in (None, T.np.array([True, False, True])):
                some = [o for o in objects if allowed is None or allowed[o["i"] % 3]]
                con.execute("CREATE OR REPLACE TABLE o AS SELECT unnest($1::STRUCT(i INTEGER, lon DOUBLE, lat DOUBLE)[], recursive := true)", [some])
                d = con.execute(f"SELECT i, {km('lon', 'lat', f'{lon}::DOUBLE', f'{lat}::DOUBLE')} AS d FROM o ORDER BY d, i LIMIT 1").fetchall()
                want = d[0][0] if d and d[0][1] <= 500.0 else None
                assert live.nearest(lon, lat, 500.0, allowed) == want


def test_dropped_objects_leave_the_order_of_the_others():
    live = T._Live()
    for i in range(200):
        live.open(i, i % 4, float(i), 70.0)
    stay = live.drop_before(2)
    assert live.ids == [i for i in range(200) if i % 4 >= 2] and stay == [i % 4 >= 2 for i in range(200)]
    assert set(live.days) == {2, 3} and live.ids[live.nearest(7.0, 70.0, 10.0)] == 7
