import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.functions import geometry as G, scalar as S
from tidelens.operators import budget as B, graph, raster as RA


def flood(mask, eight):
    seen, comps = np.zeros(mask.shape, bool), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (eight or a == 0 or b == 0)]
    for y, x in zip(*np.where(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            p = stack.pop()
            cells.append(p)
            for a, b in steps:
                q = (p[0] + a, p[1] + b)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not seen[q]:
                    seen[q] = True
                    stack.append(q)
        comps.append(sorted(cells))
    return comps


def cells_of(spark, mask):
    return spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.where(mask))], "f int, y int, x int")


@pytest.mark.parametrize("eight,density,tile", [(True, 0.35, 5), (True, 0.5, 4), (False, 0.55, 6), (True, 0.4, 128)])
def test_labels_equal_flood_fill_across_tiles(spark, eight, density, tile):
    mask = np.random.default_rng(int(density * 100) + tile).random((23, 27)) < density
    lab = RA.label(cells_of(spark, mask), ["f"], 8 if eight else 4, tile=tile)
    got = {}
    for r in lab.collect():
        got.setdefault(r.component, []).append((r.y, r.x))
    want = flood(mask, eight)
    assert sorted(sorted(v) for v in got.values()) == sorted([tuple(map(int, c)) for c in comp] for comp in want)
    for first, cells in got.items():
        y, x = min(cells)
        assert first == y * 2**32 + x
    numbers = {r.component: r.label_id for r in RA.raster_numbers(lab, ["f"]).collect()}
    assert [numbers[k] for k in sorted(numbers)] == list(range(1, len(want) + 1))


def test_corner_touch_and_size_rules(spark):
    m = np.zeros((5, 6), bool)
    m[0, 0] = m[1, 1] = m[0, 1] = True          # border blob joined by a corner
    m[2, 2] = True                              # corner contact to the blob above
    m[4, 3] = m[4, 4] = m[4, 5] = True          # three cells on the border
    c8, c4 = (RA.label(cells_of(spark, m), ["f"], k) for k in (8, 4))
    assert RA.raster_numbers(c8, ["f"], 3).count() == 2 and RA.raster_numbers(c8, ["f"], 3, strict=True).count() == 1
    assert RA.raster_numbers(c4, ["f"]).count() == 3


def test_closing_fills_hole_and_erodes_border(spark):
    m = np.zeros((7, 7), bool)
    m[2:5, 2:5] = True
    m[3, 3] = False
    m[0, 6] = True
    valid = spark.createDataFrame([(1, y, x) for y in range(7) for x in range(7)], "f int, y int, x int")
    got = {(r.y, r.x) for r in RA.closed_mask(cells_of(spark, m), valid, ["f"]).collect()}
    assert got == {(y, x) for y in range(2, 5) for x in range(2, 5)}


def test_components_of_a_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    e = spark.createDataFrame(path + star, "a long, b long")
    roots = {r.node: r.root for r in graph.components(e, "a", "b").collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 201 + 60


def test_minima_ring_gradient_against_arrays(spark):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 500, (14, 15)).astype(float)
    rows = [(1, y, x, float(f[y, x]), float(x * 10.0), float(y * -5.0)) for y in range(14) for x in range(15)]
    df = spark.createDataFrame(rows, "f int, y int, x int, v double, x_m double, y_m double")
    want = {(y, x) for y in range(1, 13) for x in range(1, 14) if f[y, x] < min(f[y + a, x + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))}
    assert {(r.y, r.x) for r in RA.strict_minima(df, ["f"], "v").collect()} == want
    hole = df.filter("not (y = 5 and x = 5)")
    assert all(max(abs(r.y - 5), abs(r.x - 5)) > 1 for r in RA.strict_minima(hole, ["f"], "v").collect())
    gy, gx = np.gradient(f, np.arange(14) * -5.0, np.arange(15) * 10.0)
    for r in RA.gradient(df, ["f"], "v").collect():
        assert r.grad_y == pytest.approx(gy[r.y, r.x]) and r.grad_x == pytest.approx(gx[r.y, r.x])
    ring = {(r.y, r.x): r.ring_mean for r in RA.ring_mean(df, df, ["f"], "v", 2).collect()}
    assert ring[(0, 0)] == pytest.approx(np.mean([f[2, 0], f[0, 2], f[2, 2]]))
    assert ring[(7, 7)] == pytest.approx(np.mean([f[7 + a, 7 + b] for a in (-2, 0, 2) for b in (-2, 0, 2) if (a, b) != (0, 0)]))


def gap_brute(values):
    v = np.unique(np.asarray(values) % 360.0)
    if v.size == 1:
        return 360.0, v[0], 1
    g = np.diff(np.r_[v, v[0] + 360])
    tied = np.flatnonzero(np.abs(g - g.max()) <= 1e-12)
    return g.max(), min(v[(t + 1) % v.size] for t in tied), tied.size


@pytest.mark.parametrize("lons", [[170, -170], [0, 120, 240], [10, 20], [5], [0, 90, 180, 270], [350, 10, 30, -20, 179]])
def test_circular_gaps(spark, lons):
    df = spark.createDataFrame([(1, float(v)) for v in lons], "k int, lon double")
    r = RA.circular_gaps(df, ["k"]).first()
    gap, start, ties = gap_brute(lons)
    assert (r.largest_gap_deg, r.arc_start_deg, r.tie_count) == (pytest.approx(gap), pytest.approx(start), ties)
    arc = 360 - gap
    want = "LONGITUDE_DISTRIBUTED" if arc > 180 else "WRAP_ONLY" if max(lons) - min(lons) > 180 else "ORDINARY"
    assert r.geometry_class == want


def test_centroid_rules(spark):
    rows = [("wrap", 170.0, 70.0, 1.0, 0.0, 0.0), ("wrap", -170.0, 80.0, 3.0, 0.0, 0.0), ("plain", 10.0, 60.0, 0.0, 0.0, 0.0), ("plain", 20.0, 62.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, lon double, lat double, w double, x_m double, y_m double")
    got = {r.k: r for r in RA.weighted_centroid(df, ["k"], "w").collect()}
    assert got["wrap"].centroid_lon == pytest.approx(-175.0) and got["wrap"].centroid_lat == pytest.approx(77.5)
    assert got["plain"].centroid_lon == pytest.approx(15.0) and got["plain"].centroid_lat == pytest.approx(61.0)
    wide = spark.createDataFrame([("d", float(l), 80.0, 1.0) for l in (0, 120, 240)], "k string, lon double, lat double, w double")
    with pytest.raises(Exception):
        RA.weighted_centroid(wide, ["k"], "w", x_m=None, y_m=None, distributed="error").collect()


def test_projection_round_trip_and_scale(spark):
    pts = spark.createDataFrame([(float(lo), float(la)) for lo in range(-180, 180, 37) for la in (40, 60, 70, 85, 89)], "lon double, lat double")
    x, y = G.stereographic_forward("lon", "lat")
    lon, lat = G.stereographic_inverse("x", "y")
    for r in pts.withColumn("x", x).withColumn("y", y).withColumn("lo", lon).withColumn("la", lat).collect():
        assert r.la == pytest.approx(r.lat, abs=1e-8)
        assert (r.lo - r.lon + 180) % 360 - 180 == pytest.approx(0, abs=1e-8)
    # true scale at 70 degrees: one degree of longitude keeps its length on the ellipsoid
    a, b = 6378273.0, 6356889.449
    e2 = 1 - (b / a) ** 2
    want = np.radians(1) * a * np.cos(np.radians(70)) / np.sqrt(1 - e2 * np.sin(np.radians(70)) ** 2)
    two = spark.createDataFrame([(0.0, 70.0), (1.0, 70.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert np.hypot(two[0].x - two[1].x, two[0].y - two[1].y) == pytest.approx(want, rel=2e-5)


def test_geodesic_known_lengths():
    assert G.geodesic_metres([0], [0], [1], [0])[0] == pytest.approx(111319.4908, abs=1e-3)
    assert G.geodesic_metres([0], [0], [0], [90])[0] == pytest.approx(10001965.7293, abs=1e-2)
    assert G.geodesic_metres([12], [70], [12], [70])[0] == pytest.approx(0, abs=1e-9)
    # polar pair against a numerically integrated meridian arc
    lat = np.radians(np.linspace(80, 90, 200001))
    e2 = (2 - 1 / 298.257223563) / 298.257223563
    m = 6378137.0 * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    arc = np.sum((m[1:] + m[:-1]) / 2 * np.diff(lat))
    assert G.geodesic_metres([30], [80], [30], [90])[0] == pytest.approx(arc, abs=0.01)


def test_perimeter_and_box(spark):
    m = np.zeros((4, 4), bool)
    m[1:3, 1:3] = True
    assert RA.perimeter_edges(cells_of(spark, m), ["f"]).count() == 8
    pts = spark.createDataFrame([(170.0, 60.0), (-170.0, 60.0), (0.0, 60.0), (160.0, 60.0), (-160.0, 70.0)], "lon double, lat double")
    got = [r.i for r in pts.select(S.in_box("lon", "lat", 160, -160, 55, 67).alias("i")).collect()]
    assert got == [True, True, False, True, False]


def test_class_partition_and_budget_closure(spark):
    d = dt.date(1995, 1, 6)
    grid = spark.createDataFrame([(y, x, float(1 + y * 6 + x), 1 + (x > 2)) for y in range(6) for x in range(6)], "y int, x int, area_km2 double, region_code int")
    field = spark.createDataFrame([(d + dt.timedelta(days=k), y, x, 0.75 if k == -5 else (0.25 if (x + y) % 2 else 1.0)) for k in (-5, 0) for y in range(6) for x in range(6)], "date date, y int, x int, value double")
    cells = B.change_cells(field, grid, 5)
    members = spark.createDataFrame([("A", "o1", d, d - dt.timedelta(3), 1), ("B", "o2", d, d - dt.timedelta(3), 3), ("C", "o3", d + dt.timedelta(1), d, 3)], "unique_local_event_id string, object_id string, date date, start_date date, level int")
    pc = spark.createDataFrame([("o1", y, x) for y in range(3) for x in range(3)] + [("o2", y, x) for y in range(2, 4) for x in range(2, 4)] + [("o3", 5, 5)], "object_id string, y int, x int")
    dates = spark.createDataFrame([(d,)], "date date")
    k = B.class_cells(dates, members, pc, "cdr")
    got = {(r.y, r.x): r["class"] for r in k.collect()}
    assert got[(2, 2)] == 3 and got[(0, 0)] == 1 and (5, 5) not in got and len(got) == 12
    assert (5, 5) in {(r.y, r.x) for r in B.class_cells(dates, members, pc, "detector").collect()}
    b = B.class_budget(cells, k, F.col("loss") * F.col("area_km2"), F.col("gain") * F.col("area_km2")).first()
    area = {(y, x): 1.0 + y * 6 + x for y in range(6) for x in range(6)}
    total = sum(0.5 * a for (y, x), a in area.items() if (x + y) % 2)
    assert b.gross_loss == total and b.loss_closure_error == 0 and b.closure_status == "PASS"
    assert b.loss_major_severe == sum(0.5 * area[c] for c in got if got[c] == 3 and sum(c) % 2)


def test_composition_values(spark):
    df = spark.createDataFrame([("a", v) for v in (8.0, 4.0, 2.0, 2.0, 0.0, None)] + [("b", 0.0)], "k string, v double")
    rows = {r.k: r for r in B.composition(df, ["k"], "v").collect()}
    assert set(rows) == {"a"}
    assert rows["a"].effective_number == pytest.approx(256 / 88) and rows["a"].largest_share == 0.5 and rows["a"].top_share == 0.875


def test_closing_of_words_equals_closing_of_cells_on_random_masks(spark):
    """Words of columns meet their neighbours at both sides, and cells outside the bounds count as unset."""
    g = np.random.default_rng(21)
    w = RA.WORD
    cells = {(k, int(y), int(x)) for k, share in ((0, 0.3), (1, 0.6), (2, 0.97)) for y, x in np.argwhere(g.random((7, 2 * w + 5)) < share)}
    ny, nx = 7, 2 * w + 5
    near = lambda y, x: [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    grown = {(k, a, b) for k, y, x in cells for a, b in near(y, x) if 0 <= a < ny and 0 <= b < nx}
    want = {(k, y, x) for k, y, x in grown if all((k, a, b) in grown for a, b in near(y, x))}
    mask = spark.createDataFrame(sorted(cells), "k int, y int, x int")
    valid = spark.createDataFrame([(k, y, x) for k in range(3) for y in range(ny) for x in range(nx)], "k int, y int, x int")
    out = RA.closed_mask(mask, valid, ["k"])
    assert {(r.k, r.y, r.x) for r in out.collect()} == want
    assert "inline" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_tiles_are_dealt_over_more_tasks_than_a_plain_shuffle(spark):
    df = spark.createDataFrame([(k, y, x, float(k * y + x)) for k in range(40) for y in range(3) for x in range(3)], "k int, y int, x int, value double")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert RA.with_halo(df, ["k"], 1).select(F.spark_partition_id().alias("p")).distinct().count() > width
