import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.operators import pressure as P, tracking as T

D0 = dt.date(2001, 6, 1)


def km(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def patches(spark, n, seed, spread=20.0, days=9, regions=2):
    r = np.random.default_rng(seed)
    rows = [(f"O{i:04d}", f"g{int(r.integers(regions))}", D0 + dt.timedelta(int(r.integers(days))), float(r.uniform(-180, -180 + spread)) if i % 2 else float(r.uniform(180 - spread, 180)), float(r.uniform(70, 80)), float(r.integers(1, 6))) for i in range(n)]
    df = spark.createDataFrame(rows, "object_id string, region string, date date, centroid_lon double, centroid_lat double, cumulative_sic_loss double")
    return rows, df


def track_brute(rows, days, reach):
    out, number = {}, 0
    for g in sorted({r[1] for r in rows}):
        live = []
        for o, _, d, lon, lat, loss in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], -r[5], r[0])):
            live = [e for e in live if (d - e["d"]).days <= days]
            near = [(km(lon, lat, e["lon"], e["lat"]), k) for k, e in enumerate(live)]
            near = [v for v in near if v[0] <= reach]
            if near:
                e = live[min(near)[1]]
            else:
                number += 1
                e = {"id": f"ULE{number:06d}"}
                live.append(e)
            e.update(d=d, lon=lon, lat=lat)
            out[o] = e["id"]
    return out


@pytest.mark.parametrize("n,seed,spread,blocks", [(80, 1, 20.0, False), (80, 1, 20.0, True), (150, 2, 60.0, False), (150, 2, 60.0, True), (60, 3, 5.0, True)])
def test_patch_tracking_equals_plain_loop(spark, n, seed, spread, blocks):
    rows, df = patches(spark, n, seed, spread)
    got = {r.object_id: r.unique_local_event_id for r in T.track_patches(df, blocks=blocks).collect()}
    assert got == track_brute(rows, 2, 300.0)
    again = {r.object_id: r.unique_local_event_id for r in T.track_patches(df.repartition(7), blocks=blocks).collect()}
    assert again == got


def test_quiet_gap_splits_and_same_day_chains(spark):
    rows = [("a", "g", D0, 0.0, 75.0, 5.0), ("b", "g", D0, 1.0, 75.0, 4.0), ("c", "g", D0 + dt.timedelta(2), 1.0, 75.0, 1.0), ("d", "g", D0 + dt.timedelta(5), 1.0, 75.0, 1.0)]
    df = spark.createDataFrame(rows, "object_id string, region string, date date, centroid_lon double, centroid_lat double, cumulative_sic_loss double")
    got = {r.object_id: r.unique_local_event_id for r in T.track_patches(df).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]


def cluster_brute(rows, adj, gap, reach):
    live, done, n, out = [], [], 0, {}
    for eid, reg, d, lon, lat, loss in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        live = [c for c in live if (d - c["d"]).days <= gap]
        best, bd = None, float("inf")
        for c in live:
            if not (c["reg"] == reg or reg in adj.get(c["reg"], ())):
                continue
            k = km(c["lon"], c["lat"], lon, lat)
            if k <= reach and k < bd:
                best, bd = c, k
        if best is None:
            n += 1
            best = {"id": f"CL{n:05d}", "reg": reg, "m": []}
            live.append(best)
        best["m"].append((lon, lat, max(loss, 1.0)))
        w = sum(m[2] for m in best["m"])
        best.update(d=d, lon=sum(m[0] * m[2] for m in best["m"]) / w, lat=sum(m[1] * m[2] for m in best["m"]) / w)
        out[eid] = best["id"]
    return out


def test_clusters_equal_plain_loop_for_every_setting(spark):
    r = np.random.default_rng(8)
    rows = [(f"E{i:03d}", f"R{int(r.integers(3))}", D0 + dt.timedelta(int(r.integers(60))), float(r.uniform(0, 40)), float(r.uniform(70, 80)), float(r.uniform(0, 9))) for i in range(120)]
    df = spark.createDataFrame([(*x, x[2], x[2]) for x in rows], "unique_local_event_id string, dominant_region string, event_start date, track_centroid_lon double, track_centroid_lat double, cumulative_loss double, a date, b date").drop("a", "b")
    adj = {"R0": ("R1",), "R1": ("R0",)}
    settings = [(5, 500.0), (3, 300.0), (2, 700.0)]
    got = T.cluster_events(df, adj, settings).collect()
    for g, d in settings:
        mine = {x.unique_local_event_id: x.cluster_id for x in got if x.gap_days == g and x.distance_km == d}
        assert mine == cluster_brute(rows, adj, g, d)


def test_cluster_roll_up_peak_and_dominant_region(spark):
    d = dt.date
    rows = [("E1", "R0", d(2001, 6, 1), d(2001, 6, 3), 2.0, 10.0, 5.0, 0.0, 75.0), ("E2", "R1", d(2001, 6, 2), d(2001, 6, 2), 2.0, 20.0, 6.0, 1.0, 75.0), ("E3", "R1", d(2001, 6, 3), d(2001, 6, 6), 0.5, 5.0, 1.0, 1.0, 75.0)]
    df = spark.createDataFrame(rows, "unique_local_event_id string, dominant_region string, event_start date, event_end date, cumulative_loss double, max_area_km2 double, max_intensity double, track_centroid_lon double, track_centroid_lat double")
    df = df.withColumn("overlap_with_series_event", F.lit(False)).withColumn("overlap_with_regional_event_v1", F.col("unique_local_event_id") == "E3")
    c = T.cluster_roll_up(T.cluster_events(df, {"R0": ("R1",)}), ["R0", "R1"]).collect()
    assert len(c) == 1
    c = c[0]
    assert c.representative_event_id == "E1" and c.dominant_region == "R1" and c.tie_break == "unique_maximum"
    assert str(c.peak_intensity_date) == "2001-06-02" and c.duration_days == 6 and c.member_event_count == 3 and c.matches_regional and not c.matches_panarctic
    assert c.loss_dominant_region_fraction == pytest.approx(2.5 / 4.5)
    assert c.centroid_lon == pytest.approx((2 * 0 + 2 * 1 + 1 * 1) / 5)
    members = T.cluster_member_lists(T.cluster_events(df, {"R0": ("R1",)}), chunk=2).orderBy("part").collect()
    assert [m.member_event_ids for m in members] == [["E1", "E2"], ["E3"]]


def link_brute(rows, reach, least):
    live, used, n, out = {}, set(), 0, []
    for d in sorted({r[0] for r in rows}):
        used = set()
        for r in sorted((x for x in rows if x[0] == d), key=lambda x: (x[3], x[4], x[5])):
            best, bd = None, float("inf")
            for t, (e, lat, lon) in live.items():
                if t in used or (d - e).days != 1:
                    continue
                k = km(r[2], r[1], lon, lat)
                if k < bd and k <= reach:
                    best, bd = t, k
            if best is None:
                n += 1
                best = n
            else:
                used.add(best)
            live[best] = (d, r[1], r[2])
            if best == n and bd == float("inf"):
                used.add(best)
            out.append((best, r))
        live = {t: v for t, v in live.items() if v[0] == d}
    size = {}
    for t, r in out:
        size.setdefault(t, set()).add(r[0])
    keep = sorted(t for t in size if len(size[t]) >= least)
    return {(r[0], r[4], r[5]): keep.index(t) + 1 for t, r in out if t in keep}


def test_tracks_equal_plain_loop(spark):
    g = np.random.default_rng(4)
    rows = []
    for k in range(14):
        if k in (5, 6):
            continue
        for _ in range(int(g.integers(1, 6))):
            rows.append((D0 + dt.timedelta(k), float(g.uniform(60, 80)), float(g.uniform(0, 60)), float(g.integers(960, 1000)), int(g.integers(50)), int(g.integers(50))))
    df = spark.createDataFrame([(*r, 5.0) for r in rows], "date date, lat double, lon double, center_pressure_hpa double, i int, j int, depth_hpa double")
    got = {(r.date, r.i, r.j): r.track_id for r in T.link_tracks(df, 1000.0).collect()}
    assert got == link_brute(rows, 1000.0, 2)


def test_thinning_is_lowest_first(spark):
    rows = [(D0, 1, 1, 70.0, 0.0, 980.0, 1.0), (D0, 2, 2, 70.5, 0.0, 975.0, 1.0), (D0, 3, 3, 80.0, 90.0, 990.0, 1.0), (D0, 4, 4, 60.0, -90.0, 995.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, i int, j int, lat double, lon double, center_pressure_hpa double, depth_hpa double")
    assert sorted(r.i for r in P.thin(df, 500.0, 9).collect()) == [2, 3, 4]
    assert sorted(r.i for r in P.thin(df, 500.0, 2).collect()) == [2, 3]


def test_units_never_split_close_rows(spark):
    rows, df = patches(spark, 120, 9, 180.0, 6, 1)
    u = {r.object_id: r.unit for r in T.proximity_units(df, ["region"], "date", "centroid_lon", "centroid_lat", 2, 300.0).collect()}
    for a in rows:
        for b in rows:
            if abs((a[2] - b[2]).days) <= 2 and km(a[3], a[4], b[3], b[4]) <= 300:
                assert u[a[0]] == u[b[0]]
    assert len(set(u.values())) > 1


def thin_brute(rows, least, most):
    out = set()
    for d in {r[0] for r in rows}:
        kept = []
        for r in sorted((x for x in rows if x[0] == d), key=lambda x: (x[5], x[1], x[2])):
            if len(kept) < most and all(km(r[4], r[3], k[4], k[3]) >= least for k in kept):
                kept.append(r)
        out |= {(r[0], r[1], r[2]) for r in kept}
    return out


def test_thinning_equals_plain_loop_in_few_rounds(spark):
    g = np.random.default_rng(6)
    rows = [(D0 + dt.timedelta(int(g.integers(4))), n, n % 7, float(g.uniform(55, 89)), float(g.uniform(-180, 180)), float(g.integers(960, 970)), 1.0) for n in range(160)]
    df = spark.createDataFrame(rows, "date date, i int, j int, lat double, lon double, center_pressure_hpa double, depth_hpa double")
    for least, most in ((800.0, 99), (1500.0, 3)):
        out = P.thin(df, least, most)
        assert {(r.date, r.i, r.j) for r in out.collect()} == thin_brute(rows, least, most) and out.columns == df.columns
        assert "InPandas" not in out._jdf.queryExecution().toString()


def test_links_of_many_equal_distances_follow_the_first_opened(spark):
    """Places on a coarse lattice: most choices are between candidates at exactly equal distance."""
    g = np.random.default_rng(12)
    rows = [(f"O{i:04d}", "g", D0 + dt.timedelta(int(g.integers(8))), float(g.integers(0, 12)) * 4, 75.0 + float(g.integers(2)), float(g.integers(1, 4))) for i in range(220)]
    df = spark.createDataFrame(rows, "object_id string, region string, date date, centroid_lon double, centroid_lat double, cumulative_sic_loss double")
    for blocks in (True, False):
        assert {r.object_id: r.unique_local_event_id for r in T.track_patches(df, blocks=blocks).collect()} == track_brute(rows, 2, 300.0)


def test_chains_have_their_heads(spark):
    from tidelens.operators import graph

    links = [(n, n - 1) for n in range(2, 300)] + [(n, n - 7) for n in range(1007, 1100)]
    out = {r.n: r.head for r in graph.chain_heads(spark.createDataFrame(links, "n long, up long"), "n", "up").collect()}
    assert out == {**{n: 1 for n in range(2, 300)}, **{n: 1000 + (n - 1000) % 7 for n in range(1007, 1100)}}


def test_edges_of_a_hub_are_not_shuffled_to_one_task(spark):
    from tidelens.operators import graph

    star = spark.range(1, 20_001).select(F.lit(50_000).cast("long").alias("u"), F.col("id").alias("v"))
    ends = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    both = graph._with_lowest(ends.repartition(8, "v"), low, ["u"], 40_000)
    assert both.count() == 40_000 and both.filter("u = 50000 and m = 1").count() == 20_000
    sizes = [r["n"] for r in both.filter("u = 50000").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 20_000 / 2
    assert {r.root for r in graph.components(star, "u", "v").collect()} == {1}


def test_linked_rows_are_stored_before_their_openings_are_numbered(spark):
    """The sequential rule of a unit runs once, not again for every reader of its result."""
    rows, df = patches(spark, 40, 5, 60.0, 6, 2)
    e = spark.createDataFrame([(f"E{i:02d}", "R0", D0 + dt.timedelta(i % 7), 5.0 * i, 70.0, 1.0) for i in range(20)],
                              "unique_local_event_id string, dominant_region string, event_start date, track_centroid_lon double, track_centroid_lat double, cumulative_loss double")
    for out in (T.track_patches(df), T.cluster_events(e, {"R0": ()})):
        assert "MapInArrow" not in out._jdf.queryExecution().toString()
