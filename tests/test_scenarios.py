"""Floor scenarios: no scenario sees another's rows, gates can fail, composition closes."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidelens.operators import scenario as SC, severity as SV

D0 = dt.date(2001, 6, 10)


def field_of(spark, seed=5, n=14, days=4):
    r = np.random.default_rng(seed)
    rows, grid = [], []
    for y in range(n):
        for x in range(n):
            grid.append((y, x, x * 25e3, -y * 25e3, float(x), 70.0 + y / 2, 625.0, 1 + (x // 7)))
            for d in range(days):
                start = float(r.random())
                delta = float(r.uniform(-0.6, 0.2))
                rows.append((D0 + dt.timedelta(d), y, x, start, delta, max(-delta, 0.0), 625.0, 1 + (x // 7)))
    g = spark.createDataFrame(grid, "y int, x int, x_m double, y_m double, lon double, lat double, area_km2 double, region_code int")
    c = spark.createDataFrame(rows, "date date, y int, x int, start_value double, delta double, loss double, area_km2 double, region_code int")
    return rows, g, c


def plain_patches(rows, floor, threshold, least):
    out = set()
    for d in {r[0] for r in rows}:
        left = {(r[1], r[2]): -r[4] for r in rows if r[0] == d and r[4] <= threshold and (floor is None or r[3] >= floor)}
        while left:
            todo, mine = [left and min(left)], {}
            while todo:
                c = todo.pop()
                if c in left:
                    mine[c] = left.pop(c)
                    todo += [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            if len(mine) >= least:
                out.add((d, len(mine), round(sum(mine.values()), 9)))
    return out


def catalogue(spark, floors):
    rows, g, c = field_of(spark)
    cells = SC.floor_cells(c, g, -0.3, floors, 3)
    return rows, c, cells, SC.floor_patches(cells, 5, -0.3)


def test_patches_of_every_floor_equal_plain_flood_fill(spark):
    floors = (None, 0.3, 0.6)
    rows, _, _, p = catalogue(spark, floors)
    got = p.collect()
    for name, floor in (("none", None), ("0.3", 0.3), ("0.6", 0.6)):
        mine = [r for r in got if r.scenario == name]
        assert {(r.date, r.object_area_cells, round(r.cumulative_sic_loss, 9)) for r in mine} == plain_patches(rows, floor, -0.3, 3)
        assert sorted(r.object_id for r in mine) == [f"ROB_{name}_{i + 1:08d}" for i in range(len(mine))]


def test_a_scenario_gives_the_same_alone_and_beside_others(spark):
    def result(floors):
        _, _, _, p = catalogue(spark, floors)
        _, events, major = SC.floor_catalogues(p, min_cells=4)
        t = SC.tiers(events, major).filter("scenario = '0.3'")
        return sorted((r.dominant_region, r.event_start, r.n_daily_patches, round(r.cumulative_loss, 9), r.level, r.major_definition or "") for r in t.collect())

    assert result((None, 0.3, 0.6)) == result((0.3,))


def test_marks_by_catalogue_equal_marks_of_each(spark):
    r = np.random.default_rng(3)
    rows = [(s, f"E{i}", f"R{i % 3}", float(r.gamma(2) * scale), int(r.integers(50, 400)), float(r.integers(100, 900)), float(r.random()), int(r.integers(1, 5)), -0.2) for s, scale in (("a", 1), ("b", 50)) for i in range(90)]
    df = spark.createDataFrame(rows, "scenario string, unique_local_event_id string, dominant_region string, cumulative_loss double, max_area_cells int, max_area_km2 double, max_intensity double, duration_days int, sic_change_threshold double")

    def of(t, by):
        marked = SV.mark_severe(t, by=by)
        major, counts = SV.select_major(marked.filter("is_severe_primary"), by)
        n = {(r.scenario if by else None, r.family, r.threshold): r.event_count for r in counts.collect()}
        return {(r.scenario, r.unique_local_event_id) for r in marked.filter("is_severe_primary").collect()}, {(r.scenario, r.unique_local_event_id, r.major_definition) for r in major.collect()}, n

    both = of(df, ["scenario"])
    for s in ("a", "b"):
        alone = of(df.filter(F.col("scenario") == s), [])
        assert {x for x in both[0] if x[0] == s} == alone[0] and {x for x in both[1] if x[0] == s} == alone[1]
        assert {(f, t): n for (k, f, t), n in both[2].items() if k == s} == {(f, t): n for (_, f, t), n in alone[2].items()}


def test_nesting_gate_can_fail(spark):
    events = spark.createDataFrame([("s", "E1", True), ("s", "E2", False)], "scenario string, unique_local_event_id string, is_severe_primary boolean")
    bad = spark.createDataFrame([("s", "E2")], "scenario string, unique_local_event_id string")
    gates = {r.gate: r.holds for r in SC.nesting_gates(events, bad).collect()}
    assert gates == {"severe_subset_broad": True, "major_subset_severe": False}


def test_composition_closes_and_overlap_is_bounded(spark):
    floors = (None, 0.3)
    _, change, cells, p = catalogue(spark, floors)
    linked, events, major = SC.floor_catalogues(p, min_cells=4)
    prints = SC.event_footprints(linked, cells, cells.select("date"), 2)
    late = prints.join(linked.groupBy("scenario", "unique_local_event_id").agg(F.min("date").alias("_first")), ["scenario", "unique_local_event_id"]).filter("date < _first")
    assert late.count() == 0  # nothing that starts after the date counts
    b = SC.class_composition(prints, SC.tiers(events, major), change, floors).collect()
    assert len(b) == 8 and all(r.closure_status == "PASS" and abs(r.loss_fraction_residual + r.loss_fraction_broad_only + r.loss_fraction_severe_only + r.loss_fraction_major_severe - 1) < 1e-9 for r in b)
    pairs = SC.overlap_pairs(prints, cells, change.select("date", "y", "x", "area_km2", (F.col("loss") * F.col("area_km2")).alias("lw")))
    assert pairs.count() > 0 and pairs.filter("iou <= 0 or iou > 1 or local_capture > 1 or component_capture > 1").count() == 0
