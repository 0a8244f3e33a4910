import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidelens.operators import budget as B


def day(n):
    return dt.date(1995, 1, 1) + dt.timedelta(days=n)


def inputs(spark):
    r = np.random.default_rng(4)
    grid = spark.createDataFrame([(y, x, 500.0 + 7 * y + x) for y in range(-9, 20) for x in range(-3, 30)], "y int, x int, area_km2 double")
    cells = [(day(d), y, x, float(r.integers(0, 9)) / 8, float(r.integers(0, 9)) / 8) for d in (10, 11) for y in range(-9, 20) for x in range(-3, 30) if r.random() < 0.6]
    cells = spark.createDataFrame(cells, "date date, y int, x int, loss double, gain double").join(grid, ["y", "x"])
    member, patch = [], []
    for k in range(60):
        d = int(r.integers(3, 14))
        member.append((f"E{k % 7}", f"O{k}", day(d), day(d - int(r.integers(-1, 4))), 1 + k % 3))
        y0, x0 = (int(v) for v in r.integers(-12, 28, 2))
        patch += [(f"O{k}", y0 + i // 4, x0 + i % 4) for i in range(int(r.integers(1, 20)))]
    member = spark.createDataFrame([*member, ("E6", "O3", day(9), day(9), 2)], "unique_local_event_id string, object_id string, date date, start_date date, level int")
    dates = spark.createDataFrame([(day(d),) for d in (8, 10, 11, 40)], "date date")
    return grid, cells, member, spark.createDataFrame(patch, "object_id string, y int, x int"), dates


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def test_masks_give_the_same_footprints_as_cells(spark):
    grid, cells, member, patch, dates = inputs(spark)
    for track in ("cdr", "detector"):
        plain = B.footprints(dates, member, patch, track)
        tiles = B.footprint_tiles(dates, member, patch, track)
        assert tiles.agg(F.sum(F.bit_count("_mask"))).first()[0] == plain.count() > 0
        want = rows(B.footprint_sums(plain, cells, grid, ["date", "unique_local_event_id"]))
        assert want and rows(B.tile_sums(tiles, cells, grid, dates)) == want
        parts = cells.filter("loss > 0.5").withColumn("component", (F.col("x").cast("bigint") + 3) % 5)
        want = rows(B.footprint_components(plain, parts, None, grid))
        assert want and rows(B.tile_components(tiles, parts, grid, dates)) == want


def test_cells_of_footprints_are_not_exchanged(spark, sf):
    for name in ("agg_26_event_footprints", "joi_22_agg_27_footprint_components"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "bit_or" in plan


def test_start_diagnostics_from_counts(spark):
    r = np.random.default_rng(5)
    rows = [(f"E{int(r.integers(0, 4))}", None if r.random() < 0.2 else float(r.integers(0, 16)) / 32, float(r.integers(1, 9)) / 4) for _ in range(200)] + [("E9", None, 1.0)]
    got = {x.e: x for x in B.start_diagnostics(spark.createDataFrame(rows, "e string, start_value double, w double"), ["e"]).collect()}
    for e in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == e]
        seen = [x for x in mine if x[1] is not None]
        assert got[e].observations == len(mine)
        if not seen:
            assert got[e].median is None and got[e].total_loss == 0 and got[e]["cell_fraction_lt_0.15"] is None
            continue
        v, w = np.array([x[1] for x in seen]), np.array([x[2] for x in seen])
        assert np.allclose([got[e][c] for c in ("p10", "q25", "median", "q75", "p90")], np.quantile(v, [0.1, 0.25, 0.5, 0.75, 0.9]))
        assert np.isclose(got[e].weighted_mean_start, (v * w).sum() / sum(x[2] for x in mine))
        assert np.isclose(got[e]["cell_fraction_lt_0.15"], (v < 0.15).mean()) and np.isclose(got[e]["loss_fraction_ge_0.30"], w[v >= 0.3].sum() / w.sum())
