"""Front queries: RAS-10, RAS-11, TOP-04."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import front as FR
from . import inputs as I
from .registry import query

R = S.rounded
SETTINGS = FR.FrontSettings(threshold=0.5, search_km=150.0, coastal_cells=1, min_cells=4)


def fronts(spark, sf):
    asks = I.plane_points(spark, sf).withColumnRenamed("event_date", "date")
    g = I.grid(spark, sf)
    nx = g.agg(F.max("x")).first()[0] + 1
    return FR.extract(asks, I.field(spark, sf), g, SETTINGS, 25, nx, -500000.0, 300000.0, 25000.0, -25000.0)


EDGE = I.with_ctes("field", "grid") + """, lim AS (SELECT max(x) AS mx FROM grid), d AS (SELECT f.date, g.y, g.x, f.value, g.region_code <= 18 AS ocean FROM grid g JOIN field f ON f.y = g.y AND f.x = g.x),
coast AS (SELECT y, x FROM grid WHERE region_code > 18 UNION SELECT a.y, a.x FROM grid a, lim, grid b WHERE b.region_code > 18 AND a.y BETWEEN 1 AND 23 AND a.x BETWEEN 1 AND mx - 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
edge AS (SELECT DISTINCT h.date, h.y, h.x FROM d h JOIN d l ON l.date = h.date AND abs(l.y - h.y) <= 1 AND abs(l.x - h.x) <= 1 AND l.ocean AND l.value < 0.5, lim WHERE h.ocean AND h.value >= 0.5 AND h.y BETWEEN 1 AND 23 AND h.x BETWEEN 1 AND mx - 1 AND NOT EXISTS (SELECT 1 FROM coast c WHERE c.y = h.y AND c.x = h.x))"""


@query("ras_10_edge_cells", EDGE + " SELECT date, y, x FROM edge")
def _(spark, sf):
    g = I.grid(spark, sf)
    nx = g.agg(F.max("x")).first()[0] + 1
    return FR.edge_cells(I.field(spark, sf), g, SETTINGS, 25, nx).select("date", "y", "x")


@query("ras_10_front_quality")
def _(spark, sf):
    return fronts(spark, sf)[1]


@query("top_04_ras_10_front_rows")
def _(spark, sf):
    return fronts(spark, sf)[0]


@query("ras_11_relative_wind")
def _(spark, sf):
    return FR.relative_wind(fronts(spark, sf)[0], I.met(spark, sf), -180.0, 50.0, 20.0, 4.0, 18, 10)
