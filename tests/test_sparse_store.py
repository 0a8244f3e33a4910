"""Doubled cells are found from a few blocks of an object, not from a row for every cell."""

import collections

import pytest

from tidelens.operators import quality as Q

CLEAN = [(o, y, x, -0.5) for o in ("a", "b") for y in range(-1, 23) for x in range(16)]
ODD = [("a", 3, 4, -0.1), ("a", 3, 4, None), ("a", 3, 4, 0.0), ("b", -1, 2, float("nan")), ("c", None, 99, 1.0), ("c", None, 99, 1.0), ("c", 7, None, 1.0), (None, 1, 1, 1.0), (None, 1, 1, 1.0), ("d", 30, 40, 1.0)]


def plain(rows, ny, nx):
    seen = collections.Counter((o, y, x) for o, y, x, _ in rows)
    out = lambda y, x: any((y is not None and (y < 0 or y >= ny), x is not None and (x < 0 or x >= nx)))
    return sum(n > 1 for n in seen.values()), sum(out(y, x) for _, y, x in seen), sum(d is None or d != d for *_, d in rows), len(rows)


@pytest.mark.parametrize("rows", [CLEAN, CLEAN + ODD, ODD])
def test_sparse_store_by_blocks(spark, monkeypatch, rows):
    kept, cut = [], Q.durable
    monkeypatch.setattr(Q, "durable", lambda df: kept.append(cut(df)) or kept[-1])
    got = Q.sparse_store(spark.createDataFrame(rows, "object_id string, y int, x int, delta double"), 22, 15).first()
    assert tuple(got) == plain(rows, 22, 15)
    assert rows is ODD or kept[0].count() < len(rows) / 8


def test_sparse_store_of_nothing(spark):
    assert tuple(Q.sparse_store(spark.createDataFrame([], "object_id string, y int, x int, delta double"), 5, 5).first()) == (0, 0, None, None)
