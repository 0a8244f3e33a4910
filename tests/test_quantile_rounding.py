"""A cut between two values must have the SQL's last bit: rows are compared with it."""

import duckdb
import numpy as np

from tidelens.operators import ordered


def test_quantiles_have_the_bits_of_the_sql(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in range(120) for v in rng.random(int(rng.integers(2, 60))) * 1000]
    low = 0.7
    rows += [(1000 + n, v) for n in range(2, 60) for v in [low] * n + [float(np.nextafter(low, 1))] * (n // 3 + 1)]  # neighbours: the cut is one or the other
    probs = {"q25": 0.25, "q80": 0.8, "q85": 0.85, "q90": 0.9}
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: tuple(r[p] for p in probs) for r in ordered.quantiles(df, ["g"], "v", probs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {g: tuple(q) for g, *q in con.execute(f"SELECT g, {', '.join(f'quantile_cont(v, {p})' for p in probs.values())} FROM t GROUP BY g").fetchall()}
    assert got == want


def test_values_at_the_ends_of_a_cut():
    assert ordered.between(None, 1.0, 0.5) is None and ordered.between(2.0, 2.0, 0.3) == 2.0 and ordered.between(1.0, 3.0, 0.0) == 1.0
    assert ordered.between(1.0, float("inf"), 0.5) == float("inf") and ordered.between(1.0, 3.0, 0.5) == 2.0
