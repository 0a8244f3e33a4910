import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelens.functions import stats as ST
from tidelens.operators import budget as B, ordered, resample as RS, severity as SV


def test_ranks_quantiles_and_row_numbers_against_pandas(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(500), "g": r.choice(list("abc"), 500, p=[0.8, 0.15, 0.05]), "v": r.integers(0, 40, 500).astype(float)})
    df = spark.createDataFrame(pdf)
    got = ordered.average_rank_pct(ordered.average_rank_pct(df, ["g"], "v", "pg"), [], "v", "pa").toPandas().sort_values("id")
    assert np.allclose(got["pg"], pdf.groupby("g")["v"].rank(pct=True)) and np.allclose(got["pa"], pdf["v"].rank(pct=True))
    q = ordered.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.8, "c": 1.0, "z": 0.0}).toPandas().set_index("g")
    for g, s in pdf.groupby("g")["v"]:
        assert np.allclose(q.loc[g, ["z", "a", "b", "c"]].astype(float), s.quantile([0, 0.05, 0.8, 1.0]))
        assert q.loc[g, "n_values"] == len(s)
    rn = ordered.row_numbers(df, ["g"], ["v", "id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert (rn["rn"].to_numpy() == want.to_numpy()).all()


def test_quantile_of_one_hot_value(spark):
    df = spark.range(1000).select((F.col("id") < 990).cast("double").alias("v"))
    q = ordered.quantiles(df, [], "v", {"m": 0.5, "lo": 0.005}).first()
    assert q.m == 1.0 and q.lo == 0.0


def bh(p):
    p = np.asarray(p, float)
    out = np.full(p.size, np.nan)
    ok = ~np.isnan(p)
    order = np.argsort(p[ok], kind="stable")
    s = p[ok][order]
    adj = np.minimum.accumulate((s * s.size / np.arange(1, s.size + 1))[::-1])[::-1]
    tmp = np.empty(s.size)
    tmp[order] = np.minimum(adj, 1)
    out[ok] = tmp
    return out


@pytest.mark.parametrize("fn", [RS.fdr_bh, RS.fdr_bh_large])
def test_fdr_with_ties_and_null(spark, fn):
    p = [0.01, 0.04, 0.03, 0.2, 0.005, 0.04, None, 0.9]
    df = spark.createDataFrame([(i, f, v) for f in ("x", "y") for i, v in enumerate(p)], "i int, f string, p_raw double")
    rows = fn(df, ["f"]).orderBy("i").collect()
    want = bh([np.nan if v is None else v for v in p])
    for f in ("x", "y"):
        got = [r.p_fdr for r in rows if r.f == f]
        assert got[6] is None
        assert np.allclose([np.nan if v is None else v for v in got], want, equal_nan=True)


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880348), (0.0, 5, 1.0), (1.0, 1, 0.5), (2.5758293, 1e7, 0.01000000), (-3.0, 2, 0.0954659663), (12.706204736, 1, 0.05)])
def test_student_tail(t, df, p):
    assert ST.t_two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, abs=2e-8)


def units(spark, n=12, parts=1):
    r = np.random.default_rng(2)
    rows = [("g", f"u{i}", 1990 + i % 4, float(v)) for i, v in enumerate(r.normal(0.4, 1, n))]
    return rows, spark.createDataFrame(rows, "g string, u string, year int, d double").repartition(parts)


def test_resampling_does_not_depend_on_partitions_or_path(spark):
    _, a = units(spark)
    _, b = units(spark, parts=5)
    means = lambda df, **k: {r.rep: round(r["mean"], 12) for r in RS.resampled_means(df, ["g"], "d", "u", 60, 7, **k).collect()}
    base = means(a)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert means(b) == base and means(b, page=2) == base
        flip = lambda df: {r.rep: round(r["mean"], 12) for r in RS.sign_flip_means(df, ["g"], "d", "u", 50, 7).collect()}
        assert flip(a) == flip(b) and len(flip(a)) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(base) == 60


def test_bounds_of_resampling(spark):
    rows, df = units(spark)
    d = [r[3] for r in rows]
    ci = RS.bootstrap_ci(df, ["g"], "d", "u", 400, 3).first()
    assert min(d) < ci.ci_low < np.mean(d) < ci.ci_high < max(d)
    se = np.std(d, ddof=1) / np.sqrt(len(d))
    assert (ci.ci_high - ci.ci_low) == pytest.approx(2 * 1.96 * se, rel=0.35)
    p = RS.sign_flip_p(df, ["g"], "d", "u", 400, 3, "greater").first()
    assert 1 / 401 <= p.p_raw <= 1
    y = RS.year_block_ci(df, ["g"], "d", "year", 200, 3).first()
    assert y.n_years == 4 and y.n_events == 12 and y.n_bootstrap_valid == 200 and y.ci_low <= y.primary_mean <= y.ci_high


def test_sign_flip_of_constant_positive_differences(spark):
    df = spark.createDataFrame([("g", f"u{i}", 1.0) for i in range(20)], "g string, u string, d double")
    assert RS.sign_flip_p(df, ["g"], "d", "u", 300, 1, "greater").first().p_raw == pytest.approx(1 / 301)
    assert RS.sign_flip_p(df, ["g"], "d", "u", 300, 1, "less").first().p_raw == 1.0


def test_confirmation_ladder(spark):
    rows = [(1.0, 0.2, 2.0, 3, 10), (1.0, -0.2, 2.0, 3, 10), (-1.0, 0.2, 2.0, 3, 10), (1.0, 0.2, 2.0, 1, 10), (0.0, 0.2, 2.0, 3, 10), (1.0, None, 2.0, 3, 10), (1.0, 2.0, 0.2, 3, 10), (1.0, 0.2, 2.0, 3, 0)]
    df = spark.createDataFrame(rows, "primary_mean double, ci_low double, ci_high double, n_years int, n_bootstrap_valid int")
    got = [r.confirmation_reason for r in RS.confirmation(df).collect()]
    assert got == ["ci_excludes_zero_and_matches_primary_direction", "year_block_ci_crosses_zero", "year_block_ci_opposes_primary_direction", "fewer_than_two_year_blocks", "primary_direction_zero", "year_block_ci_nonfinite", "year_block_ci_invalid", "no_valid_year_block_bootstrap_resamples"]


def test_least_squares_rank_and_coefficients(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(20, 2))
    rows = [(float(3 + 2 * a - b), float(a), float(b), float(2 * a), 1990 + i % 5) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, year int").withColumn("g", F.lit("g"))
    f = RS.least_squares(df, ["g"], "y", ["a", "b"]).first()
    design = np.column_stack([np.ones(20), x])
    assert f.beta == pytest.approx([3, 2, -1]) and f.matrix_rank == 3 and f.condition_number == pytest.approx(np.linalg.cond(design), rel=1e-6)
    bad = RS.least_squares(df, ["g"], "y", ["a", "c"]).first()
    assert bad.matrix_rank == 2
    b = RS.year_block_intercept(df, ["g"], "y", ["a", "b"], "year", 40, 1).first()
    assert b.ci_low == pytest.approx(3, abs=1e-6) and b.ci_high == pytest.approx(3, abs=1e-6)


def test_severity_with_tied_losses(spark):
    rows = [(f"E{i}", "a" if i < 7 else "b", float(min(i, 5)), 100 + i, 625.0 * (100 + i), i / 10.0, 1 + i % 3, -0.1) for i in range(10)]
    cols = ["unique_local_event_id", "dominant_region", "cumulative_loss", "max_area_cells", "max_area_km2", "max_intensity", "duration_days", "sic_change_threshold"]
    pdf = pd.DataFrame(rows, columns=cols)
    got = SV.mark_severe(spark.createDataFrame(pdf)).toPandas().set_index("unique_local_event_id")
    q = lambda s: s.quantile(0.8)
    ok = (pdf.max_area_cells >= 100) & ((pdf.duration_days >= 2) | (pdf.max_intensity >= q(pdf.max_intensity)))
    glob = ((pdf.cumulative_loss >= q(pdf.cumulative_loss)) | (pdf.max_area_cells >= q(pdf.max_area_cells))) & ok
    assert list(got.loc[pdf.unique_local_event_id, "is_severe_global"]) == list(glob)
    m, counts = SV.select_major(spark.createDataFrame(pdf))
    assert counts.count() == 7 and set(r.family for r in counts.collect()) == {"global", "region_normalized", "severity_index"}
    names = [r.major_definition for r in m.collect()]
    assert names and all(n.split("_top")[0] in ("global_loss", "region_loss", "severity_index") for n in names)


def test_spearman_against_pandas(spark):
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": ["x"] * 40, "a": r.integers(0, 9, 40).astype(float), "b": r.normal(size=40)})
    assert B.spearman(spark.createDataFrame(pdf), ["k"], "a", "b").first().rho == pytest.approx(np.corrcoef(pdf.a.rank(), pdf.b.rank())[0, 1])


def test_draws_do_not_depend_on_the_stride(spark, monkeypatch):
    df = spark.createDataFrame([(g, f"{i:04d}", float(i * i % 17)) for g, n in (("a", 1), ("b", 90), ("c", 333)) for i in range(n)], "g string, u string, v double")
    means = lambda: sorted(map(tuple, RS.resampled_means(df, ["g"], "v", "u", 7, 3, page=50).collect()))
    whole = means()
    assert len(whole) == 21
    monkeypatch.setattr(RS, "STRIDE", 8)
    assert [(g, r, round(m, 9)) for g, r, m in means()] == [(g, r, round(m, 9)) for g, r, m in whole]


def test_dealt_draws_against_hashlib_and_shelves(spark, monkeypatch):
    import hashlib
    draws = lambda t: [int(hashlib.md5(t.encode()).hexdigest()[8 * p:8 * p + 8], 16) for p in range(4)]
    for text in ("", "11|R0|100|v1|", "y" * 53, "y" * 61, "q" * 130):
        n = np.arange(95, 100)
        got = ST.md5_draws(ST.md5_words([text.encode(), ST.decimal_bytes(n, 2)]), len(n))
        assert [list(c) for c in got.T] == [draws(f"{text}{v}") for v in n]
    sizes = (("a", 1), ("b", 90), ("é", 333))
    rows = [(g, f"{i:04d}", float(i * i % 17)) for g, n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g string, u string, v double").repartition(3)
    want = {}
    for g, n in sizes:
        v = [r[2] for r in rows if r[0] == g]
        for rep in range(12):
            want[g, rep] = np.mean([v[draws(f"3|{g}|{rep}|{i // 4}")[i % 4] % n] for i in range(n)])
    for shelf in (RS.SHELF, 2):
        monkeypatch.setattr(RS, "SHELF", shelf)
        got = {(r.g, r.rep): r["mean"] for r in RS.resampled_means(df, ["g"], "v", "u", 12, 3, page=20).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    flips = {(r.g, r.rep): r["mean"] for r in RS.sign_flip_means(df, ["g"], "v", "u", 45, 3).collect()}
    for g, n in sizes:
        for rep in range(45):
            signed = [r[2] * (draws(f"3|{g}|s|{r[1]}|{rep // 4}")[rep % 4] % 2 * 2 - 1) for r in rows if r[0] == g]
            assert flips[g, rep] == pytest.approx(np.mean(signed), abs=1e-9)
    assert "_picks" not in RS.resampled_means(df, ["g"], "v", "u", 12, 3)._jdf.queryExecution().toString()
