"""The suffix minimum of a bucket must not be computed anew for every row."""

from pyspark.sql import functions as F

from tidelens.operators import ordered


def test_suffix_min_reads_each_row_once(spark):
    rows = [(k, i, float((i * 37 + len(k)) % 101)) for k in ("a", "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    out = ordered.suffix_min(df, ["k"], [F.col("i")], "v", "low", buckets=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    ending = [line for line in plan.split("\n") if "unboundedfollowing" in line.lower() and "min(v" in line]
    assert not ending
    got = {(r.k, r.i): r.low for r in out.collect()}
    assert got == {(k, i): min(v for q, j, v in rows if q == k and j >= i) for k, i, _ in rows}
