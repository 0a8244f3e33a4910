"""The stream of patches gives what the batch gives, whatever the micro-batches."""

import datetime as dt

import numpy as np
import pytest

from tidelens.operators import tracking as T
from tidelens.streaming.patches import track_patch_stream

D0 = dt.date(2001, 6, 1)
SCHEMA = "object_id string, region string, date date, centroid_lon double, centroid_lat double, cumulative_sic_loss double"


@pytest.mark.parametrize("days_a_file", [1, 3])
def test_replay_equals_batch(spark, tmp_path, days_a_file):
    r = np.random.default_rng(8)
    rows = [(f"O{i:04d}", f"g{i % 3}", D0 + dt.timedelta(int(r.integers(12))), float(r.uniform(0, 40)), float(r.uniform(70, 80)), float(r.uniform(0, 9))) for i in range(150)]
    # the last row closes the last day and is itself never closed
    rows.append(("Z", "end", D0 + dt.timedelta(40), 0.0, 80.0, 1.0))
    folder = tmp_path / "in"
    for n, lo in enumerate(range(0, 41, days_a_file)):
        mine = [x for x in rows if lo <= (x[2] - D0).days < lo + days_a_file]
        if mine:
            spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"n={n:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*")
    query = track_patch_stream(stream).writeStream.format("memory").queryName(f"linked{days_a_file}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {x.object_id: (x.date, x.opener) for x in spark.table(f"linked{days_a_file}").collect()}
    want = {x.object_id: (x.date, x.opener) for x in T.track_patches(spark.createDataFrame(rows[:-1], SCHEMA)).collect()}
    assert got == want
