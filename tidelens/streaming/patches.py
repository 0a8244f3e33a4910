"""SEQ-01 on a stream: patches are linked as their days close, with the live objects of a key as its state.

The batch form (``operators.tracking.track_patches``) settles all days at once.  Here the rule is applied day by day: rows
wait in the state of their key until the watermark has passed their day, are then taken in the order of the rule, and leave
with the first patch of their event.  The state holds the objects seen in the last days and the rows of days that are still
open, whatever the length of the stream.  Rows older than the watermark are late and dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import _Live

DAY_MS = 86_400_000


def _linked(rows: list[list], live: list[list], days: int, km: float) -> tuple[list[tuple], list[list]]:
    """Openers of rows (day, -loss, id, lon, lat) taken in order, and the objects (opener, day, lon, lat) alive after them."""
    at = _Live()
    for known in live:
        at.open(*known)
    out, today = [], None
    for day, loss, ident, lon, lat in sorted(rows):
        if day != today:
            at.drop_before(day - days)
            today = day
        place = lon is not None and lat is not None
        n = at.nearest(lon, lat, km) if place else None
        if n is None:
            if place:
                at.open(ident, day, lon, lat)
            out.append((ident, day, ident))
        else:
            at.move(n, day, lon, lat)
            out.append((ident, day, at.ids[n]))
    return out, [[i, d, *p] for i, d, p in zip(at.ids, at.days, at.places)]


def track_patch_stream(patches: DataFrame, days: int = 2, km: float = 300.0, keys: Sequence[str] = ("region",), delay: str = "0 seconds") -> DataFrame:
    """(keys, object_id, date, opener) of a stream of patches, appended once their day is closed.

    A day closes when the watermark passes its end: ``delay`` after a later day was seen in any key.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in patches.schema.fields}
    seen = patches.select(*keys, "object_id", F.col("date").cast("timestamp").alias("seen"), F.datediff("date", F.lit("1970-01-01")).alias("day"),
                          F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"), F.col("cumulative_sic_loss").alias("loss"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, waiting = map(json.loads, state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for pdf in batches:
                none = lambda v: None if pd.isna(v) else float(v)
                waiting += [[int(d), -float(w), i, none(x), none(y)] for d, w, i, x, y in zip(pdf["day"], pdf["loss"], pdf["object_id"], pdf["lon"], pdf["lat"])]
        closed = state.getCurrentWatermarkMs() // DAY_MS
        ready = [r for r in waiting if r[0] < closed]
        waiting = [r for r in waiting if r[0] >= closed]
        out, live = _linked(ready, live, days, km)
        live = [v for v in live if closed - v[1] <= days + 1]
        if waiting or live:
            state.update((json.dumps(live), json.dumps(waiting)))
            state.setTimeoutTimestamp((min([r[0] for r in waiting] or [closed + days]) + 1) * DAY_MS)
        elif state.exists:
            state.remove()
        rows = pd.DataFrame(out, columns=["object_id", "day", "opener"])
        for name, value in zip(keys, key):
            rows[name] = value
        yield rows[[*keys, "object_id", "day", "opener"]]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"object_id {kinds['object_id']}", "day int", f"opener {kinds['object_id']}"])
    out = seen.withWatermark("seen", delay).groupBy(*keys).applyInPandasWithState(step, schema, "live string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, "object_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"), "opener")
