"""SQL of the order-dependent linkers: a recursion that takes one row per step and group and keeps the live objects in a list."""

from __future__ import annotations

from . import inputs as I

HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({b}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians(({lb}) - ({la})) / 2), 2))))"


def km(lon_a: str, lat_a: str, lon_b: str, lat_b: str) -> str:
    return HAV.format(a=lat_a, b=lat_b, la=lon_a, lb=lon_b)


def patch_walk(source: str, group: str, days: int = 2, reach: float = 300.0) -> str:
    """CTEs ps (numbered patches), pw (the walk) and linked (group columns, object_id, opener) over ``source``.

    A patch joins the nearest object that was last seen at most ``days`` before and lies within ``reach``; the first of equals.
    """
    d = km("l.lon", "l.lat", "p.centroid_lon", "p.centroid_lat")
    here = "{'id': p.object_id, 'd': p.date, 'lon': p.centroid_lon, 'lat': p.centroid_lat}"
    return f"""ps AS (SELECT {group}, object_id, date, centroid_lon, centroid_lat, dense_rank() OVER (ORDER BY {group}) AS g_, row_number() OVER (PARTITION BY {group} ORDER BY date, cumulative_sic_loss DESC, object_id) AS rn_ FROM {source}),
pw AS (SELECT g_, rn_, object_id, object_id AS opener, [{here}] AS live FROM ps p WHERE rn_ = 1
 UNION ALL SELECT g_, rn_, object_id, CASE WHEN best <= {reach} THEN alive[n_].id ELSE object_id END,
  CASE WHEN best <= {reach} THEN list_transform(alive, lambda l, i: CASE WHEN i = n_ THEN {{'id': l.id, 'd': date, 'lon': centroid_lon, 'lat': centroid_lat}} ELSE l END) ELSE list_append(alive, {{'id': object_id, 'd': date, 'lon': centroid_lon, 'lat': centroid_lat}}) END
  FROM (SELECT *, list_min(ds) AS best, list_position(ds, list_min(ds)) AS n_ FROM (SELECT p.*, alive, list_transform(alive, lambda l: {d}) AS ds FROM (SELECT p.*, list_filter(w.live, lambda l: p.date - l.d <= {days}) AS alive FROM pw w JOIN ps p ON p.g_ = w.g_ AND p.rn_ = w.rn_ + 1) p))),
linked AS (SELECT ps.*, pw.opener FROM pw JOIN ps USING (g_, rn_))"""


def cluster_walk(source: str, group: str, gap: str, reach: str, touches: str) -> str:
    """CTEs cs, cw and clustered (group columns, event id, opener, running_lon, running_lat).

    ``touches``: SQL on regions a (of the cluster) and b (of the event).  The running centroid is kept as three sums.
    """
    d = km("l.lon", "l.lat", "p.track_centroid_lon", "p.track_centroid_lat")
    weight = "greatest(p.cumulative_loss, 1.0::DOUBLE)"
    fresh = "{{'id': {p}unique_local_event_id, 'd': {p}event_start, 'lon': {p}track_centroid_lon, 'lat': {p}track_centroid_lat, 'r': {p}dominant_region, 's': {p}w_, 'sx': {p}w_ * {p}track_centroid_lon, 'sy': {p}w_ * {p}track_centroid_lat}}"
    ok = touches.format(a="l.r", b="p.dominant_region")
    return f"""cs AS (SELECT {group}, unique_local_event_id, event_start, dominant_region, track_centroid_lon, track_centroid_lat, {weight} AS w_, dense_rank() OVER (ORDER BY {group}) AS g_, {gap} AS gap_, {reach} AS reach_, row_number() OVER (PARTITION BY {group} ORDER BY event_start, dominant_region, unique_local_event_id) AS rn_ FROM {source} p),
cw AS (SELECT g_, rn_, unique_local_event_id AS opener, track_centroid_lon AS running_lon, track_centroid_lat AS running_lat, [{fresh.format(p="p.")}] AS live FROM cs p WHERE rn_ = 1
 UNION ALL SELECT g_, rn_, CASE WHEN hit THEN new_[n_].id ELSE unique_local_event_id END, CASE WHEN hit THEN new_[n_].lon ELSE track_centroid_lon END, CASE WHEN hit THEN new_[n_].lat ELSE track_centroid_lat END, new_
  FROM (SELECT *, CASE WHEN hit THEN list_transform(alive, lambda l, i: CASE WHEN i = n_ THEN {{'id': l.id, 'd': event_start, 'lon': (l.sx + w_ * track_centroid_lon) / (l.s + w_), 'lat': (l.sy + w_ * track_centroid_lat) / (l.s + w_), 'r': l.r, 's': l.s + w_, 'sx': l.sx + w_ * track_centroid_lon, 'sy': l.sy + w_ * track_centroid_lat}} ELSE l END)
     ELSE list_append(alive, {fresh.format(p="")}) END AS new_
   FROM (SELECT *, coalesce(list_min(ds) <= reach_, false) AS hit, list_position(ds, list_min(ds)) AS n_ FROM (SELECT p.*, list_transform(alive, lambda l: CASE WHEN {ok} THEN {d} ELSE 1e9::DOUBLE END) AS ds FROM (SELECT p.*, list_filter(w.live, lambda l: p.event_start - l.d <= p.gap_) AS alive FROM cw w JOIN cs p ON p.g_ = w.g_ AND p.rn_ = w.rn_ + 1) p)))),
clustered AS (SELECT cs.*, cw.opener, cw.running_lon, cw.running_lat FROM cw JOIN cs USING (g_, rn_))"""


TRACKED = I.with_ctes("patch", recursive=True) + ",\n" + patch_walk("patch", "region")
#: Longitude class and unwrapped centroid of every event of ``linked``.
EVENT_GEOMETRY = """lv AS (SELECT DISTINCT unique_local_event_id AS e, ((centroid_lon % 360) + 360) % 360 AS v FROM lk), sp AS (SELECT unique_local_event_id AS e, max(centroid_lon) - min(centroid_lon) AS raw FROM lk GROUP BY 1),
gp AS (SELECT e, v, coalesce(lead(v) OVER (PARTITION BY e ORDER BY v), min(v) OVER (PARTITION BY e) + 360) AS nx FROM lv), tp AS (SELECT e, max(nx - v) AS g FROM gp GROUP BY 1),
ar AS (SELECT gp.e, max(g) AS g, min(nx % 360) AS a0 FROM gp JOIN tp USING (e) WHERE nx - v >= g - 1e-12 GROUP BY 1),
gm AS (SELECT e, a0, CASE WHEN 360 - g > 180 THEN 'LONGITUDE_DISTRIBUTED' WHEN raw > 180 THEN 'WRAP_ONLY' ELSE 'ORDINARY' END AS kind FROM ar JOIN sp USING (e)),
cw_ AS (SELECT lk.*, kind, CASE WHEN kind = 'ORDINARY' THEN centroid_lon ELSE ((centroid_lon % 360) + 360) % 360 + CASE WHEN ((centroid_lon % 360) + 360) % 360 < a0 - 1e-12 THEN 360 ELSE 0 END END AS branch_lon, greatest(cumulative_sic_loss, 0) AS w FROM lk JOIN gm ON gm.e = unique_local_event_id),
ce AS (SELECT unique_local_event_id AS e, any_value(kind) AS kind, CASE WHEN sum(w) > 0 THEN sum(w * branch_lon) / sum(w) ELSE avg(branch_lon) END AS x, CASE WHEN sum(w) > 0 THEN sum(w * centroid_lat) / sum(w) ELSE avg(centroid_lat) END AS y FROM cw_ GROUP BY 1)"""
#: Patches with their events' numbers.
NUMBERED = TRACKED + """,
no_ AS (SELECT region, object_id AS opener, 'ULE' || lpad(CAST(row_number() OVER (ORDER BY region, date, cumulative_sic_loss DESC, object_id) AS VARCHAR), 6, '0') AS unique_local_event_id FROM (SELECT patch.* FROM patch JOIN linked USING (object_id) WHERE linked.opener = object_id)),
lk AS (SELECT patch.*, linked.opener, no_.unique_local_event_id FROM patch JOIN linked USING (object_id) JOIN no_ ON no_.region = patch.region AND no_.opener = linked.opener)"""

RING_TOUCHES = "({b} = {a} OR {b} = 'R' || ((CAST({a}[2:] AS INTEGER) + 1) % 5))"


def thin_walk(source: str, min_km: float, most: int) -> str:
    """CTEs ts, tw and thinned: lowest pressure first, kept when far enough from all kept ones, up to ``most`` per day."""
    d = km("k.lon", "k.lat", "p.lon", "p.lat")
    return f"""ts AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY center_pressure_hpa, i, j) AS rn_ FROM {source}),
tw AS (SELECT date, rn_, true AS kept, [{{'lon': lon, 'lat': lat}}] AS held FROM ts WHERE rn_ = 1
 UNION ALL SELECT date, rn_, ok, CASE WHEN ok THEN list_append(held, {{'lon': lon, 'lat': lat}}) ELSE held END FROM (SELECT p.*, w.held, len(w.held) < {most} AND list_min(list_transform(w.held, lambda k: {d})) >= {min_km} AS ok FROM tw w JOIN ts p ON p.date = w.date AND p.rn_ = w.rn_ + 1)),
thinned AS (SELECT ts.* EXCLUDE (rn_) FROM ts JOIN tw USING (date, rn_) WHERE kept)"""


def track_walk(source: str, reach: float) -> str:
    """CTEs ks, kw and tracked: a centre takes the nearest track that ended the day before and is not yet taken today."""
    d = km("l.lon", "l.lat", "p.lon", "p.lat")
    return f"""ks AS (SELECT *, row_number() OVER (ORDER BY date, center_pressure_hpa, i, j) AS rn_ FROM {source}),
kw AS (SELECT rn_, rn_ AS track, NULL::DOUBLE AS dist, [{{'id': rn_, 'd': date, 'lon': lon, 'lat': lat}}] AS live FROM ks WHERE rn_ = 1
 UNION ALL SELECT rn_, CASE WHEN hit THEN alive[n_].id ELSE rn_ END, CASE WHEN hit THEN best END,
  CASE WHEN hit THEN list_transform(alive, lambda l, q: CASE WHEN q = n_ THEN {{'id': l.id, 'd': date, 'lon': lon, 'lat': lat}} ELSE l END) ELSE list_append(alive, {{'id': rn_, 'd': date, 'lon': lon, 'lat': lat}}) END
  FROM (SELECT *, list_min(ds) AS best, coalesce(list_min(ds) <= {reach}, false) AS hit, list_position(ds, list_min(ds)) AS n_ FROM (SELECT p.*, list_transform(alive, lambda l: CASE WHEN l.d = p.date - 1 THEN {d} ELSE 1e9::DOUBLE END) AS ds FROM (SELECT p.*, list_filter(w.live, lambda l: p.date - l.d <= 1) AS alive FROM kw w JOIN ks p ON p.rn_ = w.rn_ + 1) p))),
tl AS (SELECT track, count(DISTINCT date) AS n FROM kw JOIN ks USING (rn_) GROUP BY 1), ti AS (SELECT track, n, row_number() OVER (ORDER BY track) AS track_id FROM tl WHERE n >= 2),
tracked AS (SELECT ks.* EXCLUDE (rn_), kw.dist AS link_distance_km, ti.n AS track_length_days, ti.track_id, row_number() OVER (PARTITION BY ti.track ORDER BY ks.date) AS track_day_index FROM kw JOIN ks USING (rn_) JOIN ti USING (track))"""


def highpass_walk(cutoff_days: float, order: int) -> str:
    """CTEs that turn ``base`` (series_id, date, delta) into hp (series_id, date, delta_highpass): forward and backward pass with odd padding."""
    import numpy as np

    from ..operators.timeseries import highpass_coefficients

    b, a = highpass_coefficients(cutoff_days, order)
    companion = np.eye(order, k=1)
    companion[:, 0] = -a[1:]
    rest = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])
    numbers = lambda v: "[" + ", ".join(f"CAST('{float(x)!r}' AS DOUBLE)" for x in v) + "]"
    pad, n = 3 * (order + 1), order
    step = f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN i < {n} THEN z[i + 1] + B[i + 1] * v - A[i + 1] * y ELSE B[{n + 1}] * v - A[{n + 1}] * y END)"

    def walk(name: str, source: str) -> str:
        return f"""{name} AS (SELECT series_id, 0::BIGINT AS q, NULL::DOUBLE AS y, list_transform(R, lambda r: r * w[1]) AS z FROM {source}, co
 UNION ALL SELECT series_id, q, y, {step} FROM (SELECT *, B[1] * v + z[1] AS y FROM (SELECT {name}.series_id, {name}.q + 1 AS q, z, w[{name}.q + 1] AS v, A, B FROM {name} JOIN {source} USING (series_id), co WHERE {name}.q < len(w))))"""

    return f"""co AS (SELECT {numbers(a)} AS A, {numbers(b)} AS B, {numbers(rest)} AS R),
h0 AS (SELECT series_id, date, delta, row_number() OVER (PARTITION BY series_id ORDER BY date) AS p FROM base),
h1 AS (SELECT *, last_value(CASE WHEN delta IS NOT NULL THEN p END IGNORE NULLS) OVER u AS pa, last_value(delta IGNORE NULLS) OVER u AS va, first_value(CASE WHEN delta IS NOT NULL THEN p END IGNORE NULLS) OVER d AS pb, first_value(delta IGNORE NULLS) OVER d AS vb FROM h0
 WINDOW u AS (PARTITION BY series_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY series_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
hx AS (SELECT series_id, list(CASE WHEN delta IS NOT NULL THEN delta WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE (vb - va) / (pb - pa) * (p - pa) + va END ORDER BY p) AS x FROM h1 GROUP BY 1),
hw AS (SELECT series_id, len(x) AS n, list_concat(list_concat(list_transform(range(1, {pad + 1}), lambda q: 2 * x[1] - x[{pad + 2} - q]), x), list_transform(range(1, {pad + 1}), lambda q: 2 * x[len(x)] - x[len(x) - q])) AS w FROM hx),
{walk("wf", "hw")},
hb AS (SELECT series_id, list(y ORDER BY q DESC) AS w FROM wf WHERE q > 0 GROUP BY 1),
{walk("wb", "hb")},
hp AS (SELECT h0.series_id, h0.date, wb.y AS delta_highpass FROM h0 JOIN hw USING (series_id) JOIN wb ON wb.series_id = h0.series_id AND wb.q = hw.n + 2 * {pad} + 1 - (h0.p + {pad}))"""
