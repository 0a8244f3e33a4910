"""Event and patch catalogues: one schema for every kind, filters, region names, masks, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, scalar as S
from ..operators import joins as J

MATCH_COLUMNS = ("event_id", "definition", "region", "event_date", "start_date", "end_date", "centroid_lon", "centroid_lat")


def as_match_frame(df: DataFrame, kind: str, locations: DataFrame | None = None) -> DataFrame:
    """SRC-07: map a catalogue of one of six kinds to the common matching columns."""
    if kind in ("severe", "major"):
        picked = [("unique_local_event_id", "event_id"), ("dominant_region", "region"), ("event_start", "event_date"), ("event_start", "start_date"),
                  ("event_end", "end_date"), ("track_centroid_lon", "centroid_lon"), ("track_centroid_lat", "centroid_lat")]
    elif kind in ("severe_cluster", "major_cluster"):
        picked = [("cluster_id", "event_id"), ("representative_region", "region"), ("representative_date", "event_date"), ("start_date", "start_date"),
                  ("end_date", "end_date"), ("representative_lon", "centroid_lon"), ("representative_lat", "centroid_lat")]
    elif kind == "panarctic":
        df = df.join(locations.select("date", "region", "center_lon", "center_lat"), "date", "left")
        picked = [("event_id", "event_id"), ("region", "region"), ("date", "event_date"), ("date", "start_date"), ("date", "end_date"),
                  ("center_lon", "centroid_lon"), ("center_lat", "centroid_lat")]
    elif kind == "regional":
        df = df.withColumn("_none", F.lit(None).cast("double"))
        picked = [("unique_event_id", "event_id"), ("region", "region"), ("event_date", "event_date"), ("start_date", "start_date"), ("end_date", "end_date"),
                  ("_none", "centroid_lon"), ("_none", "centroid_lat")]
    else:
        raise ValueError(f"unknown catalogue kind {kind!r}")
    named = df.select(*[F.col(a).alias(b) for a, b in picked]).withColumn("definition", F.lit(kind))
    return named.select(*MATCH_COLUMNS)


def patch_filter(df: DataFrame, window_days: int, threshold: float, min_cells: int) -> DataFrame:
    """FLT-05."""
    return df.filter((F.col("window_days") == window_days) & S.is_close("threshold", F.lit(threshold)) & (F.col("object_area_cells") >= min_cells))


def mask_membership(points: DataFrame, grid: DataFrame, codes: Sequence[int], x0, y0, step_x, step_y) -> DataFrame:
    """FLT-07: does the nearest mask cell of a projected point carry one of the codes?  Outside the grid is no."""
    y, x = J.nearest_projected_cell("px_m", "py_m", x0, y0, step_x, step_y)
    cells = grid.select("y", "x", "region_code")
    return points.withColumn("y", y).withColumn("x", x).join(cells, ["y", "x"], "left").withColumn("member", F.coalesce(F.col("region_code").isin(*codes), F.lit(False)))


def region_table(spark) -> DataFrame:
    """region_dim with aliases: word -> name, code, bounds (fixed, under a hundred rows)."""
    rows = [(n, n, fixed.REGION_CODES.get(n), *map(float, b)) for n, b in fixed.REGION_BOUNDS.items()]
    rows += [(a, n, fixed.REGION_CODES.get(n), *map(float, fixed.REGION_BOUNDS[n])) for a, n in fixed.REGION_ALIASES.items()]
    return spark.createDataFrame(rows, "word string, region_name string, code int, lon_min double, lon_max double, lat_min double, lat_max double")


def resolve_regions(df: DataFrame, word: str) -> DataFrame:
    """FLT-08: region word, alias or ``lon0,lon1,lat0,lat1`` -> name and bounds; an unknown word fails the row's task."""
    key = F.regexp_replace(F.lower(F.trim(F.col(word))), "[ -]", "_")
    dim = region_table(df.sparkSession).withColumnRenamed("word", "_word")
    box = F.transform(F.split(F.col(word), ","), lambda v: F.trim(v).try_cast("double"))
    hit = df.withColumn("_key", F.when(F.coalesce(F.col(word), F.lit("")) == "", "pan_arctic").otherwise(key)).join(dim, F.col("_key") == F.col("_word"), "left")
    is_box = F.col("region_name").isNull() & (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())
    bad = F.raise_error(F.concat(F.lit("unknown region "), F.col(word)))
    named = F.when(F.col("region_name").isNotNull(), F.col("region_name")).when(is_box, F.lit("custom_bbox")).otherwise(bad)
    out = hit.withColumn("_named", named)
    for i, c in enumerate(("lon_min", "lon_max", "lat_min", "lat_max")):
        out = out.withColumn(c, F.when(is_box, F.get(box, F.lit(i))).otherwise(F.col(c)))
    return out.withColumn("region_name", F.col("_named")).drop("_named", "_key", "_word")


def ocean_mask(grid: DataFrame, ocean=fixed.OCEAN_CODES, other=fixed.OTHER_CODES) -> DataFrame:
    """FLT-09: ocean flag; a code in neither list fails the task that sees it."""
    code = F.col("region_code")
    known = F.when(code.isin(*ocean), True).when(code.isin(*other), False)
    return grid.withColumn("ocean", F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown surface code "), code.cast("string")))))


def with_floors(df: DataFrame, start: str, floors: Sequence[float | None], name: str = "scenario") -> DataFrame:
    """FLT-11: repeat rows per scenario, keeping those at or above its floor; no floor keeps all."""
    options = F.array(*[F.when(F.lit(True) if f is None else F.col(start) >= f, F.lit("none" if f is None else str(f))) for f in floors])
    return df.withColumn(name, F.explode(F.array_compact(options)))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """FLT-12: the first n rows per group.  Each task keeps its own first n before the exchange, so a hot group never gathers."""
    from pyspark.sql import Window as W
    local = df.withColumn("_task", F.spark_partition_id())
    salted = W.partitionBy("_task", *keys).orderBy(*order)
    top = local.withColumn("_rn", F.row_number().over(salted)).filter(F.col("_rn") <= n)
    return top.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn", "_task")


def readable(df: DataFrame, field: DataFrame, anchor: str, back: int) -> DataFrame:
    """FLT-15: both ends of the window have data (distinct field days are bounded by the calendar)."""
    days = field.select("date").distinct()
    at = df.join(days, df[anchor] == days["date"], "left_semi")
    return at.join(days.select(F.date_add("date", back).alias(anchor)), anchor, "left_semi")


def in_range(df: DataFrame, date: str, first: int, last: int, months="annual", region="region") -> DataFrame:
    """FLT-16."""
    return df.filter(F.year(date).between(first, last) & S.in_months(date, months)).withColumn(region, F.coalesce(region, F.lit("unknown")))


def with_labels(df: DataFrame, id_col: str, out: str = "label", language: str = "en", labels: dict | None = None) -> DataFrame:
    """SCA-19: display label by id and language; an id without one shows as itself.  The dictionary is a few fixed rows."""
    table = fixed.REGION_LABELS if labels is None else labels
    if language not in ("en", "zh"):
        raise ValueError("language must be en or zh")
    rows = [(k, v[language]) for k, v in table.items()]
    dim = df.sparkSession.createDataFrame(rows, "_id string, _label string")
    return df.join(dim, F.col(id_col) == F.col("_id"), "left").withColumn(out, F.coalesce("_label", F.col(id_col))).drop("_id", "_label")
