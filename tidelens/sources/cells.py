"""Cell tables: field scans, array flattening, newest file versions, footprint store, coverage, file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S

VALUE_NAMES = ("cdr_seaice_conc", "seaice_conc", "sic", "siconc", "ice_conc", "value")


def scan_field(df: DataFrame, dates: DataFrame | None = None, names: Sequence[str] = VALUE_NAMES, low=0.0, high=1.0) -> DataFrame:
    """SRC-02: (date, y, x, value) for the wanted days; the value column is found by alias, values outside [low, high] become null."""
    column = next((n for n in names if n in df.columns), None)
    if column is None:
        raise ValueError(f"none of {list(names)} in {df.columns}")
    v = S.nan_to_null(column)
    out = df.select("date", "y", "x", F.when(v.between(low, high), v).alias("value"))
    return out.join(dates.select("date").distinct(), "date", "left_semi") if dates is not None else out


def explode_grid(df: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """SRC-03: array of rows -> one row per cell."""
    rows = df.select(*keys, F.posexplode(values).alias("y", "_row"))
    return rows.select(*keys, "y", F.posexplode("_row").alias("x", "value"))


def newest_version(files: DataFrame, date: str = "date", path: str = "path", pattern: str = r"_v([0-9]+(?:\.[0-9]+)*)") -> DataFrame:
    """SRC-04: path with the highest dotted version per date (versions compare number by number)."""
    version = F.transform(F.split(F.regexp_extract(path, pattern, 1), "\\."), lambda p: p.try_cast("int"))
    return files.groupBy(date).agg(F.max_by(path, F.struct(version, F.col(path))).alias(path))


def grid_in_km2(df: DataFrame, area_m2: str = "area_m2") -> DataFrame:
    """SRC-05: static grid with areas in km2."""
    return df.withColumn("area_km2", S.m2_to_km2(area_m2)).drop(area_m2)


def files_in_years(files: DataFrame, first: int, last: int, path: str = "path") -> DataFrame:
    """SRC-06: year from the last 19xx/20xx in the file name; only years in range."""
    name = F.element_at(F.split(path, "/"), -1)
    years = F.regexp_extract_all(name, F.lit(r"((?:19|20)[0-9]{2})"), 1)
    return files.withColumn("year", F.when(F.size(years) > 0, F.element_at(years, -1).cast("int"))).filter(F.col("year").between(first, last))


def write_footprints(cells: DataFrame, path: str) -> None:
    """SRC-09: footprint store partitioned by year, rows of one object kept together in a file."""
    (cells.withColumn("delta", F.col("delta").cast("float")).withColumn("year", F.year("date"))
     .repartition("year", "object_id").sortWithinPartitions("year", "object_id", "y", "x")
     .write.mode("errorifexists").partitionBy("year").parquet(path))


def read_footprints(spark: SparkSession, path: str, ids: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """SRC-08: cells of the wanted objects only; years prune partitions."""
    cells = spark.read.parquet(path)
    if years is not None:
        cells = cells.filter(F.col("year").isin(*years))
    return cells.join(ids.select("object_id").distinct(), "object_id", "left_semi")


def coverage(have: DataFrame, first: str, last: str, months, date: str = "date") -> DataFrame:
    """SRC-12: per year, how many required days exist and which are missing (the calendar bounds both sides)."""
    need = have.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(date)).filter(S.in_months(date, months))
    seen = have.select(date).distinct().withColumn("_seen", F.lit(True))
    return need.join(seen, date, "left").groupBy(F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("required_days"), F.count("_seen").alias("present_days"),
        F.min(F.when(F.col("_seen").isNull(), F.col(date))).alias("first_missing"),
    ).withColumn("status", F.when(F.col("required_days") == F.col("present_days"), "complete").otherwise("incomplete"))


def required_inventory(events: DataFrame, files: DataFrame, offsets=((-2, "start"), (1, "end"))) -> DataFrame:
    """SRC-13: days needed by events with the roles and the number of events, and whether a file exists."""
    want = events.select("event_id", F.inline(F.array(*[F.struct(F.date_add("event_date", F.lit(o)).alias("date"), F.lit(r).alias("role")) for o, r in offsets])))
    # two roles at most, so the set per day stays tiny; ids are counted, not gathered
    need = want.groupBy("date").agg(F.concat_ws(";", F.array_sort(F.collect_set("role"))).alias("roles"), F.count_distinct("event_id").alias("n_events"))
    have = files.select("date").distinct().withColumn("_have", F.lit(True))
    return need.join(have, "date", "left").withColumn("status", F.when(F.col("_have"), "present").otherwise("missing")).drop("_have")


def schema_audit(inputs: dict[str, DataFrame], required: dict[str, Sequence[str]]) -> DataFrame:
    """SRC-15: one row per input with its missing columns, row count and status."""
    rows = None
    for name, df in inputs.items():
        missing = [c for c in required.get(name, ()) if c not in df.columns]
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("input"), F.lit(";".join(missing)).alias("missing_columns"), "n_rows",
            F.when(F.lit(bool(missing)), "missing_columns").when(F.col("n_rows") == 0, "empty").otherwise("available").alias("status"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
