"""Daily series files: scan and event sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: (date, value) from CSV with one or two header lines.

    The layout is chosen from the words of the first line: ``date,extent`` or
    ``year,month,day,extent`` in any order and case.  Lines that do not parse,
    such as a second header line, are dropped.
    """
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError(f"empty series file {path}")
    names = [c.strip().lower() for c in head[0].split(",")]
    wide = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(len(names))), mode="PERMISSIVE")
    at = {name: F.trim(F.col(f"c{i}")) for i, name in reversed(list(enumerate(names)))}
    numbered = wide.withColumn("_line", F.monotonically_increasing_id())
    if {"date", "extent"} <= set(at):
        rows = numbered.select(at["date"].try_cast("date").alias("date"), at["extent"].try_cast("double").alias("value"), "_line")
        return rows.filter("date is not null and value is not null").groupBy("date").agg(F.min_by("value", "_line").alias("value"))
    if {"year", "month", "day", "extent"} <= set(at):
        text = F.concat_ws("-", at["year"], at["month"], at["day"])
        rows = numbered.select(text.try_cast("date").alias("date"), at["extent"].try_cast("double").alias("value"), "_line")
        first = rows.filter("date is not null").groupBy("date").agg(F.min_by(F.struct("value"), F.col("_line")).alias("r"))
        return first.select("date", F.col("r.value").alias("value")).filter("value is not null")
    raise ValueError(f"no date,extent or year,month,day,extent columns in {names}")


def write_events(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SRC-10: ISO dates, refuses to overwrite; the commit protocol makes the write atomic."""
    dated = df.select(*[F.date_format(c.name, "yyyy-MM-dd").alias(c.name) if c.dataType.typeName() == "date" else F.col(c.name) for c in df.schema.fields])
    writer = dated.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_plain_tsv(df: DataFrame, path: str) -> None:
    """SRC-11: tab separated, no header, 15 significant digits."""
    def show(f):
        return F.format_string("%.15g", F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    df.select(*[show(f) for f in df.schema.fields]).write.mode("errorifexists").option("sep", "\t").option("header", False).csv(path)
