"""Gates, audits, reconciliation and fingerprints."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..session import durable, shuffled


def subset_gate(a: DataFrame, b: DataFrame, gate: str) -> DataFrame:
    """SET-04 / QA-12: keys of ``a`` missing from ``b`` and keys they share, as one row."""
    keys = a.columns
    left = a.distinct().join(b.distinct().withColumn("_in", F.lit(True)), keys, "left")
    return left.agg(F.count_if(F.col("_in").isNull()).alias("only_left"), F.count_if("_in").alias("shared")).select(F.lit(gate).alias("gate"), "only_left", "shared")


def shared_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """SET-05: per key, how many ids are in both sets, only in the first, only in the second."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*keys, *ids], "full_outer")
    return both.groupBy(*keys).agg(F.count_if(F.col("_a") & F.col("_b")).alias("shared"), F.count_if(F.col("_a") & F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull() & F.col("_b")).alias("only_b"))


def signatures(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """SET-06: order-free fingerprint of a group's members that does not depend on ids.

    Two 64-bit sums and an exclusive-or with the member count: all combine before the
    exchange, so a group with many members is never gathered.
    """
    h = F.xxhash64(part)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("_x"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.sum(F.xxhash64(F.lit("2"), part).cast("decimal(38,0)")).alias("_t"))
    return g.select(*keys, "n", F.sha2(F.concat_ws("|", "n", "_x", "_s", "_t"), 256).alias("signature"))


# ---- budgets and footprints --------------------------------------------------------

def no_lookahead(members: DataFrame, relation: DataFrame, key: str = "pan_event_id", date: str = "event_date") -> DataFrame:
    """QA-01: per event (or per event day), the latest member day against it, and whether the recomputed ids equal the relation table.

    members (key, event_date, unique_local_event_id, date); relation (key, unique_local_event_id).
    """
    late = members.groupBy(key).agg(F.max(F.datediff("date", F.col(date))).alias("max_days_after"), F.count_if(F.col("date") > F.col(date)).alias("future_rows"))
    ids = shared_counts(members.select(key, "unique_local_event_id").distinct(), relation.select(key, "unique_local_event_id").distinct(), [key], ["unique_local_event_id"])
    ok = (F.coalesce("future_rows", F.lit(0)) == 0) & (F.col("only_a") == 0) & (F.col("only_b") == 0)
    return late.join(ids, key, "full_outer").withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def budget_gate(budget: DataFrame, fractions: Sequence[str], total: str, key: str = "date") -> DataFrame:
    """QA-02: no negative amount, class sums close, fractions add to one where there is a total."""
    amounts = [c for c in budget.columns if c.startswith(("gross_", "loss_", "gain_")) and "fraction" not in c and "closure" not in c]
    negative = F.lit(False)
    for c in amounts:
        negative = negative | (F.col(c) < -1e-9)
    add = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in fractions[1:]), F.coalesce(F.col(fractions[0]), F.lit(0.0)))
    ok = (F.col(total) <= 0) | S.is_close(add, F.lit(1.0), 1e-10, 1e-8)
    return budget.select(key, negative.alias("negative_amount"), (F.col("closure_status") == "PASS").alias("closes"), ok.alias("fractions_close"))


def sums_match(cells: DataFrame, table: DataFrame, keys: Sequence[str], pairs: dict[str, Column], rtol: float = 1e-9, atol: float = 1e-6) -> DataFrame:
    """QA-03 / QA-16 / RAS-17: statistics recomputed from cells against a table, field by field, with a pass flag."""
    keys = list(keys)
    own = cells.groupBy(*keys).agg(*[c.alias(f"_c_{n}") for n, c in pairs.items()])
    j = own.join(table.select(*keys, *pairs), keys, "full_outer")
    bad = F.array_compact(F.array(*[F.when(~S.is_close(f"_c_{n}", n, rtol, atol), F.lit(n)) for n in pairs]))
    return j.select(*keys, F.concat_ws(";", bad).alias("mismatch_fields")).withColumn("status", F.when(F.col("mismatch_fields") == "", "PASS").otherwise("FAIL"))


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 0.0, atol: float = 1e-12) -> DataFrame:
    """QA-04 / QA-10: full outer comparison; numbers within tolerance, the rest exactly; the fields that differ per key."""
    kinds = {f.name: f.dataType.typeName() for f in a.schema.fields}
    l = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    r = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    same = lambda c: S.is_close(F.col(f"_a_{c}"), F.col(f"_b_{c}"), rtol, atol) if kinds[c] in ("double", "float") else F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    bad = F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in columns], F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), F.lit("missing_row"))))
    j = l.join(r, list(keys), "full_outer").select(*keys, F.concat_ws(";", bad).alias("mismatch_fields"))
    return j.withColumn("status", F.when(F.col("mismatch_fields") == "", "PASS").otherwise("FAIL"))


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """QA-05 / QA-17: one aggregate row per gate: how many rows break it."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("violations")) for n in checks]))
    return one.select(rows).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def key_coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """QA-06: missing, unexpected and doubled keys."""
    keys = list(keys)
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    n = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = e.join(n, keys, "full_outer")
    return j.agg(F.count_if(F.col("_n").isNull()).alias("missing_keys"), F.count_if(F.col("_e").isNull()).alias("unexpected_keys"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def sparse_store(cells: DataFrame, ny: int | Column, nx: int | Column, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """QA-07: doubled cells, cells outside the grid and missing values, as one row.

    Cells are first summed in blocks of 8 x 8 with a bit for each cell, which combines before the exchange; only blocks
    that hold more cells than bits are counted cell by cell.
    """
    keys = list(keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(F.col("y"), F.lit(8)) * 8 + F.pmod(F.col("x"), F.lit(8))).cast("int"))
    out = (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= ny) | (F.col("x") >= nx)
    bad = F.col("delta").isNull() | F.isnan("delta")
    placed = cells.withColumn("_by", F.floor(F.col("y") / 8)).withColumn("_bx", F.floor(F.col("x") / 8))
    block = [*keys, "_by", "_bx"]
    blocks = durable(placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0))).alias("_seen"),
                                                F.bit_count(F.coalesce(F.bit_or(F.when(out, bit)), F.lit(0))).alias("_out"), F.count_if(bad).alias("_bad")))
    crowded = F.col("_n") > F.col("_seen")
    plain = blocks.filter(~crowded).select(F.lit(0).cast("long").alias("_twice"), F.col("_out").cast("long").alias("_out"), "_bad", "_n")
    if not blocks.filter(crowded).isEmpty():
        wanted = blocks.filter(crowded).select(*[F.col(k).alias(f"_w_{k}") for k in block])
        same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in block])
        per = placed.join(shuffled(wanted), same, "left_semi").groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
        plain = plain.unionByName(per.select((F.col("_n") > 1).cast("long").alias("_twice"), F.coalesce(out, F.lit(False)).cast("long").alias("_out"), "_bad", "_n"))
    return plain.agg(F.coalesce(F.sum("_twice"), F.lit(0)).alias("duplicate_cells"), F.coalesce(F.sum("_out"), F.lit(0)).alias("outside_grid"), F.sum("_bad").alias("missing_values"), F.sum("_n").alias("cells"))


def contiguous_offsets(index: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, count: str) -> DataFrame:
    """WIN-13: objects whose start offset is not the running total of the counts before them (distributed)."""
    from . import ordered
    r = ordered.running_total(index, keys, list(order), F.col(count).cast("long"), "_before", "_total")
    return r.withColumn("contiguous", F.col(start) == F.col("_before")).drop("_before", "_total")


def grid_signature(field: DataFrame) -> DataFrame:
    """QA-08: one fingerprint of the cell coordinates per date."""
    h = F.xxhash64("y", "x")
    return field.groupBy("date").agg(F.count(F.lit(1)).alias("n_cells"), F.bit_xor(h).alias("grid_xor"), F.sum(h.cast("decimal(38,0)")).alias("grid_sum"))


def axis_order(grid: DataFrame, index: str, coord: str) -> DataFrame:
    """QA-08: is a coordinate strictly monotonic along its index?  (An axis has one row per index.)"""
    from pyspark.sql import Window as W
    a = grid.groupBy(index).agg(F.min(coord).alias("_lo"), F.max(coord).alias("_hi"))
    step = F.col("_lo") - F.lag("_lo").over(W.partitionBy(F.lit(0)).orderBy(index))
    s = a.withColumn("_s", step)
    return s.agg(F.lit(coord).alias("axis"), F.count_if(F.col("_lo") != F.col("_hi")).alias("uneven"), F.count_if(F.col("_s") > 0).alias("up"), F.count_if(F.col("_s") < 0).alias("down"), F.count_if(F.col("_s") == 0).alias("flat")).withColumn(
        "strict", (F.col("uneven") == 0) & (F.col("flat") == 0) & ((F.col("up") == 0) | (F.col("down") == 0)))


def row_number_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """60-bit number of a row from the md5 of its values as text, which any engine can recompute; missing values are ``~``."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    text = [F.coalesce(S.significant_text(c, 12) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """QA-09 / QA-11: order-free fingerprint of a table."""
    cols = list(columns or df.columns)
    h = row_number_of(df, cols)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("row_xor"), F.sum(h.cast("decimal(38,0)")).alias("row_sum"))


def group_fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """QA-15: fingerprint per group, for comparison with a stored table."""
    h = row_number_of(df, columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("row_xor"), F.sum(h.cast("decimal(38,0)")).alias("row_sum"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """QA-09: rows only in one run, counted both ways with multiplicity."""
    cols = a.columns
    n = lambda df, c: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(c))
    cond = None
    l, r = n(a, "_a"), n(b, "_b").select(*[F.col(c).alias(f"_r_{c}") for c in cols], "_b")
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    j = l.join(r, cond, "full_outer")
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)), F.lit(0))), F.lit(0))
    return j.agg(more(F.col("_a"), F.col("_b")).alias("only_first"), more(F.col("_b"), F.col("_a")).alias("only_second")).withColumn("identical", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def grid_alignment(a: DataFrame, b: DataFrame, step_m: float) -> DataFrame:
    """QA-13: same cells, largest coordinate shift under min(1000 m, 5 percent of the step), area range, geolocation distance."""
    r = b.select("y", "x", *[F.col(c).alias(f"_{c}") for c in ("x_m", "y_m", "lon", "lat", "area_km2")])
    j = a.join(r, ["y", "x"], "full_outer")
    shift = F.greatest(F.abs(F.col("x_m") - F.col("_x_m")), F.abs(F.col("y_m") - F.col("_y_m")))
    km = S.haversine_km("lon", "lat", "_lon", "_lat")
    out = j.agg(F.count_if(F.col("x_m").isNull() | F.col("_x_m").isNull()).alias("unmatched_cells"), F.max(shift).alias("max_shift_m"), F.max(km).alias("max_distance_km"), F.min("area_km2").alias("min_area"), F.max("area_km2").alias("max_area"))
    return out.withColumn("alignment_pass", (F.col("unmatched_cells") == 0) & (F.col("max_shift_m") < min(1000.0, 0.05 * step_m)))


def geolocation_delta(grid: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """QA-14: distance between two geolocations of every cell: median, p99 and maximum in metres."""
    from . import ordered
    d = grid.withColumn("metres", S.haversine_km(first[0], first[1], second[0], second[1]) * 1000.0)
    q = ordered.quantiles(d, [], "metres", {"median_m": 0.5, "p99_m": 0.99, "max_m": 1.0})
    return q
