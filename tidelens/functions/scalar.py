"""Column expressions: dates, keys, ratios, ladders, geometry on a sphere (SCA-*, FLT predicates)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from . import fixed

EARTH_KM = 6371.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers -------------------------------------------------------------

def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round for display; adding zero turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """SCA-09: null unless the denominator is positive."""
    return F.when(col(den) > 0, F.try_divide(col(num), col(den)))


def is_close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """SCA-08: |a-b| <= atol + rtol*|b|; two nulls are equal, one null is not."""
    a, b = col(a), col(b)
    both = a.isNull() & b.isNull()
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), both)


def parse_bool(c: str | Column) -> Column:
    """SCA-08: booleans that came back as text; only the word true is true."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == "true", F.lit(False))


def matches_direction(value: str | Column, expected: str | Column) -> Column:
    """SCA-10: sign test against the word positive or negative; null value fails."""
    v = col(value)
    e = F.lit(expected) if isinstance(expected, str) and expected in ("positive", "negative") else col(expected)
    return F.coalesce(F.when(e == "positive", v > 0).when(e == "negative", v < 0), F.lit(False))


def worst_status(*cols: str | Column) -> Column:
    """SCA-11: ok < degraded < reject; anything unknown counts as reject."""
    grade = [F.when(col(c) == "ok", 0).when(col(c) == "degraded", 1).otherwise(2) for c in cols]
    top = F.greatest(*grade) if len(grade) > 1 else grade[0]
    return F.when(top == 0, "ok").when(top == 1, "degraded").otherwise("reject")


def ladder(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """SCA-18: the first rule that is true gives the label; a null rule is not true."""
    out = None
    for cond, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# SCA-14 unit conversions
def m2_to_km2(c): return col(c) / 1e6
def pa_to_hpa(c): return col(c) / 100.0
def km2_to_thousand_km2(c): return col(c) / 1e3


# ---- dates ---------------------------------------------------------------

def month_numbers(value: str | Iterable[int] | None) -> tuple[int, ...]:
    """FLT-01: month label, comma list or numbers -> ordered distinct months."""
    if value is None:
        return fixed.MONTH_LABELS["annual"]
    if isinstance(value, str):
        word = value.strip().lower()
        if word in fixed.MONTH_LABELS:
            return fixed.MONTH_LABELS[word]
        value = [int(piece) for piece in word.split(",") if piece.strip()]
    months = tuple(dict.fromkeys(int(m) for m in value))
    if not months or not all(1 <= m <= 12 for m in months):
        raise ValueError(f"not a month selection: {value!r}")
    return months


def months_label(value: str | Iterable[int] | None) -> str:
    """FLT-02: stable short name of a month selection."""
    months = sorted(month_numbers(value))
    for label in ("annual", "djf", "mam", "jja", "son"):
        if sorted(fixed.MONTH_LABELS[label]) == months:
            return label
    return "m" + "-".join(f"{m:02d}" for m in months)


def in_months(date: str | Column, value) -> Column:
    return F.month(col(date)).isin(*month_numbers(value))


def month_edge(date: str | Column) -> Column:
    """FLT-04: the first day or one of the last two days of a month."""
    d = col(date)
    return (F.dayofmonth(d) == 1) | (F.dayofmonth(d) >= F.dayofmonth(F.last_day(d)) - 1)


def keep_year_range_without_leap_day(date: str | Column, first: int, last: int) -> Column:
    """FLT-03."""
    d = col(date)
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.year(d).between(first, last) & ~leap


def season_day(date: str | Column) -> Column:
    """SCA-06: day number in a fixed non-leap year; 29 February has none."""
    d = col(date)
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.when(~leap, F.dayofyear(F.make_date(F.lit(2001), F.month(d), F.dayofmonth(d))))


def half_month(date: str | Column, first_month: int = 6) -> Column:
    d = col(date)
    return (F.month(d) - first_month) * 2 + (F.dayofmonth(d) > 15).cast("int")


def day_number(date: str | Column) -> Column:
    return F.datediff(col(date), F.lit("1970-01-01").cast("date"))


# ---- keys ----------------------------------------------------------------

def significant_text(c: str | Column, digits: int = 12) -> Column:
    """Text of a number rounded to ``digits`` significant digits, without trailing zeros; an exponent below 1e-4 and from
    10 ** digits on (-0.1, 2, 1.5e-08, 3e+12).  Ties go to the even digit."""
    value = col(c).cast("double")
    parts = F.split(F.format_string("%.17e", value), "e")
    exact = F.bround(F.get(parts, F.lit(0)).try_cast("decimal(20,17)"), digits - 1)
    carried = F.abs(exact) >= 10
    mantissa = F.when(carried, F.signum(exact).cast("int").cast("string")).otherwise(exact.cast("string"))
    power = F.get(parts, F.lit(1)).try_cast("int") + F.when(carried, 1).otherwise(0)
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    plain = trim(F.concat_ws("e", mantissa, power.cast("string")).try_cast("decimal(38,20)").cast("string"))
    scientific = F.concat(trim(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(power)))
    text = F.when((power < -4) | (power >= digits), scientific).otherwise(plain)
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).when(value == 0, "0").otherwise(text)


def threshold_text(c: str | Column) -> Column:
    """Text of a threshold in a key: six significant digits (-0.1, 0.25, 2)."""
    return significant_text(c, 6)


def patch_key(object_id="object_id", date="date", start="start_date", window="window_days", threshold="threshold") -> Column:
    """SCA-07: id|date|start|window|threshold."""
    return F.concat_ws(
        "|", col(object_id), F.date_format(col(date), "yyyy-MM-dd"), F.date_format(col(start), "yyyy-MM-dd"),
        col(window).cast("int").cast("string"), threshold_text(threshold),
    )


def numbered_id(prefix: str, number: str | Column, width: int) -> Column:
    n = col(number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0")))


def key_seed(base: int, *parts: str | Column) -> Column:
    """SCA-15: 32-bit seed from a base and key columns, the same on every partitioning."""
    text = F.concat_ws("|", F.lit(str(base)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def join_list(c: str | Column) -> Column:
    """SCA-16."""
    return F.concat_ws(";", col(c))


def split_list(c: str | Column) -> Column:
    return F.filter(F.split(col(c), ";"), lambda x: x != "")


def first_pair(options: Sequence[tuple[str, str, str]]) -> tuple[Column, Column, Column]:
    """SCA-12: first (label, lon, lat) whose two coordinates are both present."""
    pick = F.coalesce(*[
        F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(),
               F.struct(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.lit(label).alias("how")))
        for label, lon, lat in options
    ])
    return pick["lon"], pick["lat"], F.coalesce(pick["how"], F.lit("missing"))


# ---- sphere --------------------------------------------------------------

def lon180(lon: str | Column) -> Column:
    """SCA-02: [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    """SCA-01: great-circle distance; null in, null out."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp = F.radians(col(lat2) - col(lat1)) / 2
    dl = F.radians(col(lon2) - col(lon1)) / 2
    h = F.pow(F.sin(dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def in_box(lon, lat, lon_min, lon_max, lat_min, lat_max) -> Column:
    """FLT-06: longitude/latitude box that may cross the date line."""
    as_col = lambda v: v if isinstance(v, Column) else (F.col(v) if isinstance(v, str) else F.lit(float(v)))
    lo_raw, hi_raw = as_col(lon_min), as_col(lon_max)
    x, lo, hi = (F.pmod(c, F.lit(360.0)) for c in (col(lon), lo_raw, hi_raw))
    inside = F.when(F.abs(hi_raw - lo_raw) >= 360.0, F.lit(True)).when(lo <= hi, (x >= lo) & (x <= hi)).otherwise((x >= lo) | (x <= hi))
    return inside & (col(lat) >= as_col(lat_min)) & (col(lat) <= as_col(lat_max))


def unwrapped_longitude(lon, arc_start) -> Column:
    """SCA-04: longitude on the branch that starts after the largest gap."""
    x = F.pmod(col(lon), F.lit(360.0))
    return F.when(x < col(arc_start) - 1e-12, x + 360.0).otherwise(x)


def rotate_wind(u, v, east, north) -> dict[str, Column]:
    """SCA-13: parts of a wind along and across a unit normal."""
    u, v, e, n = col(u), col(v), col(east), col(north)
    normal = u * e + v * n
    tangent = -u * n + v * e
    return {"normal": normal, "tangential": tangent, "abs_normal": F.abs(normal),
            "abs_tangential": F.abs(tangent), "speed": F.hypot(u, v)}
