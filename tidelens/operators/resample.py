"""Resampling statistics on grouped differences: bootstrap, sign flip, year blocks, false discovery, least squares.

Draws are hashes of (seed, group, replicate, block), so results are the same for any
partitioning.  Work is spread over (group, replicate); the units of a group lie in pages of a
fixed size, and a task deals its draws beside the pages it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S, stats as ST
from ..session import shuffle_width, shuffled
from . import ordered

#: Units on a page.
PAGE = 1024
#: Pages on a shelf: what one task holds of a group (32 MB of values).
SHELF = 4096
#: Draws that one task deals for a group of one shelf.
DEALT = 2**26
#: Blocks of draws that one row lists, or a task deals, at a time, so that no array grows in step with a group.
STRIDE = 16_384


def _replicates(groups: DataFrame, reps: int, slots: Column) -> DataFrame:
    """Rows (group, rep, block) with four draws each; replicates are dealt to tasks in chunks first."""
    n = shuffle_width(groups)
    chunks = min(reps, 4 * n)
    spread = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(n, "_chunk")
    rep = spread.withColumn("rep", F.explode(F.filter(F.sequence(F.col("_chunk"), F.lit(reps - 1), F.lit(chunks)), lambda v: v < reps)))
    last = F.floor((slots - 1) / 4).cast("int")
    strides = rep.withColumn("_from", F.explode(F.sequence(F.lit(0), last, F.lit(STRIDE))))
    return strides.withColumn("_block", F.explode(F.sequence("_from", F.least(F.col("_from") + (STRIDE - 1), last)))).drop("_chunk", "_from")


def _text(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).cast("string") for k in keys]


def _picked(text: bytes, n: int, first: int, values: np.ndarray, weights: np.ndarray | None, lo: int, hi: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values and weights over the draws of replicates lo to hi - 1 that fall on the units from ``first`` on."""
    sums, counts = np.zeros(hi - lo), np.zeros(hi - lo)
    blocks = (n + 3) // 4
    whole = len(values) == n
    for r0, r1, rw in ST.by_width(lo, hi):
        for b0, b1, bw in ST.by_width(0, blocks):
            span = b1 - b0
            for t0 in range(0, (r1 - r0) * span, stride):
                t = np.arange(t0, min(t0 + stride, (r1 - r0) * span))
                rep = t // span + r0
                block = t - (rep - r0) * span + b0
                words = ST.md5_words([text, ST.decimal_bytes(rep, rw), b"|", ST.decimal_bytes(block, bw)])
                at = (ST.md5_draws(words, len(t)) % n).astype(np.int64) - first
                rep = np.broadcast_to(rep - lo, at.shape)
                if not whole or (b1 == blocks and n % 4):
                    keep = (block * 4 + np.arange(4)[:, None] < n) & (at >= 0) & (at < len(values))
                    at, rep = at[keep], rep[keep]
                at, rep = at.ravel(), rep.ravel()
                sums += np.bincount(rep, values[at], hi - lo)
                counts += np.bincount(rep, None if weights is None else weights[at], hi - lo)
    return sums, counts


def resampled_means(df: DataFrame, keys: Sequence[str], value: str, unit: str, reps: int, seed: int, weight: str | None = None, page: int = PAGE) -> DataFrame:
    """Replicate means (keys, rep, mean): as many units drawn with replacement as the group has.

    With ``weight`` a unit is a block: its value and weight are sums, and a replicate mean
    is the ratio of their totals.  Units are numbered in order and laid in pages; a task holds
    a shelf of pages, deals some replicates and adds up the draws that fall on its shelf, so
    no draw is exchanged.  Only a group larger than a shelf has its draws dealt more than once.
    """
    keys, stride = list(keys), STRIDE
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(unit).cast("string").alias("_u"), F.col(value).cast("double").alias("_v"), w.alias("_w"))
    at = F.col("_i") - 1
    numbered = ordered.row_numbers(rows, keys, ["_u"], "_i").select(*keys, F.floor(at / page).alias("_page"), at.alias("_at"), "_v", *(["_w"] if weight else []))
    fields = ["_v", "_w"] if weight else ["_v"]
    laid = F.array_sort(F.collect_list(F.struct("_at", *fields)))
    pages = numbered.groupBy(*keys, "_page").agg(laid.alias("_a")).select(*keys, F.floor(F.col("_page") / SHELF).alias("_shelf"), "_page", *[F.col("_a")[f].alias(f) for f in fields])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = F.greatest(F.lit(1), F.least(F.lit(reps), F.floor(F.lit(DEALT) / F.col("_n")))).cast("int")
    shelves = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / (page * SHELF))))
    jobs = sizes.withColumn("_shelf", shelves).withColumn("_each", each).withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.col("_each"))))
    jobs = jobs.withColumn("_to", F.least(F.col("_from") + F.col("_each"), F.lit(reps))).withColumn("_text", F.concat_ws("|", F.lit(str(seed)), *_text(keys), F.lit(""))).drop("_each")
    job = [*keys, "_shelf", "_from"]
    dealt = pages.join(jobs, [*keys, "_shelf"]).repartition(shuffle_width(df), *job).sortWithinPartitions(*job, "_page")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    size = page * SHELF

    def run(batches):
        now, parts, head = None, [], None

        def out():
            cols = [np.concatenate([p[i] for p in parts]) for i in range(len(fields))]
            lo, hi = head["_from"], head["_to"]
            sums, counts = _picked(head["_text"].encode(), head["_n"], head["_shelf"] * size, cols[0], cols[1] if weight else None, lo, hi, stride)
            return pa.RecordBatch.from_arrays([pa.array([head[k]] * (hi - lo), kinds[k]) for k in keys] + [pa.array(np.arange(lo, hi), pa.int32()), pa.array(sums), pa.array(counts)], names)

        names = [*keys, "rep", "_s", "_c"]
        for batch in batches:
            kinds = {k: batch.schema.field(k).type for k in keys}
            heads = batch.select([*job, "_n", "_to", "_text"]).to_pylist()
            lists = [batch.column(batch.schema.get_field_index(f)) for f in fields]
            for i, h in enumerate(heads):
                mine = tuple(h[c] for c in job)
                if now is not None and mine != now:
                    yield out()
                    parts = []
                now, head = mine, h
                parts.append([c[i].values.to_numpy(zero_copy_only=False) for c in lists])
        if now is not None:
            yield out()

    met = dealt.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "rep int", "_s double", "_c double"]))
    return met.groupBy(*keys, "rep").agg((F.sum("_s") / F.sum("_c")).alias("mean"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, unit: str, reps: int, seed: int, min_units: int = 1, **kw) -> DataFrame:
    """STA-02: 2.5 and 97.5 percentiles of the replicate means (a group holds ``reps`` rows)."""
    keys = list(keys)
    m = resampled_means(df, keys, value, unit, reps, seed, **kw)
    q = m.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("_n") >= min_units
    return q.join(n, keys).select(*keys, F.when(ok, F.col("_q")[0]).alias("ci_low"), F.when(ok, F.col("_q")[1]).alias("ci_high"))


def bootstrap_ci_of_difference(df: DataFrame, keys: Sequence[str], side: str, value: str, unit: str, reps: int, seed: int) -> DataFrame:
    """STA-02: interval of mean(a) - mean(b), both sides resampled on their own."""
    keys = list(keys)
    m = resampled_means(df, [*keys, side], value, unit, reps, seed)
    d = m.groupBy(*keys, "rep").agg((F.max(F.when(F.col(side) == "a", F.col("mean"))) - F.max(F.when(F.col(side) == "b", F.col("mean")))).alias("_d"))
    return d.groupBy(*keys).agg(F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def sign_flip_means(df: DataFrame, keys: Sequence[str], value: str, unit: str, reps: int, seed: int) -> DataFrame:
    """Means under random signs (keys, rep, mean).  The sign belongs to the unit, so nothing but partial sums is exchanged."""
    keys = list(keys)
    text = F.concat_ws("|", F.lit(str(seed)), *_text(keys), F.lit("s"), F.col(unit).cast("string"), F.lit("")).cast("binary")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), text.alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    blocks = (reps - 1) // 4 + 1

    def run(batches):
        sums, counts = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):  # null is a key like any other
                index = batch.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                code = np.unique(code * (batch.num_rows + 1) + index, return_inverse=True)[1]
            groups, first = np.unique(code, return_index=True)
            values, texts = batch.column(len(keys)).to_numpy(zero_copy_only=False), batch.column(len(keys) + 1)
            long = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            total = np.zeros((len(groups), blocks * 4))
            for n in np.unique(long):
                mine = np.flatnonzero(long == n)
                joined = b"".join(texts.take(pa.array(mine)).to_pylist())
                matrix = np.frombuffer(joined, np.uint8).reshape(len(mine), n)
                for b0, b1, width in ST.by_width(0, blocks):
                    packed = ST.md5_words([matrix, bytes(width)])
                    for b in range(b0, b1):
                        words = list(packed)
                        for i, digit in enumerate(str(b).encode(), n):
                            put = digit << 8 * (i % 4)
                            words[i // 4] = words[i // 4] + (put if isinstance(words[i // 4], int) else np.uint32(put))
                        signs = (ST.md5_draws(words, len(mine)) & 1).astype(np.float64) * 2 - 1
                        for p in range(4):
                            total[:, b * 4 + p] += np.bincount(code[mine], signs[p] * values[mine], len(groups))
            keyed = batch.select(keys).take(pa.array(first)).to_pylist() if keys else [{}]
            for g, n, s in zip(keyed, np.bincount(code, minlength=len(groups)), total):
                g = tuple(g[k] for k in keys)
                sums[g], counts[g] = sums.get(g, 0.0) + s, counts.get(g, 0) + int(n)
            if len(sums) > 1000:  # many groups: hand them on
                yield from given(sums, counts, kinds)
                sums, counts = {}, {}
        if sums:
            yield from given(sums, counts, kinds)

    def given(sums, counts, kinds):
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * reps, t) for v, t in zip(g, kinds)] + [pa.array(np.arange(reps), pa.int32()), pa.array(s[:reps]), pa.array(np.full(reps, counts[g]))], [*keys, "rep", "_s", "_n"])

    met = rows.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "rep int", "_s double", "_n bigint"]))
    return met.groupBy(*keys, "rep").agg((F.sum("_s") / F.sum("_n")).alias("mean"))


def sign_flip_p(df: DataFrame, keys: Sequence[str], value: str, unit: str, reps: int, seed: int, alternative: str | Column = "two-sided") -> DataFrame:
    """STA-03: (b + 1) / (B + 1), with a hair of tolerance so that equal means count as equal."""
    keys = list(keys)
    alt = F.lit(alternative) if isinstance(alternative, str) else alternative
    obs = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_obs"))
    m = sign_flip_means(df, keys, value, unit, reps, seed).join(obs, keys)
    hit = (F.when(alt == "greater", F.col("mean") >= F.col("_obs") - 1e-12).when(alt == "less", F.col("mean") <= F.col("_obs") + 1e-12)
           .otherwise(F.abs("mean") >= F.abs("_obs") - 1e-12))
    return m.groupBy(*keys).agg(((F.count_if(hit) + 1) / F.lit(reps + 1)).alias("p_raw"), F.avg((F.col("mean") < F.col("_obs") - 1e-12).cast("int")).alias("effect_percentile"))


def year_block_ci(df: DataFrame, keys: Sequence[str], value: str, year: str, reps: int, seed: int) -> DataFrame:
    """STA-04: interval of the mean when whole years are drawn.  Years are summed first, so a replicate handles years, not events."""
    keys = list(keys)
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, year).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    m = resampled_means(per, keys, "_s", year, reps, seed, weight="_c")
    q = m.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.count("mean").alias("n_bootstrap_valid"))
    head = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_years"), F.sum("_c").alias("n_events"), (F.sum("_s") / F.sum("_c")).alias("primary_mean"))
    return head.join(q, keys).select(*keys, "n_events", "n_years", "primary_mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "n_bootstrap_valid")


def confirmation(df: DataFrame) -> DataFrame:
    """STA-05: does the year-block interval confirm the primary direction?"""
    m, lo, hi = F.col("primary_mean"), F.col("ci_low"), F.col("ci_high")
    pd_ = S.ladder([(m.isNull(), "nonfinite"), (m > 0, "positive"), (m < 0, "negative")], "zero")
    cd = S.ladder([(lo.isNull() | hi.isNull(), "nonfinite"), (lo > hi, "invalid"), (lo > 0, "positive"), (hi < 0, "negative")], "crosses_zero")
    out = df.withColumn("primary_direction", pd_).withColumn("ci_direction", cd)
    short = "supported_but_year_block_confirmation_insufficient"
    p, c = F.col("primary_direction"), F.col("ci_direction")
    # fixed values: (condition, status, reason), first match wins
    steps = [
        (F.col("n_years") < 2, short, "fewer_than_two_year_blocks"),
        (F.col("n_bootstrap_valid") <= 0, short, "no_valid_year_block_bootstrap_resamples"),
        (p == "nonfinite", short, "primary_direction_nonfinite"),
        (p == "zero", short, "primary_direction_zero"),
        (c == "nonfinite", short, "year_block_ci_nonfinite"),
        (c == "invalid", short, "year_block_ci_invalid"),
        (c == "crosses_zero", "supported_but_not_year_block_confirmed", "year_block_ci_crosses_zero"),
        (c != p, "supported_but_year_block_direction_conflict", "year_block_ci_opposes_primary_direction"),
    ]
    out = out.withColumn("final_interpretation_status", S.ladder([(x, s) for x, s, _ in steps], "supported_year_block_confirmed"))
    out = out.withColumn("confirmation_reason", S.ladder([(x, r) for x, _, r in steps], "ci_excludes_zero_and_matches_primary_direction"))
    done = F.col("final_interpretation_status") == "supported_year_block_confirmed"
    return (out.withColumn("direction_consistent_with_primary", p.isin("positive", "negative") & (c == p)).withColumn("ci_excludes_zero", c.isin("positive", "negative"))
            .withColumn("year_block_confirmed", done).withColumn("interpretation_downgraded", ~done))


def one_sample(df: DataFrame, keys: Sequence[str], value: str, unit: str | None = None, reps: int = 0, seed: int = 0) -> DataFrame:
    """STA-01: units, mean, mean/sd, t-test p and, with ``reps``, the bootstrap interval."""
    keys = list(keys)
    a = df.groupBy(*keys).agg(F.count(value).alias("n_units"), F.avg(value).alias("mean_difference"), F.stddev_samp(value).alias("_sd"))
    ok = (F.col("n_units") >= 2) & (F.col("_sd") > 0)
    std = F.when(ok, F.col("mean_difference") / F.col("_sd"))
    a = a.withColumn("standardized_mean_difference_zero", std)
    a = a.withColumn("p_raw", F.when(ok, ST.student_t_p(std * F.sqrt("n_units"), (F.col("n_units") - 1).cast("double")))).drop("_sd")
    return a.join(bootstrap_ci(df, keys, value, unit, reps, seed, min_units=2), keys, "left") if reps else a


def effect_sizes(df: DataFrame, keys: Sequence[str], side: str, value: str) -> DataFrame:
    """STA-08: pooled Cohen d and Welch p between sides a and b."""
    keys = list(keys)
    s = lambda f, k: f(F.when(F.col(side) == k, F.col(value)))
    g = df.groupBy(*keys).agg(*[s(f, k).alias(f"{n}_{k}") for k in "ab" for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("v_a"), F.col("v_b")
    enough = (na >= 2) & (nb >= 2)
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    se = va / na + vb / nb
    dof = F.try_divide(F.pow(se, 2), F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1))
    return g.select(*keys, "n_a", "n_b", F.when(enough & (pooled > 0), (F.col("m_a") - F.col("m_b")) / pooled).alias("cohen_d"),
                    F.when(enough & (se > 0), ST.student_t_p((F.col("m_a") - F.col("m_b")) / F.sqrt(se), dof)).alias("welch_p"))


def fdr_bh(df: DataFrame, family: Sequence[str], p: str = "p_raw", out: str = "p_fdr") -> DataFrame:
    """WIN-11 for a table of tests: a family is bounded by the analysis design (regions x variables x settings).

    Null p values stay null.  Use :func:`fdr_bh_large` when a family can grow with the data.
    """
    fam = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    m = F.count(p).over(fam)
    r = F.rank().over(fam.orderBy(F.col(p).asc_nulls_last())) + F.count(F.lit(1)).over((W.partitionBy(*family, p) if family else W.partitionBy(p))) - 1
    a = df.withColumn("_adj", F.when(F.col(p).isNotNull(), F.col(p) * m / r))
    low = F.min("_adj").over(fam.orderBy(F.col(p).asc_nulls_last()).rangeBetween(W.currentRow, W.unboundedFollowing))
    return a.withColumn(out, F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("_adj")


def fdr_bh_large(df: DataFrame, family: Sequence[str], p: str = "p_raw", out: str = "p_fdr") -> DataFrame:
    """WIN-11 with distributed ranks and a distributed suffix minimum over distinct p values."""
    family = list(family)
    t = ordered.value_ranks(df, family, p)
    t = t.select(*family, p, (F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n_equal"))).alias("_adj"))
    t = ordered.suffix_min(t, family, [F.col(p)], "_adj", out).select(*family, p, F.least(F.col(out), F.lit(1.0)).alias(out))
    return df.join(t, [*family, p], "left")


def event_minus_background(df: DataFrame, keys: Sequence[str], event: str, variables: Sequence[str], event_lags: Sequence[int], background_lags: Sequence[int], lag: str = "lag") -> DataFrame:
    """AGG-35: per event and variable, mean over the event lags minus mean over the background lags.

    Variables become rows first, so one grouped pass serves all of them.
    """
    flat = df.select(*keys, event, lag, F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("_v")) for v in variables])))
    ev, bg = F.when(F.col(lag).isin(*event_lags), F.col("_v")), F.when(F.col(lag).isin(*background_lags), F.col("_v"))
    a = flat.groupBy(*keys, event, "variable").agg(F.avg(ev).alias("event_mean"), F.avg(bg).alias("background_mean"), F.count(ev).alias("event_observations"), F.count(bg).alias("background_observations"))
    return a.withColumn("difference", F.col("event_mean") - F.col("background_mean"))


# ---- least squares --------------------------------------------------------------

def _products(y: str, xs: Sequence[str]) -> tuple[list[str], list[Column]]:
    """Sums that determine the normal equations: upper triangle of X'X, then X'y, with a leading 1."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    names, exprs = [], []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            names.append(f"_x{i}_{j}"); exprs.append(cols[i] * cols[j])
    for i in range(len(cols)):
        names.append(f"_y{i}"); exprs.append(cols[i] * F.col(y))
    return names, exprs


def _solve(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(pdf)
    xtx, xty = np.empty((n, p, p)), np.empty((n, p))
    for i in range(p):
        xty[:, i] = pdf[f"_y{i}"]
        for j in range(i, p):
            xtx[:, i, j] = xtx[:, j, i] = pdf[f"_x{i}_{j}"]
    values = np.linalg.eigvalsh(xtx) if n else np.empty((0, p))
    top = values[:, -1:] if n else values
    rank = (values > np.maximum(top, 0) * p * 1e-13).sum(axis=1)
    cond = np.sqrt(np.where(values[:, 0] > 0, values[:, -1] / np.where(values[:, 0] > 0, values[:, 0], 1), np.inf)) if n else np.empty(0)
    beta = np.full((n, p), np.nan)
    full = rank == p
    if full.any():
        beta[full] = np.linalg.solve(xtx[full], xty[full][..., None])[..., 0]
    return beta, rank, cond


def complete_rows(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    cond = F.col(y).isNotNull()
    for x in xs:
        cond = cond & F.col(x).isNotNull()
    return df.filter(cond)


def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """STA-10: coefficients (intercept first), rank and condition number.  Rows meet only as sums; the small system is solved per group."""
    keys, p = list(keys), len(xs) + 1
    names, exprs = _products(y, xs)
    g = complete_rows(df, y, xs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"), *[F.sum(e).alias(n) for n, e in zip(names, exprs)])
    types = {f.name: f.dataType.simpleString() for f in g.schema.fields}

    def run(batches):
        for pdf in batches:
            beta, rank, cond = _solve(pdf, p)
            out = pdf[[*keys, "n_cases"]].copy()
            out["beta"], out["matrix_rank"], out["condition_number"] = list(beta), rank, cond
            yield out

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "n_cases bigint", "beta array<double>", "matrix_rank int", "condition_number double"])
    return g.mapInPandas(run, schema)


def year_block_intercept(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], year: str, reps: int, seed: int) -> DataFrame:
    """STA-11: bootstrap of the intercept over year blocks; each replicate adds weighted yearly sums and solves a small system."""
    keys, p = list(keys), len(xs) + 1
    names, exprs = _products(y, xs)
    per = complete_rows(df, y, xs).groupBy(*keys, year).agg(*[F.sum(e).alias(n) for n, e in zip(names, exprs)])
    o = W.partitionBy(*keys).orderBy(year) if keys else W.partitionBy(F.lit(0)).orderBy(year)
    per = per.withColumn("_i", F.row_number().over(o) - 1)
    sizes = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = _replicates(sizes, reps, F.col("_n")).withColumn("_h", ST.draw_block(seed, *_text(keys), F.col("rep"), F.col("_block")))
    each = F.array_compact(F.array(*[F.when(F.col("_block") * 4 + q < F.col("_n"), (ST.u32(F.col("_h"), q) % F.col("_n")).cast("int")) for q in range(4)]))
    weights = d.select(*keys, "rep", F.explode(each).alias("_i")).groupBy(*keys, "rep", "_i").agg(F.count(F.lit(1)).alias("_w"))
    sums = weights.join(per, [*keys, "_i"]).groupBy(*keys, "rep").agg(*[F.sum(F.col("_w") * F.col(n)).alias(n) for n in names])
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}

    def run(batches):
        for pdf in batches:
            beta, *_ = _solve(pdf, p)
            out = pdf[[*keys, "rep"]].copy()
            out["intercept"] = beta[:, 0]
            yield out

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "rep int", "intercept double"])
    r = sums.mapInPandas(run, schema).withColumn("intercept", S.nan_to_null("intercept"))
    q = r.groupBy(*keys) if keys else r
    return q.agg(F.avg("intercept").alias("bootstrap_mean"), F.percentile("intercept", F.array(*[F.lit(v) for v in (0.5, 0.025, 0.975)])).alias("_q"), F.count("intercept").alias("n_bootstrap_valid")).select(
        *keys, "bootstrap_mean", F.col("_q")[0].alias("bootstrap_median"), F.col("_q")[1].alias("ci_low"), F.col("_q")[2].alias("ci_high"), "n_bootstrap_valid")
