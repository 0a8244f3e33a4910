"""Links made first come, first served, without going through the rows one by one.

Rows come in a given order; each takes the nearest earlier row that nobody before it has taken, or none.  That is a stable
matching in which the takers rank what they may take by distance and everything taken prefers the earliest taker.  Deferred
acceptance finds it with proposals in any order: every row asks for its best candidate, a candidate keeps the earliest
that asked, and whoever is turned down, now or later, asks for its next.  The result does not depend on when questions are asked.

So the candidates are dealt to blocks by place and time.  A task settles all questions inside its block, one after the other; a row
whose next candidate lives in another block goes there in the next round.  Rounds take turns with ``GRIDS`` divisions into blocks, each
shifted by a third of a block against the one before: where two of them have a border, the third has none, so
no row goes back and forth between neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from . import graph


GRIDS = ("grid0", "grid1", "grid2")


def candidate_lists(pairs: DataFrame) -> DataFrame:
    """(p, candidates) from (p, q, cost, tie, GRIDS): candidates by cost, then ``tie``, then q, as many as lie within reach of p."""
    each = F.struct("cost", "tie", "q", *GRIDS)
    return pairs.groupBy("p").agg(F.array_sort(F.collect_list(each)).alias("candidates"))


def settle(lists: DataFrame) -> DataFrame:
    """(p, at): place in its list of the candidate that each row gets; rows that get none are left out."""
    names = ("q", *GRIDS)
    state = lists.select("p", *[F.col("candidates")[n].alias(n) for n in names], F.lit(0).alias("at"))
    turn = 0
    schema = ", ".join(["p long", *[f"{n} array<long>" for n in names], "at int, away boolean"])
    while True:
        grid = GRIDS[turn % len(GRIDS)]
        state = durable(state.withColumn("home", F.element_at(grid, F.col("at") + 1)).groupBy("home").applyInArrow(_block(grid), schema))
        if state.filter("away").isEmpty():
            return state.select("p", "at")
        state, turn = state.drop("away"), turn + 1


def _block(grid: str) -> Callable[[pa.Table], pa.Table]:
    kept = pa.schema([("p", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("q", *GRIDS)], ("at", pa.int32()), ("away", pa.bool_())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("p").combine_chunks()  # the earliest ask first, so few are turned down later
        here, p, at = rows.column("home")[0].as_py(), rows.column("p").to_pylist(), rows.column("at").to_pylist()
        q, home = rows.column("q").to_pylist(), rows.column(grid).to_pylist()
        away, holder = [False] * len(p), {}
        for i in range(len(p)):
            while at[i] < len(q[i]):
                k = at[i]
                if home[i][k] != here:
                    away[i] = True
                    break
                j = holder.get(q[i][k])
                if j is None or p[i] < p[j]:
                    holder[q[i][k]] = i
                    if j is None:
                        break
                    i = j
                at[i] += 1
        out = rows.select(["p", "q", *GRIDS]).append_column("at", pa.array(at, pa.int32())).append_column("away", pa.array(away, pa.bool_()))
        return out.filter(pa.array([a < len(c) for a, c in zip(at, q)], pa.bool_())).cast(kept)

    return run


def first_come(pairs: DataFrame) -> DataFrame:
    """(p, q, cost, head) of every row ``p`` that takes a row ``q`` of (p, q, cost, GRIDS), p in ascending order.

    ``head`` is the first row of the chain of takings.  Of candidates at equal cost the one with the first head goes first.
    Heads are a result themselves, so candidates at equal cost are first ordered by q; if the heads that come out contradict
    an order that mattered, the ranking is corrected and the matching made again.  The earliest wrong choice is right
    afterwards, so this ends; where no two costs are equal it ends at once.
    """
    lists = durable(candidate_lists(pairs.withColumn("tie", F.col("q"))))
    while True:
        found = settle(lists).join(lists, "p").withColumn("got", F.element_at("candidates", F.col("at") + 1))
        links = durable(found.select("p", F.col("got.q").alias("q"), F.col("got.cost").alias("cost"),
                                     F.transform(F.filter("candidates", lambda c: (c["cost"] == F.col("got.cost")) & (c["q"] != F.col("got.q"))), lambda c: c["q"]).alias("equal")))
        heads = graph.chain_heads(links, "p", "q")
        rivals = links.select("p", "q", F.explode("equal").alias("other"))
        head = lambda c: heads.select(F.col("p").alias(c), F.col("head").alias(f"head_{c}"))
        taken = links.select(F.col("q").alias("other"), F.col("p").alias("by"))
        open_ = rivals.join(taken, "other", "left").filter("by is null or by > p").join(head("q"), "q", "left").join(head("other"), "other", "left")
        if open_.filter(F.coalesce("head_other", "other") < F.coalesce("head_q", "q")).isEmpty():
            return links.select("p", "q", "cost").join(heads, "p")
        again = lists.select("p", F.inline("candidates")).drop("tie").join(head("q"), "q", "left").withColumn("tie", F.coalesce("head_q", "q"))
        lists = durable(candidate_lists(again))


def block_of(keys: Sequence, day, cell: Callable[[float], Sequence], days: int) -> tuple:
    """Blocks of a row in every grid: ``keys``, a span of ``days`` days and a cell, shifted by an equal part of a block from grid to grid."""
    return tuple(F.xxhash64(*keys, F.floor(day / days + n / len(GRIDS)), *cell(n / len(GRIDS))).alias(name) for n, name in enumerate(GRIDS))
