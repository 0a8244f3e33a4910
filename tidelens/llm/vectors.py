"""Near-duplicate vectors by a subspace pigeonhole join (operator 4).

Unit vectors with cosine c lie at squared distance 2 - 2c.  After a fixed rotation the coordinates are cut into blocks of a
few dimensions, and every block gets a share of the squared distance in proportion to its dimensions.  If a pair exceeded
its share in every block, it would exceed the whole, so each wanted pair is within budget in at least one block.

Each block is range-joined by a grid over its leading dimensions: a vector is at home in one cell and a guest of the later
cells that its budget reaches.  Cells are cut into tiles of a bounded number of vectors, so a hot cell becomes many tasks.  A
tile screens its pairs by the block's coordinates, verifies the rest by the exact cosine, and counts a pair only in the first
block that holds it.  What leaves a tile is a count and one tree edge per vector, never the pairs.  Equal vectors are joined
as one with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .common import Forest, staged

#: Room for rounding in screens; the last word has the exact cosine.
SLACK = 1e-9
SCREEN = 1e-5
STEP = 1024


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_011).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks(size: int, wide: int) -> list[slice]:
    return [slice(i, min(i + wide, size)) for i in range(0, size, wide)]


def budget(cut: slice, size: int, least: float) -> float:
    return (2 - 2 * least) * (cut.stop - cut.start) / size + SLACK


def turned(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1])


def _cells(least: float, wide: int, grid: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                y = turned(rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                for number, cut in enumerate(blocks(int(size), wide)):
                    radius = np.sqrt(budget(cut, size, least))
                    side, dims = 2 * radius, min(grid, cut.stop - cut.start)
                    x = y[:, cut][:, :dims]
                    home = np.floor(x / side).astype(np.int64)
                    for step in product((-1, 0, 1), repeat=dims):
                        if step < (0,) * dims:
                            continue
                        gap = np.where(np.array(step) > 0, (home + 1) * side - x, np.where(np.array(step) < 0, x - home * side, 0.0))
                        at = np.flatnonzero((gap**2).sum(1) <= radius**2 + SLACK)
                        cell = home[at] + np.array(step)
                        out = {"size": pa.array(np.full(len(at), size), pa.int32()), "block": pa.array(np.full(len(at), number), pa.int32()), "cell": pa.array([",".join(map(str, c)) for c in cell.tolist()], pa.string()),
                               "guest": pa.array(np.full(len(at), any(step)), pa.bool_())}
                        if full:
                            chosen = rows.take(pa.array(at))
                            out |= {k: chosen.column(k) for k in ("node", "copies", "vector")}
                        yield pa.record_batch(out)

    return run


def _tile(least: float, wide: int):
    def run(rows: pa.Table) -> pa.Table:
        size, number = rows.column("size")[0].as_py(), rows.column("block")[0].as_py()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        raw = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
        norm = np.linalg.norm(raw, axis=1)
        y, cuts = turned(raw), blocks(size, wide)
        shares = [budget(c, size, least) for c in cuts]
        cut, limit = cuts[number], shares[number] + SCREEN
        near = np.ascontiguousarray(y[:, cut], dtype=np.float32)
        square = (near**2).sum(1)
        left, diagonal = rows.column("left").to_numpy(zero_copy_only=False), rows.column("diagonal")[0].as_py()
        ones, others = np.flatnonzero(left), np.flatnonzero(~left)
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))

        def compare(a: np.ndarray, b: np.ndarray, upper: bool) -> None:
            close = square[a][:, None] + square[b][None, :] - 2 * near[a] @ near[b].T <= limit
            i, j = np.nonzero(np.triu(close, 1) if upper else close)
            for at in range(0, len(i), 1 << 17):
                p, q = a[i[at : at + (1 << 17)]], b[j[at : at + (1 << 17)]]
                cosine = (raw[p] * raw[q]).sum(1) / (norm[p] * norm[q])
                good = cosine >= least
                p, q = p[good], q[good]
                apart = (y[p] - y[q]) ** 2
                counts = apart[:, cut].sum(1) <= shares[number]
                for c, share in zip(cuts[:number], shares):
                    counts &= apart[:, c].sum(1) > share
                p, q = p[counts], q[counts]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                forest.add(p, q)

        for s in range(0, len(ones), STEP):
            a = ones[s : s + STEP]
            if diagonal:
                compare(a, a, True)
                for t in range(s + STEP, len(ones), STEP):
                    compare(a, ones[t : t + STEP], False)
            for t in range(0, len(others), STEP):
                compare(a, others[t : t + STEP], False)
        said = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[said]), "links": pa.array(links[said]), "root": pa.array(node[forest.root[said]])})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, wide: int = 8, grid: int = 2, tile: int = 20_000) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links are pairs of rows with cosine >= ``least``.

    Null, zero and empty vectors and those with null or non-finite components link with nothing and are their own component.
    Vectors of different length never link.  Repeated rows are vectors of their own; null keys are ignored when the smallest
    key of a component is sought (null if all are null).  An empty table gives an empty one; other columns are not read.

    ``wide``: dimensions of a block; ``grid``: of these, how many the cells use; ``tile``: most vectors on a side of a task.
    """
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), v.alias("vector"))
    usable = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    nodes = staged(good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    base = nodes.select("node", "copies", "vector")
    kind = base.schema["vector"].dataType.simpleString()
    # one row per occupied cell: at most (2 / side + 1) ** grid cells a block, as coordinates lie in -1..1
    counts = base.select("vector").mapInArrow(_cells(least, wide, grid, False), "size int, block int, cell string, guest boolean").groupBy("size", "block", "cell").agg(F.count(F.lit(1)).alias("n"))
    tiles = counts.select("size", "block", "cell", F.ceil(F.col("n") / tile).alias("parts"))
    dealt = base.mapInArrow(_cells(least, wide, grid, True), f"size int, block int, cell string, guest boolean, node long, copies long, vector {kind}").join(F.broadcast(tiles), ["size", "block", "cell"])
    part = F.pmod(F.xxhash64("node"), "parts")
    own = F.when(F.col("guest"), F.array().cast("array<struct<a:bigint,b:bigint,left:boolean>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.struct(part.alias("a"), b.alias("b"), F.lit(True).alias("left"))))
    theirs = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda a: F.struct(a.alias("a"), part.alias("b"), F.lit(False).alias("left"))), lambda t: F.col("guest") | (t["a"] < t["b"]))
    spread = dealt.select("size", "block", "cell", "node", "copies", "vector", F.explode(F.concat(own, theirs)).alias("t")).select(
        "size", "block", "cell", "node", "copies", "vector", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.left").alias("left"), (F.col("t.a") == F.col("t.b")).alias("diagonal"))
    found = staged(spread.groupBy("size", "block", "cell", "a", "b").applyInArrow(_tile(least, wide), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"), "node", "root").select("node", F.col("root").alias("group"))
    group = F.coalesce("group", "node")
    known = nodes.select("node", "copies", "first").join(roots, "node", "left").withColumn("group", group)
    smallest = known.groupBy("group").agg(F.min("first").alias("component"))
    per_node = known.join(smallest, "group").join(links, "node", "left").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_vector = nodes.select("vector", "node").join(per_node, "node").drop("node")
    linked = good.join(per_vector, "vector").select("id", "n_links", F.col("component"))
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
