"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import durable


def _fingerprint(edges: DataFrame, cols: Sequence[str]) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("h"),
                    F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["h"], row["s"]


#: A node with more than this share of all edge ends is heavy; there are at most as many heavy nodes as the inverse of it says.
HEAVY_SHARE = 1 / 1000


def _with_lowest(edges: DataFrame, low: DataFrame, on: Sequence[str], n_edges: int) -> DataFrame:
    """``edges`` with the columns of ``low``, one row a node with its number ``d`` of ``edges``, joined on the node.

    The edges of a hub would meet in one task.  Heavy nodes, of which there are at most 1 / HEAVY_SHARE, are broadcast instead, and their
    edges stay where they are; only those of the other nodes are shuffled.
    """
    on, most = list(on), max(1000, int(n_edges * HEAVY_SHARE))
    heavy = F.broadcast(low.filter(F.col("d") > most).select(*on, F.col("m").alias("_heavy")))
    marked = edges.join(heavy, on, "left")
    light = marked.filter("_heavy is null").drop("_heavy").join(low.filter(F.col("d") <= most).drop("d"), on)
    return light.unionByName(marked.filter("_heavy is not null").withColumnRenamed("_heavy", "m"))


def components(edges: DataFrame, a: str, b: str, scope: Sequence[str] = ()) -> DataFrame:
    """Smallest node id reachable from every node that has an edge: (scope, node, root).

    Each round is two grouped minima and joins; the edge set is cut through the
    checkpoint folder after either of them, so lineage stays flat, a lost
    executor costs half a round and the driver never holds the plan of a whole one
    (each half reads its edges six times over).  It runs until a round changes nothing; the number of rounds
    grows with the logarithm of the longest path.  Nodes without an edge are not returned.
    Edges of a hub are spread over all tasks (``_with_lowest``).
    """
    scope = list(scope)
    cols = [*scope, "u", "v"]
    e = durable(edges.select(*scope, F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    mark = _fingerprint(e, cols)
    if mark[0] == 0:
        return e.select(*scope, F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        large = durable(
            _with_lowest(both, low, [*scope, "u"], 2 * mark[0])
            .filter(F.col("v") > F.col("u"))
            .select(*scope, F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        down = large.filter(F.col("v") < F.col("u"))
        low2 = down.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        kept = _with_lowest(down, low2, [*scope, "u"], 2 * mark[0])
        small = (
            kept.filter(F.col("v") != F.col("m")).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select(*scope, "u", F.col("m").alias("v")))
            .distinct()
        )
        e = durable(small)
        now = _fingerprint(e, cols)
        if now == mark:
            break
        mark = now
    roots = e.select(*scope, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(*scope, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def chain_heads(links: DataFrame, node: str, up: str) -> DataFrame:
    """(node, head): where following ``up`` ends, for every node that has one.  No node may be the ``up`` of two.

    Every round doubles how far a node has looked, and no node is looked at by more than one other, so no key is hot.
    """
    way = links.select(F.col(node).alias("n"), F.col(up).alias("u"))
    first = way.join(way.select(F.col("n").alias("u"), F.lit(True).alias("_more")), "u", "left")
    way = durable(first.select("n", "u", F.when(F.col("_more").isNull(), F.col("u")).alias("head")))
    while not way.filter("head is null").isEmpty():
        ahead = way.select(F.col("n").alias("u"), F.col("u").alias("_u"), F.col("head").alias("_head"))
        moved = way.filter("head is null").join(ahead, "u").select("n", F.col("_u").alias("u"), F.col("_head").alias("head"))
        way = durable(way.filter("head is not null").unionByName(moved))
    return way.select(F.col("n").alias(node), "head")
