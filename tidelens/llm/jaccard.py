"""N-gram Jaccard join by MinHash banding (operator 7).

Texts become sets of hashed word n-grams; texts with equal sets are one class and take part once.  Rows per band are given,
bands follow from the recall wanted at the threshold.  A shuffle on band hashes finds classes that share a band.

A bucket may hold a large part of all classes, so neither its pairs nor its sets are gathered there.  Every class gets a home
chunk of bounded size among classes with the same label (the smallest class it shares a band with); buckets only say which
chunks have to meet.  Each such pair of chunks is one task, which compares the full sets.  A pair of classes has one pair of
chunks, so it is verified once; a task returns a count and one tree edge per class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .common import Forest, mix64, staged

#: Words are runs of characters other than these blanks, in lower case.
WORD = re.compile(r"[^ \t\n\r\f\v]+")
ROWS = 5
RECALL = 0.99999
CHUNK = 256
U = np.uint64


def bands_for(least: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold shares one of them with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - least**rows)))


class _Hashed(dict):
    """64-bit hash of each word; a bounded table of words seen."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(text: str, table: _Hashed) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(table.__getitem__, words), U, len(words))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of ``size`` words in place; one hash of all words if there are fewer, none without words."""
    if len(words) == 0:
        return np.zeros(0, U)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, U(size))
    for i in range(size):
        out = out * U(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix64(out)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)


def band_hashes(grams: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(len(multipliers), ~U(0))
    for i in range(0, len(grams), 2048):
        np.minimum(least, (grams[i : i + 2048, None] * multipliers).min(axis=0), out=least)
    out = np.zeros(len(multipliers) // rows, U)
    for row in least.reshape(-1, rows).T:
        out = mix64(out * U(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    data = grams.tobytes()
    return xxhash.xxh64_intdigest(data, 1) - (1 << 63), xxhash.xxh64_intdigest(data, 2) - (1 << 63)


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, multipliers = _Hashed(), _multipliers(bands * rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [np.unique(shingles(word_hashes(t.as_py() or "", table), size)) for t in batch.column("text")]
                keys = [_set_hash(g) for g in sets]
                yield pa.record_batch({"id": batch.column("id"), "h1": pa.array([k[0] for k in keys], pa.int64()), "h2": pa.array([k[1] for k in keys], pa.int64()),
                                       "n": pa.array([len(g) for g in sets], pa.int32()), "bands": pa.array([band_hashes(g, multipliers, rows) if len(g) else None for g in sets], pa.list_(pa.int64()))})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashed()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000).to_pylist()
                rows = [(r, np.unique(shingles(word_hashes(r["text"] or "", table), size))) for r in batch]
                rows = [(r, g) for r, g in rows if _set_hash(g) == (r["h1"], r["h2"])]
                yield pa.record_batch({"node": pa.array([r["node"] for r, _ in rows], pa.int64()), "grams": pa.array([g.tobytes() for _, g in rows], pa.binary())})

    return run


def common_grams(sets: list[np.ndarray], wide: int = 1 << 15) -> np.ndarray:
    """Size of the intersection of every two sets, by bit rows over the n-grams that two sets share."""
    sizes = [len(s) for s in sets]
    _, gram, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)[shared[gram]]
    gram = column[gram[shared[gram]]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    total = int(shared.sum())
    for lo in range(0, total, wide):
        a, b = np.searchsorted(gram, [lo, lo + wide])
        bits = np.zeros((len(sets), min(wide, total - lo)), bool)
        bits[owner[a:b], gram[a:b] - lo] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(U)
        for i in range(len(sets)):
            out[i] += np.bitwise_count(packed[i] & packed).sum(axis=1, dtype=np.int64)
    return out


def _verify(least: float):
    def run(rows: pa.Table) -> pa.Table:
        node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
        sets = [np.frombuffer(x.as_py(), U) for x in rows.column("grams")]
        size = np.array([len(s) for s in sets])
        common = common_grams(sets)
        linked = common / (size[:, None] + size[None, :] - common) >= least
        linked &= (side[:, None] != side[None, :]) if (side == 1).any() else True
        np.fill_diagonal(linked, False)
        forest = Forest(len(node))
        forest.add(*np.nonzero(np.triu(linked)))
        links = linked @ copies
        said = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[said]), "links": pa.array(links[said]), "root": pa.array(node[forest.root[said]])})

    return run


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, size: int = 5, recall: float = RECALL, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """(key, class_id, n_links, group_id) of every row.

    Rows whose n-gram sets are equal form a class, named by its smallest key; ``n_links`` counts the other rows with a Jaccard
    similarity of ``least`` or more, ``group_id`` is the smallest key that links lead to.  Texts with fewer words than ``size``
    are one n-gram; null, empty and blank texts link with nothing and are their own class and group.  Repeated rows count each
    for itself; null keys are passed over in the choice of the smallest; an empty table gives an empty one; other columns are
    not read.
    """
    bands = bands_for(least, recall, rows)
    base = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    signed = staged(base.mapInArrow(_signatures(size, bands, rows), f"id {kind}, h1 long, h2 long, n int, bands array<long>"), "signatures")
    classes = staged(signed.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = keys.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("label")).filter("n > 1")
    members = staged(keys.join(buckets.select("band", "value", "label"), ["band", "value"]), "members")
    labels = members.groupBy("node").agg(F.min("label").alias("label"))
    parts = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    homes = staged(labels.join(parts, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts")).alias("chunk")), "homes")
    meets = members.join(homes, "node").groupBy("band", "value").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"))
    tiles = meets.select(F.explode(F.flatten(F.transform("chunks", lambda a, i: F.transform(F.slice("chunks", i + 1, F.size("chunks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("t")).select("t.a", "t.b").distinct()
    wanted = homes.join(classes.select("node", "h1", "h2", "first"), "node").select("node", "h1", "h2", "first")
    texts = base.join(wanted, base["id"].eqNullSafe(wanted["first"])).select("node", "h1", "h2", "text")
    sets = texts.mapInArrow(_sets(size), "node long, grams binary").dropDuplicates(["node"])
    full = staged(sets.join(homes, "node").join(classes.select("node", "copies"), "node"), "sets")
    sides = tiles.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("b").alias("chunk"), F.lit(1).alias("side"))))).alias("s")).select("a", "b", "s.chunk", "s.side")
    met = sides.join(full, "chunk").select("a", "b", "side", "node", "copies", "grams")
    found = staged(met.groupBy("a", "b").applyInArrow(_verify(least), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"), "node", "root").select("node", F.col("root").alias("group"))
    known = classes.select("node", "h1", "h2", "first", "copies").join(roots, "node", "left").withColumn("group", F.coalesce("group", "node"))
    smallest = known.groupBy("group").agg(F.min("first").alias("smallest"))
    named = known.join(smallest, "group").join(links, "node", "left").select("h1", "h2", "first", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = signed.filter("n > 0").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", F.col("first").alias("class_id"), "n_links", F.col("smallest").alias("group_id"))
    alone = signed.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"))
    return linked.unionByName(alone).withColumnRenamed("id", key)


def one_per_group(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns: of every group of linked rows the one with the smallest key.

    Rows with equal key and text count as one, null keys as smallest, rows that link with nothing stay.
    """
    mark = F.xxhash64(F.col(f"`{text}`"))
    named = docs.select(F.struct(F.col(f"`{key}`").alias("key"), mark.alias("mark")).alias("id"), F.col(f"`{text}`").alias("text"))
    kept = join(named, "text", "id", **options).filter("id = group_id").select("id.*").distinct()
    marked = docs.withColumn("__mark", mark)
    out = marked.join(kept, marked[key].eqNullSafe(kept["key"]) & (marked["__mark"] == kept["mark"]), "left_semi")
    return out.dropDuplicates([key, "__mark"]).drop("__mark")
