"""Benchmark decontamination by greedy string tiling (operator 2).

A document and a benchmark item share *seeds*: runs of ``size`` words.  Seeds are joined by hash; a bit table of fixed size
first drops words that lie in no seed (it never drops a true one).  A pair goes on only if the item's words under shared seeds
reach the wanted share, which tiles cannot exceed.  Tiling then marks the longest matches that overlap no earlier one,
found by running Karp-Rabin with ever shorter search lengths, so a passage whose parts were put in another order is covered too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .jaccard import U, _Hashed, shingles

WORD = re.compile(r"\w+")
SIZE = 5
COVERAGE = 0.6
BITS, SLICES = 1 << 23, 64
PRIME, RADIX = (1 << 61) - 1, 1_000_003


def word_hashes(text: str | None, table: _Hashed) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(table.__getitem__, words), U, len(words))


def tile(pattern: list[int], text: list[int | None], least: int = SIZE) -> list[tuple[int, int, int]]:
    """Tiles (place in pattern, place in text, length): repeatedly the longest unmarked common runs of ``least`` words or more.

    ``None`` in the text matches nothing.  Among equally long runs the earliest in the pattern, then in the text, comes first.
    """
    taken_p, taken_t, tiles = [False] * len(pattern), [t is None for t in text], []
    search = max(least, min(len(pattern), 64))
    while True:
        found, longest = _scan(pattern, text, taken_p, taken_t, search)
        if longest > 2 * search:
            search = longest
            continue
        heap = [(-n, p, t) for n, p, t in found]
        heapify(heap)
        while heap:
            length, p, t = heappop(heap)
            free = [not (a or b) for a, b in zip(taken_p[p : p - length], taken_t[t : t - length])]
            if all(free):
                tiles.append((p, t, -length))
                taken_p[p : p - length] = taken_t[t : t - length] = [True] * -length
                continue
            start = None
            for i, ok in enumerate([*free, False]):  # what earlier tiles left of this run
                if ok and start is None:
                    start = i
                elif not ok and start is not None:
                    if i - start >= search:
                        heappush(heap, (start - i, p + start, t + start))
                    start = None
        if search == least:
            return tiles
        search = max(least, search // 2)


def _scan(pattern, text, taken_p, taken_t, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal unmarked matches of at least ``size`` words by running Karp-Rabin hashes, and the longest length."""
    places: dict[int, list[int]] = {}
    for p, h in _running(pattern, taken_p, size):
        places.setdefault(h, []).append(p)
    found, longest = [], 0
    for t, h in _running(text, taken_t, size):
        for p in places.get(h, ()):
            if p and t and not taken_p[p - 1] and not taken_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # not the start of the match
            n = 0
            while p + n < len(pattern) and t + n < len(text) and not taken_p[p + n] and not taken_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n >= size:
                found.append((n, p, t))
                longest = max(longest, n)
    return found, longest


def _running(words, taken, size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every run of ``size`` unmarked words."""
    out, n, top = 0, 0, pow(RADIX, size - 1, PRIME)
    for i, w in enumerate(words):
        if taken[i]:
            out = n = 0
            continue
        if n == size:
            out -= words[i - size] * top
            n -= 1
        out = (out * RADIX + w) % PRIME
        n += 1
        if n == size:
            yield i - size + 1, out


def _seeds(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashed()
        for batch in batches:
            for row in batch.to_pylist():
                words = word_hashes(row["text"], table)
                if len(words) < size:
                    continue
                seeds = shingles(words, size).view(np.int64)
                yield pa.record_batch({"item": pa.array([row["item"]] * len(seeds), pa.int64()), "n_words": pa.array([len(words)] * len(seeds), pa.int32()), "at": pa.array(np.arange(len(seeds)), pa.int32()), "seed": pa.array(seeds)})

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(batch.column("seed").to_numpy().view(U) % U(BITS)).astype(np.int64)
        table = np.zeros(BITS, bool)
        table[at] = True
        parts = np.packbits(table).reshape(SLICES, -1)
        full = np.flatnonzero(parts.any(1))
        yield pa.record_batch({"slice": pa.array(full, pa.int32()), "bits": pa.array([parts[i].tobytes() for i in full], pa.binary())})


def _any_bit(rows: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("bits")], axis=0)
    return pa.table({"slice": rows.column("slice")[:1], "bits": pa.array([total.tobytes()], pa.binary())})


def _marked(bits, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = np.unpackbits(bits.value).view(bool), _Hashed()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                which, seeds, places, words = [], [], [], []
                for i, value in enumerate(batch.column("text")):
                    hashes = word_hashes(value.as_py(), held)
                    if len(hashes) < size:
                        continue
                    all_seeds = shingles(hashes, size)
                    hit = np.flatnonzero(table[(all_seeds % U(BITS)).astype(np.int64)])
                    if len(hit) == 0:
                        continue
                    cover = np.unique((hit[:, None] + np.arange(size)).ravel())
                    which.append(i)
                    seeds.append(np.unique(all_seeds[hit]).view(np.int64))
                    places.append(cover.astype(np.int32))
                    words.append(hashes[cover].view(np.int64))
                yield pa.record_batch({"row": batch.column("row").take(pa.array(which, pa.int32())), "seeds": pa.array(seeds, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32())), "words": pa.array(words, pa.list_(pa.int64()))})

    return run


def _tiled(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Hashed()
        for batch in batches:
            out = {"at": [], "n_tiles": [], "n_matched": [], "coverage": []}
            for i, (item, places, words) in enumerate(zip(batch.column("item_text"), batch.column("places"), batch.column("words"))):
                pattern = (word_hashes(item.as_py(), held) % U(PRIME)).tolist()
                at, found = places.values.to_numpy(), (words.values.to_numpy().view(U) % U(PRIME)).tolist()
                text: list[int | None] = []
                for gap, w in zip(np.diff(at, prepend=at[0] - 1), found):
                    text += [None] * int(gap > 1) + [w]
                tiles = tile(pattern, text, size)
                matched = sum(n for *_, n in tiles)
                if matched >= least * len(pattern):
                    for k, v in zip(out, (i, len(tiles), matched, matched / len(pattern))):
                        out[k].append(v)
            chosen = batch.take(pa.array(out.pop("at"), pa.int32()))
            yield pa.record_batch({"row": chosen.column("row"), "item_key": chosen.column("item_key"), "n_tiles": pa.array(out["n_tiles"], pa.int32()), "n_matched": pa.array(out["n_matched"], pa.int32()), "coverage": pa.array(out["coverage"], pa.float64())})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", least: float = COVERAGE, size: int = SIZE) -> DataFrame:
    """Columns ``keep``, item_id, n_tiles, n_matched and coverage of every document and item whose tiles cover ``least`` of the item.

    Words are compared in lower case without punctuation.  Null and empty texts, and items or documents of fewer than ``size``
    words, match nothing.  Repeated rows of either side give their own pairs; null keys are kept; empty tables give an empty
    one; other columns are not read.
    """
    spark = docs.sparkSession
    items = staged(benchmark.select(F.col(f"`{item}`").alias("item_key"), F.col(f"`{item_text}`").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = staged(items.select("item", "text").mapInArrow(_seeds(size), "item long, n_words int, at int, seed long"), "seeds")
    table = np.zeros((SLICES, BITS // 8 // SLICES), np.uint8)
    for row in seeds.select("seed").mapInArrow(_bits, "slice int, bits binary").groupBy("slice").applyInArrow(_any_bit, "slice int, bits binary").toLocalIterator():
        table[row["slice"]] = np.frombuffer(row["bits"], np.uint8)  # BITS bits in all
    bits = spark.sparkContext.broadcast(table.ravel())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    marked = staged(rows.mapInArrow(_marked(bits, size), f"row {kind}, seeds array<long>, places array<int>, words array<long>").withColumn("node", F.monotonically_increasing_id()), "marked")
    shared = marked.select("node", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("node", "item").agg(F.array_sort(F.collect_set("at")).alias("ats"), F.first("n_words").alias("n_words"))
    under = F.aggregate(F.transform("ats", lambda a, i: F.least(F.lit(size), F.coalesce(F.try_element_at("ats", (i + 2).cast("int")), a + size) - a)), F.lit(0), lambda x, y: x + y)
    pairs = shared.filter(under >= least * F.col("n_words")).select("node", "item")
    full = pairs.join(items.select("item", "item_key", F.col("text").alias("item_text")), "item").join(marked.select("node", "row", "places", "words"), "node").select("row", "item_key", "item_text", "places", "words")
    key = items.schema["item_key"].dataType.simpleString()
    out = full.mapInArrow(_tiled(size, least), f"row {kind}, item_key {key}, n_tiles int, n_matched int, coverage double")
    return out.select("row.*", F.col("item_key").alias(item), "n_tiles", "n_matched", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", least: float = COVERAGE, size: int = SIZE) -> DataFrame:
    """Rows of ``docs``, with all their columns, in which no benchmark item is covered."""
    mark = F.xxhash64(F.col(f"`{text}`"))
    named = docs.select(F.col(f"`{key}`").alias("key"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))
    found = leaks(named, benchmark, "text", ("key", "mark"), least=least, size=size).select("key", "mark").distinct()
    return docs.join(found, docs[key].eqNullSafe(found["key"]) & (mark == found["mark"]), "left_anti")
