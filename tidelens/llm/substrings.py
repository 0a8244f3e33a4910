"""Exact removal of repeated byte strings by enhanced suffix arrays, sharded by anchor (operator 10).

A byte is removed if a string of ``length`` bytes that covers it also starts earlier in the corpus.  A single suffix array of
the corpus cannot be held anywhere, so its suffixes are dealt out such that equal strings meet:

* every window of ``length`` bytes has one *anchor*, the leftmost position of its least ``gram``-byte hash; equal windows
  have equal anchors.  Consecutive windows with one anchor form a *segment*;
* inside a block of documents equal segments collapse to the first, so a block sends a string once however often it repeats;
* only anchors whose gram is found in two segments are of interest: gram hashes meet by bucket, one bit each goes back;
* those segments meet by gram.  There the suffixes that start at the anchors are sorted, a stack scan over their common
  prefixes gives the interval tree, and inside an interval the bytes to the left are compared: where left extensions differ,
  the interval splits into maximal repeat groups.  In every group all occurrences but the first lose that window.

Blocks and answers meet again by block.  Hot passages cost one segment per block and distinct surrounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import BLOCK_CHARS, mix64, pack, staged, text_blocks, unpack, width

U = np.uint64
BASE = 0x9E3779B97F4A7C15
PLACE = U((1 << 28) - 1)
NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U) * U(BASE))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.full(n, b, U)) for b in (BASE, pow(BASE, -1, 1 << 64)))


class Segments:
    """Segments of a block: ``first`` and ``last`` window, ``anchor``, ``gram`` hash; ``keep``: the first of equal ones."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, gram: int):
        n = len(data)
        if n >= int(PLACE):
            raise ValueError("a document has 256 MB or more")
        self.data = data
        if n < length:
            self.first = self.last = self.anchor = self.keep = np.zeros(0, np.int64)
            self.gram, self.repeated = np.zeros(0, U), np.zeros(0, bool)
            return
        power, inverse = _powers(1 << (n + 1).bit_length())
        total = np.zeros(n + 1, U)
        np.cumsum(_byte_values()[data] * power[:n], out=total[1:])
        hashes = mix64((total[gram:] - total[: n + 1 - gram]) * inverse[: n + 1 - gram])
        key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=U)
        least = self._sliding_min(key, length - gram + 1)
        anchor = (least & PLACE).astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)[: n - length + 1]
        start = np.flatnonzero(np.arange(length, n + 1) <= ends)
        anchor = anchor[start]
        if len(start) == 0:
            self.first = self.last = self.anchor = self.keep = np.zeros(0, np.int64)
            self.gram, self.repeated = np.zeros(0, U), np.zeros(0, bool)
            return
        cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        self.first, self.anchor = start[cut], anchor[cut]
        self.last = start[np.append(cut[1:], len(start)) - 1]
        self.gram = hashes[self.anchor]
        content = (total[self.last + length] - total[self.first]) * inverse[self.first] + (self.last - self.first).astype(U)
        _, keep, group = np.unique(mix64(content) ^ self.gram, return_index=True, return_inverse=True)
        self.keep = np.sort(keep)
        self.repeated = np.ones(len(cut), bool)
        self.repeated[self.keep] = False

    @staticmethod
    def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
        """Least value of every ``w`` neighbours, by running minima inside and across tiles of ``w``."""
        tiles = np.concatenate([key, np.full(-len(key) % w, key.max(), U)]).reshape(-1, w)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - w + 1
        return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])

    def grams(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, sorted distinct gram hashes of kept segments, whether two of these share the gram)."""
        known, n = np.unique(self.gram[self.keep], return_counts=True)
        home = bucket_of(known, buckets)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            mine = order[lo:hi]
            yield int(home[mine[0]]), known[mine], n[mine] > 1

    def sent(self, bits: dict[int, bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, kept segments whose gram is shared), by the bits that came back for each bucket."""
        shared = [h[np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(h)) > 0] for b, h, _ in self.grams(buckets)]
        wanted = np.concatenate(shared) if shared else np.zeros(0, U)
        chosen = self.keep[np.isin(self.gram[self.keep], wanted)]
        home = bucket_of(self.gram[chosen], buckets)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            yield int(home[order[lo]]), chosen[order[lo:hi]]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(20)) % U(buckets)).astype(np.int64)


def intervals(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, parent's depth) of every common-prefix interval with two or more suffixes, by one stack scan."""
    out, depths, lefts = [], [0], [0]
    for i, depth in enumerate([*lcp[1:], 0], 1):
        left = i - 1
        while depth < depths[-1]:
            own, left = depths.pop(), lefts.pop()
            out.append((left, i - 1, own, max(depth, depths[-1])))
        if depth > depths[-1]:
            depths.append(depth)
            lefts.append(left)
    return out


def _rows(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wide: int, step: int) -> np.ndarray:
    """Bytes from ``starts`` on in direction ``step``, zero-padded to ``wide``, then the size as last byte."""
    out = np.zeros((len(starts), wide + 1), np.uint8)
    for i in range(wide):
        has = sizes > i
        out[has, i] = flat[starts[has] + i * step]
    out[:, wide] = sizes + 1
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of rows a and b, at most the shorter one."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 100_000):
        x, y = rows[a[i : i + 100_000], :-1], rows[b[i : i + 100_000], :-1]
        differ = x != y
        out[i : i + 100_000] = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def repeated_windows(flat: np.ndarray, starts: np.ndarray, anchors: np.ndarray, sizes: np.ndarray, rank: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Per segment and offset before the anchor: whether that window also starts earlier, ``rank`` being the order of segments.

    ``starts``, ``sizes``: the segments in ``flat``; ``anchors``: offset of the anchor in its segment.
    """
    n, wide = len(starts), length - gram
    out = np.zeros((n, wide + 1), bool)
    right_size, left_size = np.minimum(sizes - anchors, length), np.minimum(anchors, wide)
    right = _rows(flat, starts + anchors, right_size, length, 1)
    order = _order(right)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = _common(right, order[:-1], order[1:], right_size)
    lcp[lcp < gram] = 0
    del right
    found = np.array(intervals(lcp.tolist()), np.int64).reshape(-1, 4)
    if len(found) == 0:
        return out
    lo, hi, depth, parent = found.T
    size = hi - lo + 1
    which = np.repeat(np.arange(len(found)), size)
    member = order[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
    left = _rows(flat, starts + anchors - 1, left_size, wide, -1)
    place = np.empty(n, np.int64)
    place[_order(left)] = np.arange(n)
    sort = np.lexsort((place[member], which))
    which, member = which[sort], member[sort]
    shared = np.zeros(len(member), np.int64)
    shared[1:] = _common(left, member[:-1], member[1:], left_size)
    shared[np.diff(which, prepend=-1) != 0] = -1
    least, most = np.maximum(0, length - depth)[which], np.minimum(wide, length - 1 - parent)[which]
    most = np.minimum(most, left_size[member])
    for offset in range(wide + 1):
        at = np.flatnonzero((least <= offset) & (offset <= most))
        if len(at) == 0:
            continue
        new = np.flatnonzero((shared[at] < offset) | (np.diff(which[at], prepend=-1) != 0))
        ranks = rank[member[at]]
        first = np.repeat(np.minimum.reduceat(ranks, new), np.diff(np.append(new, len(at))))
        out[member[at[ranks > first]], offset] = True
    return out


def _pack_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, texts in text_blocks(batches, "text", most):
            ids = [NO_ID if i is None else i for i in rows.column("id").to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            parts = [texts[i].encode() for i in order]
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                                   "data": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(parts))], pa.binary())})

    return run


def _read(block: dict, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, Segments]:
    ids, sizes = np.array(block["ids"], np.int64), np.array(block["sizes"], np.int64)
    return ids, sizes, Segments(unpack(block["data"], np.uint8), sizes, length, gram)


def _grams(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = list(_read(block, length, gram)[2].grams(buckets))
                yield pa.record_batch({"block": pa.array([block["block"]] * len(rows), pa.int64()), "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                                       "grams": pa.array([h.tobytes() for _, h, _ in rows], pa.binary()), "twice": pa.array([np.packbits(t).tobytes() for _, _, t in rows], pa.binary())})

    return run


def _shared_grams(rows: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x.as_py(), U) for x in rows.column("grams")]
    times = [1 + np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(np.int64) for x, h in zip(rows.column("twice"), lists)]
    known, group = np.unique(np.concatenate(lists), return_inverse=True)
    shared = np.bincount(group, np.concatenate(times), len(known))[group] > 1
    cuts = np.cumsum([len(h) for h in lists])[:-1]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary())})


def _send(length: int, gram: int, buckets: int):
    def run(blocks: pa.Table, bits: pa.Table) -> pa.Table:
        out = {"block": [], "bucket": [], "ids": [], "places": [], "shape": [], "bytes": []}
        block = blocks.to_pylist()[0]
        ids, sizes, found = _read(block, length, gram)
        document = np.repeat(ids, sizes)
        for bucket, chosen in found.sent(dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist())), buckets):
            first, size = found.first[chosen], found.last[chosen] - found.first[chosen] + length
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
            out["block"].append(block["block"])
            out["bucket"].append(bucket)
            out["ids"].append(pack(document[first]))
            out["places"].append(pack(first.astype(np.uint32)))
            out["shape"].append(pack(np.stack([found.anchor[chosen] - first, size - length]).astype(np.uint16)))
            out["bytes"].append(zstandard.ZstdCompressor(level=3).compress(found.data[at].tobytes()))
        kinds = {"block": pa.int64(), "bucket": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return run


def _resolve(length: int, gram: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        shape = [unpack(r["shape"], np.uint16).reshape(2, -1).astype(np.int64) for r in rows]
        anchors, sizes = np.concatenate(shape, axis=1)
        sizes = sizes + length
        flat = np.concatenate([unpack(r["bytes"], np.uint8) for r in rows])
        counts = [s.shape[1] for s in shape]
        order = np.lexsort((np.concatenate([unpack(r["places"], np.uint32) for r in rows]), np.repeat([r["block"] for r in rows], counts), np.concatenate([unpack(r["ids"], np.int64) for r in rows])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        gone = repeated_windows(flat, np.cumsum(sizes) - sizes, anchors, sizes, rank, length, gram)
        parts = np.split(gone, np.cumsum(counts)[:-1])
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "gone": pa.array([pack(np.packbits(p)) for p in parts], pa.binary())})

    return run


def _apply(length: int, gram: int, buckets: int):
    def run(blocks: pa.Table, bits: pa.Table, gone: dict[int, bytes]) -> pa.Table:
        block = blocks.to_pylist()[0]
        ids, sizes, found = _read(block, length, gram)
        change = np.zeros(len(found.data) + 1, np.int64)
        np.add.at(change, found.first[found.repeated], 1)
        np.add.at(change, found.last[found.repeated] + length, -1)
        for bucket, chosen in found.sent(dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist())), buckets):
            wide = length - gram + 1
            matrix = np.unpackbits(unpack(gone[bucket], np.uint8), count=len(chosen) * wide).reshape(-1, wide)
            which, offset = np.nonzero(matrix)
            start = found.anchor[chosen[which]] - offset
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
        removed = np.cumsum(change[:-1]) > 0
        out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        at = 0
        for i, size in zip(ids.tolist(), sizes.tolist()):
            cut = removed[at : at + size]
            out["id"].append(None if i == NO_ID else i)
            out["n_bytes"].append(size)
            out["n_removed"].append(int(cut.sum()))
            out["n_spans"].append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            out["kept"].append(found.data[at : at + size][~cut].tobytes())
            at += size
        return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, gram: int = 32, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` holds the remaining bytes of its UTF-8 text.

    Earlier means a smaller key, or the same document and an earlier start.  Keys are integers; null keys come before all
    others, rows with equal keys count in the order they are read.  Null and empty texts, and texts shorter than ``length``,
    lose nothing; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = width(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    blocks = staged(rows.mapInArrow(_pack_blocks(block_chars), "block long, ids array<long>, sizes array<long>, data binary"), "blocks")
    grams = blocks.mapInArrow(_grams(length, gram, buckets), "block long, bucket int, grams binary, twice binary")
    bits = staged(grams.groupBy("bucket").applyInArrow(_shared_grams, "block long, bucket int, bits binary"), "bits")
    sent = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_send(length, gram, buckets), "block long, bucket int, ids binary, places binary, shape binary, bytes binary")
    gone = sent.groupBy("bucket").applyInArrow(_resolve(length, gram), "block long, bucket int, gone binary")
    both = bits.select("block", "bucket", "bits", F.lit(None).cast("binary").alias("gone")).unionByName(gone.select("block", "bucket", F.lit(None).cast("binary").alias("bits"), "gone"))
    apply = _apply(length, gram, buckets)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        known = answers.filter(answers.column("bits").is_valid())
        found = answers.filter(answers.column("gone").is_valid())
        return apply(block, known, dict(zip(found.column("bucket").to_pylist(), found.column("gone").to_pylist())))

    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", key)
