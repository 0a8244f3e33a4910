"""Periodic runs of words, found on a Re-Pair grammar of every text (operator 11).

A run is a stretch of words that repeats with a smallest period, at least twice over, and that no neighbouring word extends.
Every text is handled on its own, where Spark put its row, so nothing is shuffled:

1. words of a block of texts are numbered; a word can lie in a run only if a window of half the least length around it
   occurs again in the same stretch, so what no repeated window covers is cut away (exactly: no run reaches into it);
2. Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair occurs twice;
3. a run that lies inside a symbol's expansion either lies inside one half or crosses the seam between both.  The crossing
   ones are computed once per symbol with prefix tables of both halves, and moved to all places where the symbol was put;
   the symbols that remain are joined by a balanced tree of seams;
4. intervals of one period that overlap by a period are parts of one run and are merged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, text_blocks

#: Words are what blanks and ASCII line marks separate.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def repeated_stretches(ids: np.ndarray, piece: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run of ``least`` words; ``piece`` names the text of every word.

    In a run, every word lies in a window of (least + 1) // 2 words that occurs a period before or after, in the same run.
    """
    window, at = max(1, (least + 1) // 2), np.arange(len(ids))
    while len(at) >= least:
        n = len(at) - window + 1
        code = np.zeros(n, np.uint64)
        for j in range(window):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[at[j : j + n]].astype(np.uint64) + np.uint64(1)
        whole = np.flatnonzero(piece[:n] == piece[window - 1 :])
        code = mix64(code[whole] ^ mix64(piece[whole].astype(np.uint64) + np.uint64(7)))
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, whole[twice], 1)
        np.add.at(edge, whole[twice] + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        fresh = covered.copy()
        fresh[1:] &= ~covered[:-1] | (piece[1:] != piece[:-1])
        name = np.cumsum(fresh)
        kept = covered & (np.bincount(name[covered], minlength=name[-1] + 1)[name] >= least)
        settled = kept.all() and len(np.unique(piece)) == name[-1]
        at, piece = at[kept], name[kept]
        if settled:
            break
    else:
        return []
    cuts = np.flatnonzero(np.diff(piece, prepend=-1))
    return [(int(at[i]), int(at[j - 1]) + 1) for i, j in zip(cuts, [*cuts[1:], len(at)])]


def re_pair(words: Sequence[int]) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """Rules (words of the left half, words in all, places where it is derived) and the starts of the symbols that remain.

    Of equally frequent pairs the shortest goes first, which keeps the rules balanced.  A pair once replaced never comes back,
    so the places of its replacement are all places of the new symbol in the derivation.
    """
    n = len(words)
    symbol, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        places.setdefault(pair, []).append(i)
    count = {pair: len(at) for pair, at in places.items()}
    heap = [(-len(at), 2, at[0], pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    rules, new = [], -1
    while heap:
        frequency, size, first, pair = heappop(heap)
        if -frequency != count[pair]:
            if count[pair] > 1:
                heappush(heap, (-count[pair], size, first, pair))
            continue
        left, right = pair
        made: dict[tuple[int, int], list[int]] = {}
        put, half = [], 0
        for i in places.pop(pair):
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            k, h = after[j], before[i]
            if h >= 0:
                gone = (symbol[h], left)
                count[gone] = count.get(gone, 0) - 1
                made.setdefault((symbol[h], new), []).append(h)
            if k < n:
                gone = (right, symbol[k])
                count[gone] = count.get(gone, 0) - 1
                made.setdefault((new, symbol[k]), []).append(i)
                before[k] = i
            symbol[i], symbol[j], after[i] = new, None, k
            half, size = j - i, k - i
            put.append(i)
        count[pair] = 0
        if not put:
            continue
        rules.append((half, size, put))
        for other, at in made.items():
            count[other] = count.get(other, 0) + len(at)
            places[other] = at
            if count[other] > 1:
                heappush(heap, (-count[other], 2 * size, at[0], other))
        new -= 1
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = after[i]
    return rules, starts


def prefix_table(s: list) -> list[int]:
    """For every place, how many items from there on equal those from the start on."""
    n = len(s)
    out, lo, hi = [0] * n, 0, 0
    if n:
        out[0] = n
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return out


def crossing_runs(u: list[int], v: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the runs in u + v that hold words of both and cannot be extended in u + v."""
    n, m = len(u), len(v)
    best: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(least, 2 * q):
            best[start, end] = min(best.get((start, end), q), q)

    back, ahead = prefix_table(u[::-1]), prefix_table(v + [None] + u + v)
    for q in range(1, n + 1):
        ends = ahead[m + 1 + n - q]
        if ends:
            keep(n - q - (back[q] if q < n else 0), n + ends, q)
    ahead, back = prefix_table(v), prefix_table(u[::-1] + [None] + (u + v)[::-1])
    for q in range(1, m + 1):
        begins = back[n + 1 + m - q]
        if begins:
            keep(n - begins, n + q + (ahead[q] if q < m else 0), q)
    return [(s, e, q) for (s, e), q in best.items()]


def runs_of(words: Sequence[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and two periods, by start, then period."""
    words = list(words)
    rules, starts = re_pair(words)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def seam(start: int, middle: int, end: int, places: Sequence[int]) -> None:
        if end - start >= least:
            for s, e, q in crossing_runs(words[start:middle], words[middle:end], least):
                found[q].extend((p + s, p + e) for p in places)

    for half, size, places in rules:
        seam(places[0], places[0] + half, places[0] + size, places)
    cuts, todo = [*starts, len(words)], [(0, len(starts))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            seam(cuts[lo], cuts[mid], cuts[hi], (cuts[lo],))
            todo += [(lo, mid), (mid, hi)]
    smallest: dict[tuple[int, int], int] = {}
    for q, spans in found.items():
        start = end = None
        for s, e in [*sorted(spans), (len(words) + q, 0)]:
            if end is not None and s <= end - q:
                end = max(end, e)
                continue
            if end is not None:
                smallest[start, end] = min(smallest.get((start, end), q), q)
            start, end = s, e
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


class _Numbered(dict):
    def __missing__(self, word):
        self[word] = out = len(self)
        return out


def runs_of_texts(texts: Sequence[list[str]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    table = _Numbered()
    look, sizes = table.__getitem__, np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.concatenate([np.fromiter(map(look, words), np.int64, len(words)) for words in texts] or [np.zeros(0, np.int64)])
    ends, out = np.cumsum(sizes), [[] for _ in texts]
    for a, b in repeated_stretches(ids, np.repeat(np.arange(len(texts)), sizes), least):
        i = int(np.searchsorted(ends, a, "right"))
        base = a - int(ends[i] - sizes[i])
        out[i] += [(base + s, size, q) for s, size, q in runs_of(ids[a:b].tolist(), least)]
    return out


def collapse(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> str:
    """The words without what any run repeats after its first period, joined by one blank."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, size, q in runs:
        keep[start + q : start + size] = False
    return " ".join([words[i] for i in np.flatnonzero(keep)])


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), least: int = 12, rewrite: Callable[[dict, list[str]], list[str]] | None = None) -> DataFrame:
    """Columns ``keep`` of every row with ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``rewrite`` may change the words of a row before they are searched; it gets the kept columns and the words.  Null, empty
    and blank texts have no words, no runs and an empty ``collapsed``; repeated rows and null keys stay as they are; an empty
    table gives an empty one; other columns of ``docs``, whatever their names, are not read.  A task holds blocks of a bounded
    number of characters; a longer text is a block of its own and takes memory in proportion to its words.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, texts in text_blocks(batches, "text"):
            kept, words = block.column("row").combine_chunks(), list(map(WORD.findall, texts))
            if rewrite is not None:
                words = [rewrite(row, w) for row, w in zip(kept.to_pylist(), words)]
            found = runs_of_texts(words, least)
            for at in range(0, len(words), 256):
                some, runs = words[at : at + 256], found[at : at + 256]
                yield pa.record_batch({"row": kept.slice(at, len(some)), "n_words": pa.array(list(map(len, some)), pa.int64()),
                                       "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], run_type),
                                       "collapsed": pa.array(list(map(collapse, some, runs)), pa.string())})

    out = rows.mapInArrow(run, f"row {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.select("row.*", "n_words", "runs", "collapsed")
