"""Spelling variants by composing a vocabulary acceptor with a one-edit transducer and itself (operator 13).

Two words are near if one inserted, deleted or replaced character makes them equal.  Composing acceptor, one-edit transducer and
acceptor gives a machine over pairs of states that accepts the near pairs.  As long as no edit was made both sides read the same
characters; after it they must again.  So the work is cut by what surrounds the edit: a pair whose shorter word has ``c`` characters is
cut in parts of at most ``PART`` characters, the edit falls into exactly one of them, and before and after it both words
agree.  (c, part, characters before, characters after) is an *initial state*; all words that can start there meet by hash of it.
It is reached by at most alphabet ** (PART + 1) words, whatever the vocabulary, and no key grows with a common prefix.

A task takes a bucket of initial states:

1. acceptor: the middles of their words, sorted, make a trie; bottom up, states with the same arcs become one, so that all
   initial states of the bucket share their tails.  Every arc knows how many words come before it, which numbers the words;
2. composition: from every state reached without an edit, a replacement leads to two arcs of it, an insertion to one arc on one
   side only; from there both sides read the same character.  Pairs of states are made once, and dead ones are cut off
   from the end;
3. enumeration walks the live pairs only and yields pairs of word numbers.

What leaves a task is, per word, how many near words it has there and the most frequent of them; Spark adds up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ragged, staged, text_blocks

#: Characters of a part; an edit falls into one part.
PART = 4
#: Words (with multiplicity by part) that a bucket of initial states is meant to hold.
BUCKET_ROWS = 60_000
#: Letters of a word, in Latin-1.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: One in so many pairs of document and word loses a character.
SLIP = 97


def _slipped(words: Counter, key: object, shortest: int) -> Iterator[tuple[bytes, int]]:
    head = zlib.crc32(f"{key}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < shortest:
                continue
        yield word, n


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words with ``shortest`` or more characters that occur ``least`` times or more in all texts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case; a hash of document and word decides which occurrences
    are written with one character less.  Null and empty texts have none; a null key counts as the text ``null``; repeated
    rows count as often as they come; other columns are not read; an empty table has no words.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, texts in text_blocks(batches, "text"):
            total: Counter = Counter()
            for name, value in zip(block.column("key").to_pylist(), texts):
                # what Latin-1 does not have becomes a question mark, which ends a run as the character itself does
                found = Counter(w for w in RUN.findall(value.encode("latin-1", "replace").lower()) if len(w) >= shortest)
                for word, n in _slipped(found, "null" if name is None else name, shortest):
                    total[word] += n
            words = list(total)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.record_batch({"word": pa.array([w.decode("latin-1") for w in some], pa.string()), "n": pa.array([total[w] for w in some], pa.int64())})

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def initial_states(words: DataFrame, part: int = PART) -> DataFrame:
    """(state, longer, last, middle, word, n): every word at each initial state that it can start from.

    ``longer`` marks the words with one character more than the other side may have, ``last`` the states of a last part.
    """
    length, c = F.length("word"), F.col("c")
    classes = words.select("*", F.explode(F.array(length, length - 1)).alias("c")).filter("c > 0").withColumn("longer", F.length("word") > c)
    parts = F.ceil(c / F.lit(part)).cast("int")
    cut = classes.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.expr("j * c div parts").cast("int"), F.expr("(j + 1) * c div parts").cast("int")
    cut = cut.withColumn("lo", lo).withColumn("rest", c - hi)
    before, after = F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - rest + 1, rest)")
    middle = F.expr("substring(word, lo + 1, length(word) - rest - lo)")
    return cut.select(F.concat_ws("\0", "c", "j", before, after).alias("state"), "longer", (F.col("j") == F.col("parts") - 1).alias("last"), middle.alias("middle"), "word", "n")


class Acceptor:
    """Minimal acyclic acceptor of right-aligned words of several groups, level by level from the end.

    A state of level h has h characters to read.  Arcs lie sorted by state and character: ``label``, ``to`` (a state of level h - 1) and
    ``skip``, the number of words of the state before the arc.
    """

    def __init__(self, group: np.ndarray, letters: np.ndarray, size: np.ndarray):
        """Rows sorted by group and letters, all different; ``size`` is the same for all rows of a group."""
        n, most = letters.shape
        self.first: list[np.ndarray] = [np.zeros(2, np.int64)]
        self.label: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.to: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.skip: list[np.ndarray] = [np.zeros(0, np.int64)]
        words = [np.ones(1, np.int64)]
        #: State that each row's word is at with h characters to read, -1 where it never is.
        self.start = [np.zeros(n, np.int64)]
        # where a row differs from the one before it, in any column up to each
        fresh = np.ones((n, most + 1), bool)
        if n:
            fresh[1:, 0] = group[1:] != group[:-1]
            for j in range(most):
                fresh[1:, j + 1] = fresh[1:, j] | (letters[1:, j] != letters[:-1, j])
        for h in range(1, most + 1):
            rows = np.flatnonzero((size >= h) & fresh[:, most - h + 1])  # first row below every arc
            head = fresh[rows, most - h]
            node = np.cumsum(head) - 1
            label, to = letters[rows, most - h].astype(np.int64), self.start[h - 1][rows]
            count = np.bincount(node) if len(rows) else np.zeros(0, np.int64)
            state, rep = _merge(node, count, label, to)
            first = np.concatenate([[0], np.cumsum(count[rep])]).astype(np.int64)
            arcs = ragged((np.cumsum(count) - count)[rep], count[rep]) if len(rep) else np.zeros(0, np.int64)
            label, to = label[arcs], to[arcs]
            held = words[h - 1][to]
            skip = np.cumsum(held) - held
            owner = np.repeat(np.arange(len(rep)), count[rep])
            skip -= skip[first[:-1]][owner] if len(owner) else 0
            self.first.append(first), self.label.append(label), self.to.append(to), self.skip.append(skip)
            words.append(np.bincount(owner, held, len(rep)).astype(np.int64))
            all_rows = np.full(n, -1, np.int64)
            long_enough = np.flatnonzero(size >= h)
            inner = np.cumsum(fresh[long_enough, most - h]) - 1
            all_rows[long_enough] = state[inner] if len(long_enough) else 0
            self.start.append(all_rows)
        self.keys = [np.repeat(np.arange(len(f) - 1), np.diff(f)) << 21 | l for f, l in zip(self.first, self.label)]

    def arcs(self, h: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``state``, arc) of all arcs of the given states."""
        count = self.first[h][state + 1] - self.first[h][state]
        return np.repeat(np.arange(len(state)), count), ragged(self.first[h][state], count)

    def step(self, h: int, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arc of each state with each label, -1 where there is none."""
        keys, want = self.keys[h], state << 21 | label
        if not len(keys):
            return np.full(len(want), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((state >= 0) & (keys[at] == want), at, -1)


def _merge(node: np.ndarray, count: np.ndarray, label: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of every node, a node of every state): nodes with the same arcs are one state.  Arcs are compared, not only hashed."""
    if not len(count):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, arc = np.cumsum(count) - count, label << 32 | to
    # the same number of arcs, then the same first arc, second arc and so on
    state = np.unique(count, return_inverse=True)[1].astype(np.int64)
    for k in range(int(count.max())):
        has = np.flatnonzero(count > k)
        code = np.unique(arc[begin[has] + k], return_inverse=True)[1].astype(np.int64)
        state[has] = np.unique(state[has] * (len(code) + 1) + code, return_inverse=True)[1] + len(count) * (k + 1)
    _, rep, state = np.unique(state, return_index=True, return_inverse=True)
    return state.astype(np.int64), rep


def near_rows(group: np.ndarray, longer: np.ndarray, last: np.ndarray, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group that differ by one edit: both not ``longer`` and replaced, or one ``longer`` and inserted.

    Rows are sorted by group, ``longer`` and letters (right-aligned code points, ``size`` of them).  An inserted character stands
    where the two first differ; one behind the end counts only at the ``last`` part, so every pair comes from one state.
    """
    most, side = letters.shape[1], group * 2 + longer
    machine = Acceptor(side, letters, size)
    heads = np.flatnonzero(np.diff(side, prepend=-1))
    base = {int(s): int(r) for s, r in zip(side[heads], heads)}
    left = heads[~longer[heads]]
    right = np.array([base.get(int(side[r]) + 1, -1) for r in left], np.int64)
    begin = {h: np.flatnonzero(size[left] == h) for h in range(most + 1)}
    q, r, s, t, end = (np.zeros(0, np.int64) for _ in range(5))  # states of both sides, first rows of both, whether at a last part
    seeds: list[list[tuple]] = [[] for _ in range(most + 1)]
    for h in range(most, -1, -1):
        new = begin[h]
        q, r = np.concatenate([q, machine.start[h][left[new]]]), np.concatenate([r, left[new]])
        has = right[new] >= 0
        up = machine.start[h + 1] if h < most else np.full(len(side), -1, np.int64)
        s, t = np.concatenate([s, np.where(has, up[right[new]], -1)]), np.concatenate([t, right[new]])
        end = np.concatenate([end, last[left[new]].astype(np.int64)])
        both = np.flatnonzero(s >= 0)
        i, x = machine.arcs(h + 1, s[both]) if len(both) else (np.zeros(0, np.int64),) * 2
        i = both[i]
        if h == 0:  # the shorter word is at its end; the longer one has one character more
            fit = end[i] > 0
            seeds[0].append((np.zeros(fit.sum(), np.int64), np.zeros(fit.sum(), np.int64), r[i][fit], t[i][fit] + machine.skip[1][x[fit]]))
            break
        if len(i):  # inserted here: both must go on with the same character, and not with the inserted one
            k, y = machine.arcs(h, q[i])
            z = machine.step(h, machine.to[h + 1][x[k]], machine.label[h][y])
            fit = (z >= 0) & (machine.label[h][y] != machine.label[h + 1][x[k]])
            k, y, z = k[fit], y[fit], z[fit]
            seeds[h - 1].append((machine.to[h][y], machine.to[h][z], r[i[k]] + machine.skip[h][y], t[i[k]] + machine.skip[h + 1][x[k]] + machine.skip[h][z]))
        i, x = machine.arcs(h, q)
        # replaced here: two arcs of one state
        later = machine.first[h][q[i] + 1] - x - 1
        a = np.repeat(np.arange(len(x)), later)
        b = ragged(x + 1, later)
        seeds[h - 1].append((machine.to[h][x[a]], machine.to[h][b], r[i[a]] + machine.skip[h][x[a]], r[i[a]] + machine.skip[h][b]))
        z = machine.step(h + 1, s[i], machine.label[h][x]) if h < most else np.full(len(i), -1, np.int64)
        go = z >= 0
        q, r, end = machine.to[h][x], r[i] + machine.skip[h][x], end[i]
        t = np.where(go, t[i] + (machine.skip[h + 1][z] if h < most and len(machine.skip[h + 1]) else 0), -1)
        s = np.where(go, machine.to[h + 1][z] if h < most and len(machine.to[h + 1]) else -1, -1)
    return _enumerate(machine, [tuple(np.concatenate(p) for p in zip(*some)) if some else (np.zeros(0, np.int64),) * 4 for some in seeds])


def _enumerate(machine: Acceptor, seeds: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the seeds (two states, two first rows) lead to by reading the same characters."""
    most = len(seeds) - 1
    # pairs of states by level, each once, with the arcs between them
    pairs, source, target, skips = [None] * (most + 1), [None] * (most + 1), [None] * (most + 1), [None] * (most + 1)
    down = np.zeros(0, np.int64)
    for h in range(most, -1, -1):
        code = seeds[h][0] << 32 | seeds[h][1]
        pairs[h] = np.unique(np.concatenate([code, down]))
        if h:
            a, b = pairs[h] >> 32, pairs[h] & 0xFFFFFFFF
            i, x = machine.arcs(h, a)
            y = machine.step(h, b[i], machine.label[h][x])
            fit = y >= 0
            i, x, y = i[fit], x[fit], y[fit]
            down = machine.to[h][x] << 32 | machine.to[h][y]
            source[h], target[h], skips[h] = i, down, (machine.skip[h][x], machine.skip[h][y])
    live = [np.ones(len(pairs[0]), bool)]
    for h in range(1, most + 1):
        to = np.searchsorted(pairs[h - 1], target[h])
        go = live[h - 1][to] if len(to) else np.zeros(0, bool)
        source[h], target[h], skips[h] = source[h][go], to[go], (skips[h][0][go], skips[h][1][go])
        live.append(np.bincount(source[h], minlength=len(pairs[h])) > 0)
    at, one, two = (np.zeros(0, np.int64) for _ in range(3))
    for h in range(most, -1, -1):
        place = np.searchsorted(pairs[h], seeds[h][0] << 32 | seeds[h][1])
        ok = live[h][place] if len(place) else np.zeros(0, bool)
        at, one, two = np.concatenate([at, place[ok]]), np.concatenate([one, seeds[h][2][ok]]), np.concatenate([two, seeds[h][3][ok]])
        if h:
            count = np.bincount(source[h], minlength=len(pairs[h]))
            first = np.cumsum(count) - count
            arc, item = ragged(first[at], count[at]), np.repeat(np.arange(len(at)), count[at])
            at, one, two = target[h][arc], one[item] + skips[h][0][arc], two[item] + skips[h][1][arc]
    return one, two


def _bucket_pairs(states: Sequence[str], longer: np.ndarray, last: np.ndarray, middles: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a bucket, by their place in it."""
    group = np.unique(np.array(states), return_inverse=True)[1].astype(np.int64)
    size = np.fromiter(map(len, middles), np.int64, len(middles))
    most = max(1, int(size.max()))
    left = np.array(middles, dtype=f"U{most}").view(np.uint32).reshape(len(middles), most)
    column = np.arange(most) - (most - size)[:, None]
    letters = np.where(column >= 0, np.take_along_axis(left, np.maximum(column, 0), 1), 0)
    order = np.lexsort([*letters.T[::-1], longer, group])
    one, two = near_rows(group[order], longer[order], last[order], letters[order], size[order])
    return order[one], order[two]


def _bucket(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    flag = lambda name: rows.column(name).to_numpy().astype(bool)
    one, two = _bucket_pairs(rows.column("state").to_pylist(), flag("longer"), flag("last"), rows.column("middle").to_pylist())
    return one, two, rows.column("word").to_pylist(), rows.column("n").to_numpy()


def _dealt(words: DataFrame):
    """Initial states dealt to buckets whose number grows with the vocabulary."""
    states = initial_states(words)
    buckets = max(1, -(-words.count() * 5 // BUCKET_ROWS))
    return states.withColumn("bucket", F.pmod(F.xxhash64("state"), F.lit(buckets))).groupBy("bucket")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of all pairs of different words of (word, n) that one edit makes equal, each pair once, in no order."""

    def run(rows: pa.Table) -> pa.Table:
        one, two, word, _ = _bucket(rows)
        return pa.table({"word": pa.array([word[i] for i in one], pa.string()), "near": pa.array([word[i] for i in two], pa.string())})

    return _dealt(words).applyInArrow(run, "word string, near string")


def _strongest(rows: pa.Table) -> pa.Table:
    """Per word of a bucket: how many near words it has here, and the most frequent of them (ties: the first in order)."""
    one, two, word, n = _bucket(rows)
    names = np.array(word)
    order = np.lexsort([names, -n])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(order), len(order))
    np.minimum.at(best, one, rank[two])
    np.minimum.at(best, two, rank[one])
    count = np.bincount(one, minlength=len(order)) + np.bincount(two, minlength=len(order))
    some = np.flatnonzero(count)
    top = order[best[some]]
    return pa.table({"word": pa.array([word[i] for i in some], pa.string()), "n_near": pa.array(count[some], pa.int64()),
                     "near": pa.array([word[i] for i in top], pa.string()), "near_n": pa.array(n[top], pa.int64())})


def group(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of (word, n); words must differ, nulls in either column are dropped.

    ``form`` is the most frequent near word (ties: first in code point order) if it is ``factor`` times as frequent at least, else null;
    ``root`` is where following forms ends.  An empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("with a factor under two, forms could go round in circles")
    words = staged(words.select("word", "n").filter("word is not null and n is not null and word <> ''"), "words")
    near = _dealt(words).applyInArrow(_strongest, "word string, n_near long, near string, near_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    strong = -F.col("best.back") >= factor * F.col("n")
    table = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
                                F.when(strong, -F.col("best.back")).alias("form_n")), "forms")
    return table.join(roots(table), "word")


def roots(table: DataFrame) -> DataFrame:
    """(word, root) of (word, form): level by level from the words without a form, each joined to the level above it.

    A form is at least twice as frequent, so there are no more levels than the frequency has binary digits, and no word is the form of
    more words than one edit can make.
    """
    level = staged(table.filter("form is null").select("word", F.col("word").alias("root")), "roots")
    out, below = level, table.filter("form is not null").select("word", "form")
    while True:
        level = staged(below.join(level.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
