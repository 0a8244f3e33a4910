"""Quality classifier on random-indexing word vectors (operator 3).

Words are hashed to a fixed number of buckets.  Every bucket has a sparse random index vector; its context vector is the sum
of the index vectors around all its occurrences in the whole corpus.  Tasks add up their own counts and send one packed table
each; the sum has buckets x dims numbers whatever the corpus, which bounds what the driver and the broadcast hold.

A document is the mean and the spread of its words' vectors and how alike neighbours are.  A two-layer network in numpy learns the labels from at most
``sample`` labelled rows, and a temperature fitted on rows held back from training calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack, staged, unpack

WORD = re.compile(r"\w+|[^\w\s]+")
BUCKETS, DIMS, MARKS, REACH = 1 << 15, 64, 4, 2
FEATURES = 2 * DIMS + 1
SLICE = 512
#: Labelled rows that training takes, chosen by hash of the id.
SAMPLE = 12_000
#: Words that a task holds at a time, and of these, how many as vectors.
PIECE, STEP = 200_000, 16_384


class _Bucket(dict):
    """Bucket of each word; a bounded table of words seen."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode()) % self.buckets
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(4211)
    return rng.integers(0, DIMS, (BUCKETS, MARKS)), rng.choice([-1.0, 1.0], (BUCKETS, MARKS))


def word_runs(texts: Iterator[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, ends) of whole texts, many at a time; a text longer than a piece comes alone."""
    table = _Bucket(buckets)
    look, parts, ends, n = table.__getitem__, [], [], 0
    for text in texts:
        words = WORD.findall(text or "")
        parts.append(np.fromiter(map(look, words), np.int32, len(words)))
        n += len(words)
        ends.append(n)
        if n >= PIECE:
            yield np.concatenate(parts), np.array(ends)
            parts, ends, n = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(ends)


def add_contexts(total: np.ndarray, buckets: np.ndarray, ends: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of all neighbours within REACH, in the same text, to each word's bucket."""
    n = len(buckets)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for gap in range(1, REACH + 1):
        if n <= gap:
            break
        same = text[gap:] == text[:-gap]
        a, b = buckets[gap:][same].astype(np.int64), buckets[:-gap][same].astype(np.int64)
        for own, other in ((a, b), (b, a)):
            for m in range(MARKS):
                total += np.bincount(own * DIMS + places[other, m], signs[other, m], BUCKETS * DIMS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for value in batch.column("text"):
            yield value.as_py()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, marks = np.zeros(BUCKETS * DIMS), index_vectors()
    seen = False
    for buckets, ends in word_runs(_texts(batches)):
        add_contexts(total, buckets, ends, *marks)
        seen = True
    if seen:
        slices = total.astype(np.int64).reshape(-1, SLICE * DIMS)
        yield pa.record_batch({"slice": pa.array(np.arange(len(slices)), pa.int32()), "sums": pa.array([pack(s) for s in slices], pa.binary())})


def _sum_slices(rows: pa.Table) -> pa.Table:
    total = np.zeros(SLICE * DIMS, np.int64)
    for x in rows.column("sums"):
        total += unpack(x.as_py(), np.int64)
    return pa.table({"slice": rows.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vector of every bucket, from all texts; zero for buckets that never occur."""
    sums = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_contexts, "slice int, sums binary").groupBy("slice").applyInArrow(_sum_slices, "slice int, sums binary")
    total = np.zeros((BUCKETS // SLICE, SLICE * DIMS))
    for row in sums.toLocalIterator():  # BUCKETS x DIMS numbers in all
        total[row["slice"]] = np.frombuffer(row["sums"], np.int64)
    return unit(total.reshape(BUCKETS, DIMS))


def unit(total: np.ndarray) -> np.ndarray:
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(buckets: np.ndarray, ends: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text, and mean cosine of neighbours; zeros for a text without words.

    Words are taken a bounded number at a time, so a very long text needs no more memory than others.
    """
    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(n), sizes)
    total, square, beside = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros(n)
    for lo in range(0, len(buckets), STEP):
        v, t = vectors[buckets[max(0, lo - 1) : lo + STEP]], text[max(0, lo - 1) : lo + STEP]
        near = np.einsum("ij,ij->i", v[1:], v[:-1])
        beside += np.bincount(t[1:], np.where(t[1:] == t[:-1], near, 0), n)
        own = int(lo > 0)  # the word before this piece is there for its neighbour only
        v, t = v[own:], t[own:]
        cut = np.flatnonzero(np.diff(t, prepend=-1))
        total[t[cut]] += np.add.reduceat(v, cut, axis=0)
        square[t[cut]] += np.add.reduceat(v * v, cut, axis=0)
    count = np.maximum(sizes, 1)[:, None]
    mean = total / count
    return np.concatenate([mean, np.sqrt(np.maximum(square / count - mean**2, 0)), beside[:, None] / np.maximum(count - 1, 1)], axis=1).astype(np.float32)


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        for batch in batches:
            at = 0
            for buckets, ends in word_runs(v.as_py() for v in batch.column("text")):
                f = pool(buckets, ends, table)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))
                yield pa.record_batch({"row": batch.column("row").slice(at, len(f)), "features": lists})
                at += len(f)

    return run


def features(docs: DataFrame, vectors: np.ndarray, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row in the struct ``row``, with ``features`` of its whole text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS numbers
    return rows.mapInArrow(_features(table), f"row {rows.schema['row'].dataType.simpleString()}, features array<float>")


@dataclass
class Network:
    """Probability of label 1: sigmoid of (second layer of relu of the first layer of scaled features) over the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 40, seed: int = 7) -> Network:
    """Fit by Adam on four fifths of the rows and fit the temperature on the rest.

    Without rows of both labels the score is the share of label 1 (0.5 without rows).
    """
    d = x.shape[1] if x.ndim == 2 else FEATURES
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    net.centre, net.scale = x[own].mean(0), x[own].std(0) + 1e-4
    net.first = rng.standard_normal((d, hidden)) * np.sqrt(2 / d)
    net.second = rng.standard_normal(hidden) * np.sqrt(1 / hidden)
    z = (x - net.centre) / net.scale
    state = {}

    def adam(name: str, value, slope, step: int):
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        state[name] = m, v
        return value - 0.002 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    step = 0
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            step += 1
            inner = np.maximum(z[at] @ net.first + net.first_bias, 0)
            p = 1 / (1 + np.exp(-np.clip(inner @ net.second + net.second_bias, -40, 40)))
            error = (p - y[at]) / len(at)
            back = error[:, None] * net.second * (inner > 0)
            grads = {"second": inner.T @ error + 1e-5 * net.second, "second_bias": error.sum(), "first": z[at].T @ back + 1e-5 * net.first, "first_bias": back.sum(0)}
            for name, slope in grads.items():
                setattr(net, name, adam(name, getattr(net, name), slope, step))
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def in_training(key: str = "doc_id"):
    """Rows that labels may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % 5 != 0


def fit(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Network:
    """Train on about ``sample`` labelled rows of ``table`` (struct ``row`` with the key, ``features``): those whose id has the
    smallest hashes, all of them if there are fewer.  What reaches the driver is bounded by twice ``sample``."""
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0)).filter(in_training("id")).distinct()
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = table.select(F.col(f"row.`{key}`").alias("id"), "features").join(chosen, "id").limit(2 * sample).toArrow().combine_chunks().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("features").chunks] or [np.zeros(0)]).reshape(-1, FEATURES)
    return train(x.astype(np.float64), rows.column("y").to_numpy())


def score(table: DataFrame, network: Network) -> DataFrame:
    """The columns of ``row`` and ``score``: the calibrated probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.record_batch({"row": batch.column("row"), "score": pa.array(network(x), pa.float64())})

    return table.mapInArrow(run, f"row {table.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(key, score) of every row of ``docs``, learned from the labelled ones.

    Null and empty texts are scored like any other (no words: zero features); rows keep their multiplicity and null keys;
    null labels are ignored; an empty table gives an empty one; other columns are not read.
    """
    table = staged(features(docs, word_vectors(docs, text), text, [key]), "features")
    return score(table, fit(table, labels, key, label, sample))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` with all their columns whose score is ``least`` or more."""
    vectors = word_vectors(docs, text)
    network = fit(staged(features(docs, vectors, text, [key]), "features"), labels, key, label, sample)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{text}`").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                good = [s >= least for buckets, ends in word_runs(v.as_py() for v in batch.column("text")) for s in network(pool(buckets, ends, table.value).astype(np.float64))]
                yield batch.select(["row"]).filter(pa.array(good, pa.bool_()))

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
