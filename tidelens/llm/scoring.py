"""Masked pseudo-likelihood of documents (operator 9).

Every word is hidden in turn and predicted from both sides; the sum of its conditional log-probabilities scores a document.
Four experts predict the hidden word, and a small network weighs them by how often the neighbours occur:

* the window network: the class of the word from the classes of two words on each side (classes are cut by frequency), times the
  word's exact share of its class;
* the words that follow the left neighbour, and those that precede the right one, as counted over the corpus;
* a word met nowhere else, with the constant probability NEW.

Words and pairs of neighbours are counted exactly over all documents, in a table that grows with the corpus: every block of texts
asks, by hash of the word or pair, for the sums over all blocks, and the answers return to the block.  The hidden word is never
its own evidence: its occurrence is taken off every count (so a text says nothing about itself, but its copies do).  The
network of classes is trained on the counts of all windows, the one that weighs the experts on the counts of all kinds of
prediction (probabilities in steps of STEP nats, neighbours' counts in powers of four).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import BLOCK_CHARS, mix64, pack, staged, text_blocks, unpack, width
from .quality import WORD

BUCKETS, CLASSES, SIDE = 1 << 18, 16, 2
WINDOWS = CLASSES ** (2 * SIDE + 1)
SLICE = 1 << 14
#: Steps of log-probabilities; 31 stands for probability 0.
STEP, LEVELS, CONTEXT = 0.6, 32, 8
KINDS = LEVELS**3 * CONTEXT**2
NEW = 2.0**-24
#: Hash of the edge of a text, before its first word and after its last.
EDGE = np.zeros(1, np.uint64)
WORD_MARK, SHIFT = np.uint64(0xA24BAED4963EE407), np.uint64(8)


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers packed byte plane by byte plane: planes of zeros vanish."""
    return pack(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


@dataclass
class Block:
    """Texts as numbers: hashes of the distinct words, number of the word at every place, end of every text."""

    words: np.ndarray
    at: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Block:
        table = _Numbered()
        look = table.__getitem__
        places = [np.fromiter(map(look, found), np.int64, len(found)) for found in map(WORD.findall, texts)]
        words = np.fromiter(map(xxh64_intdigest, table), np.uint64, len(table))
        return cls(words, np.concatenate([np.zeros(0, np.int64), *places]), np.cumsum([len(p) for p in places], dtype=np.int64))

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(_from_planes(row["words"]), _from_planes(row["at"]).astype(np.int64), np.cumsum(_from_planes(row["sizes"]), dtype=np.int64))

    def stored(self) -> dict[str, bytes]:
        return {"words": _planes(self.words), "at": _planes(self.at), "sizes": _planes(np.diff(self.ends, prepend=0))}

    @property
    def buckets(self) -> np.ndarray:
        return (self.words % np.uint64(BUCKETS)).astype(np.int64)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the left and of the right neighbour at every place; len(words) is the edge."""
        edge, sizes = len(self.words), np.diff(self.ends, prepend=0)
        left, right = np.concatenate([[edge], self.at[:-1]])[: len(self.at)], np.concatenate([self.at[1:], [edge]])[: len(self.at)]
        full = self.ends[sizes > 0]
        left[full - sizes[sizes > 0]] = edge
        right[full - 1] = edge
        return left, right


@dataclass
class Asked:
    """Distinct keys of a block in ascending order, how often each occurs, and where the keys of words and pairs are.

    ``words[i]`` is the place of word i's key (the last is the edge's), ``before`` and ``after`` those of the pairs that the
    word at every place forms with its neighbours.
    """

    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    before: np.ndarray
    after: np.ndarray


def ask(block: Block) -> Asked:
    hashes, edge = np.concatenate([block.words, EDGE]), len(block.words)
    left, right = block.sides()
    texts = int((np.diff(block.ends, prepend=0) > 0).sum())
    last = np.flatnonzero(right == edge)
    a, b = np.concatenate([left, block.at[last]]), np.concatenate([block.at, np.full(len(last), edge)])
    pairs, where, n = np.unique(a * (edge + 1) + b, return_inverse=True, return_counts=True)
    first, second = hashes[pairs // (edge + 1)], hashes[pairs % (edge + 1)]
    keys = np.concatenate([mix64(hashes ^ WORD_MARK), mix64(mix64(first.copy()) + second)]) >> SHIFT
    counts = np.concatenate([np.bincount(block.at, minlength=edge), [texts], n]).astype(np.int64)
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair = rank[edge + 1 :][where.ravel()]
    before, after = pair[: len(left)], np.concatenate([pair[1 : len(left)], [0]])[: len(left)]
    after[last] = pair[len(left) :]
    return Asked(keys[order], counts[order], rank[: edge + 1], before, after)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows, texts in text_blocks(batches, "text", 2 * BLOCK_CHARS):
        kept = rows.column("row").combine_chunks()
        yield pa.record_batch({"block": pa.array([number], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
                               **{name: pa.array([data], pa.binary()) for name, data in Block.of(texts).stored().items()}})


def blocks(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Table of blocks of texts as numbers, written once; later passes read it instead of the texts."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return staged(rows.mapInArrow(_blocks, f"block long, rows array<{kind}>, words binary, at binary, sizes binary"), "scoring-blocks")


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(-1, SLICE)
    full = np.flatnonzero(parts.any(1))
    return pa.record_batch({"slice": pa.array(full, pa.int32()), "sums": pa.array([pack(parts[i]) for i in full], pa.binary())})


def _add_slices(rows: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for x in rows.column("sums"):
        total += unpack(x.as_py(), np.int64)
    return pa.table({"slice": rows.column("slice")[:1], "sums": pa.array([pack(total)], pa.binary())})


def _summed(table: DataFrame, count, size: int) -> np.ndarray:
    """Sum of ``count(row)``, arrays of ``size`` numbers, over all rows of ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += count(batch.slice(i, 1).to_pylist()[0])
        yield _slices(total)

    sums = table.mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(_add_slices, "slice int, sums binary")
    out = np.zeros((size // SLICE, SLICE), np.int64)
    for row in sums.toLocalIterator():  # ``size`` numbers in all
        out[row["slice"]] = unpack(row["sums"], np.int64)
    return out.ravel()


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class 1 to CLASSES - 1 of every bucket: equal shares of all words, in order of frequency; unseen buckets are in the last."""
    order = np.argsort(-counts, kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    out = np.empty(len(counts), np.int64)
    out[order] = 1 + np.minimum(before * (CLASSES - 1) // max(1, counts.sum()), CLASSES - 2)
    out[counts == 0] = CLASSES - 1
    return out


def contexts(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code of the neighbours of every word: SIDE before and SIDE after it in the same text, class 0 beyond its edges."""
    n = len(classes)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    first, last = np.repeat(starts, sizes), np.repeat(ends, sizes)
    at, out = np.arange(n), np.zeros(n, np.int64)
    for step in [*range(-SIDE, 0), *range(1, SIDE + 1)]:
        place = at + step
        inside = (place >= first) & (place < last)
        out = out * CLASSES + np.where(inside, classes[np.clip(place, 0, max(0, n - 1))], 0)
    return out


@dataclass
class Network:
    """Class of a word from the classes of its neighbours: one hidden layer, softmax over classes."""

    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: np.ndarray

    def hidden(self, codes: np.ndarray) -> np.ndarray:
        total = self.bias + np.zeros((len(codes), 1))
        for k in range(2 * SIDE):
            total = total + self.first[k, codes // CLASSES ** (2 * SIDE - 1 - k) % CLASSES]
        return np.tanh(total)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        logits = self.hidden(codes) @ self.second + self.last
        return logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)


def train(windows: np.ndarray, hidden: int = 48, rounds: int = 6, batch: int = 8192, seed: int = 5) -> Network:
    """Adam on all kinds of windows, each with the weight of its count; without windows the network stays near uniform."""
    rng = np.random.default_rng(seed)
    net = Network(rng.standard_normal((2 * SIDE, CLASSES, hidden)) * 0.3, np.zeros(hidden), rng.standard_normal((hidden, CLASSES)) * 0.1, np.zeros(CLASSES))
    kinds = np.flatnonzero(windows)
    if len(kinds) == 0:
        return net
    weight = windows[kinds] / windows.sum()
    codes, target = kinds // CLASSES, kinds % CLASSES
    state, step = {}, 0
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(len(kinds)), max(1, len(kinds) // batch)):
            step += 1
            w = (weight[at] / weight[at].sum())[:, None]
            inner = net.hidden(codes[at])
            logits = inner @ net.second + net.last
            error = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))
            error[np.arange(len(at)), target[at]] -= 1
            error *= w
            back = error @ net.second.T * (1 - inner**2)
            first = np.stack([np.eye(CLASSES)[codes[at] // CLASSES ** (2 * SIDE - 1 - k) % CLASSES].T @ back for k in range(2 * SIDE)])
            for name, slope in (("second", inner.T @ error), ("last", error.sum(0)), ("first", first), ("bias", back.sum(0))):
                m, v = state.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
                state[name] = m, v
                setattr(net, name, getattr(net, name) - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
    return net


@dataclass
class Model:
    """What the window network needs in a task, all of it of fixed size: class of every bucket, words in a class, log-probability
    of classes by context."""

    classes: np.ndarray
    mass: np.ndarray
    table: np.ndarray


def fit(corpus: DataFrame) -> Model:
    """Classes and window network of all blocks of ``corpus``."""
    stored = corpus.select("words", "at", "sizes")

    def words(row: dict) -> np.ndarray:
        block = Block.read(row)
        return np.bincount(block.buckets, np.bincount(block.at, minlength=len(block.words)), BUCKETS).astype(np.int64)

    counts = _summed(stored, words, BUCKETS)
    classes = classes_of(counts)
    sent = corpus.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def windows(row: dict) -> np.ndarray:
        block = Block.read(row)
        kinds = sent.value[block.buckets].astype(np.int64)[block.at]
        return np.bincount(contexts(kinds, block.ends) * CLASSES + kinds, minlength=WINDOWS)

    network = train(_summed(stored, windows, WINDOWS))
    table = np.concatenate([network.log_probabilities(c) for c in np.array_split(np.arange(CLASSES ** (2 * SIDE)), 16)])
    return Model(classes, np.bincount(classes, counts, CLASSES), table)


def _requests(buckets: int, counted: bool, scored: bool):
    """Keys of every block, dealt to buckets by their highest bits; the last column tells whether an answer is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asked = ask(Block.read(row))
                home = (asked.keys >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))
                full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                part = [slice(cuts[b], cuts[b + 1]) for b in full]
                yield pa.record_batch({"block": pa.array([row["block"]] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()),
                                       "keys": pa.array([_planes(np.diff(asked.keys[p], prepend=np.uint64(0))) for p in part], pa.binary()),
                                       "counts": pa.array([_planes(asked.counts[p] * counted) for p in part], pa.binary()),
                                       "wanted": pa.array([scored] * len(full), pa.bool_())})

    return run


def _answers(rows: pa.Table) -> pa.Table:
    """Sum of every key over all blocks, back in the order in which each block asked."""
    lists = [np.cumsum(_from_planes(k.as_py()), dtype=np.uint64) for k in rows.column("keys")]
    ends = np.cumsum([len(k) for k in lists])
    keys = np.concatenate(lists)
    del lists
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    del keys
    counts = np.concatenate([_from_planes(c.as_py()) for c in rows.column("counts")])[order].astype(np.int64)
    sums = np.add.reduceat(counts, np.flatnonzero(new))
    back = np.empty(len(order), np.int64)
    back[order] = sums[np.cumsum(new) - 1]
    wanted = np.flatnonzero(rows.column("wanted").to_numpy(zero_copy_only=False))
    return pa.table({"block": rows.column("block").take(pa.array(wanted)), "bucket": rows.column("bucket").take(pa.array(wanted)),
                     "sums": pa.array([_planes(back[(ends[i - 1] if i else 0) : ends[i]]) for i in wanted], pa.binary())})


def level(p: np.ndarray) -> np.ndarray:
    """Step of a probability: the nearest multiple of STEP nats below 0; the last step is that of 0."""
    with np.errstate(divide="ignore"):
        steps = np.minimum(np.rint(-np.log(p) / STEP), LEVELS - 2)
    return np.where(p > 0, np.maximum(steps, 0), LEVELS - 1).astype(np.int64)


def magnitude(n: np.ndarray) -> np.ndarray:
    """0 for none, then powers of four."""
    return np.minimum(CONTEXT - 1, np.ceil(np.log2(np.maximum(n, 0) + 1) / 2)).astype(np.int64)


def predictions(block: Block, asked: Asked, sums: np.ndarray, model: Model, own: int) -> np.ndarray:
    """Kind of prediction at every place: steps of the three counted experts, magnitudes of the neighbours' counts.

    ``sums`` are the corpus counts of the keys; ``own`` is 1 where the block is part of the corpus, so that the hidden word is
    taken off, and 0 where it is not.
    """
    left, right = block.sides()
    kinds = model.classes[block.buckets][block.at]
    words = sums[asked.words]
    n_left, n_right = words[left] - own, words[right] - own
    share = (words[block.at] - own) / np.maximum(1, model.mass[kinds] - own)
    net = np.exp(model.table[contexts(kinds, block.ends), kinds]) * share
    before, after = (sums[asked.before] - own) / np.maximum(1, n_left), (sums[asked.after] - own) / np.maximum(1, n_right)
    code = (level(net) * LEVELS + level(before)) * LEVELS + level(after)
    return (code * CONTEXT + magnitude(n_left)) * CONTEXT + magnitude(n_right)


def expert_probabilities(codes: np.ndarray) -> np.ndarray:
    """Probability that each of the four experts gives to the hidden word, for kinds of prediction."""
    steps = codes // CONTEXT**2
    value = np.exp(-STEP * np.arange(LEVELS))
    value[-1] = 0
    return np.stack([value[steps // LEVELS**2], value[steps // LEVELS % LEVELS], value[steps % LEVELS], np.full(len(codes), NEW)], axis=1)


def weigh(counts: np.ndarray, hidden: int = 12, rounds: int = 40, steps: int = 20, seed: int = 3) -> np.ndarray:
    """Weights of the experts by magnitude of both neighbours' counts: a network trained by expectation-maximisation on all kinds.

    Each round finds which share of its words every expert explains, then moves the network towards these shares.
    """
    cells = CONTEXT**2
    x = np.concatenate([np.repeat(np.eye(CONTEXT), CONTEXT, 0), np.tile(np.eye(CONTEXT), (CONTEXT, 1))], axis=1)
    rng = np.random.default_rng(seed)
    net = [rng.standard_normal((2 * CONTEXT, hidden)) * 0.3, np.zeros(hidden), np.zeros((hidden, 4)), np.zeros(4)]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net]

    def weights() -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(x @ net[0] + net[1])
        logits = inner @ net[2] + net[3]
        return inner, np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))

    kinds = np.flatnonzero(counts)
    if len(kinds) == 0:
        return weights()[1]
    experts, cell, n, step = expert_probabilities(kinds), kinds % cells, counts[kinds], 0
    for _ in range(rounds):
        joint = experts * weights()[1][cell]
        joint *= (n / joint.sum(1))[:, None]
        found = np.stack([np.bincount(cell, joint[:, k], cells) for k in range(4)], axis=1)
        found /= counts.sum()
        for _ in range(steps):
            step += 1
            inner, out = weights()
            error = out * found.sum(1, keepdims=True) - found
            back = error @ net[2].T * (1 - inner**2)
            for k, slope in enumerate((x.T @ back, back.sum(0), inner.T @ error, error.sum(0))):
                m, v = moments[k]
                moments[k] = m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
                net[k] = net[k] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights()[1]


def log_table(weights: np.ndarray) -> np.ndarray:
    """Log-probability of the hidden word for every kind of prediction."""
    codes = np.arange(KINDS)
    return np.log((expert_probabilities(codes) * weights[codes % CONTEXT**2]).sum(1))


def _predict(model, own: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = Block.read(texts.select(["words", "at", "sizes"]).to_pylist()[0])
        parts = sorted((r["bucket"], r["sums"]) for r in found.select(["bucket", "sums"]).to_pylist())
        sums = np.concatenate([_from_planes(p) for _, p in parts]).astype(np.int64)
        asked = ask(block)
        if len(sums) != len(asked.keys):
            raise RuntimeError("a block got answers to other questions than it asked")
        codes = predictions(block, asked, sums, model.value, own)
        return pa.table({"rows": texts.column("rows"), "sizes": texts.column("sizes"), "codes": pa.array([_planes(codes)], pa.binary())})

    return run


def score(docs: DataFrame, corpus: DataFrame | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with n_words, log_likelihood (summed) and mean_log_prob.

    The model is that of ``corpus``; without one, that of ``docs`` itself, and then every hidden word is taken off the counts.
    The experts are weighed on the rows of ``docs``.  Null and empty texts and those without words have 0 words, log_likelihood 0
    and a null mean; rows keep their multiplicity and null keys; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own, mine = int(corpus is None), blocks(docs, text, keep)
    known = mine if own else blocks(corpus, text, ())
    model = spark.sparkContext.broadcast(fit(known))
    shape, stored = "block long, bucket int, keys binary, counts binary, wanted boolean", ("block", "words", "at", "sizes")
    asked = mine.select(*stored).mapInArrow(_requests(width(spark), bool(own), True), shape)
    if not own:
        asked = asked.unionAll(known.select(*stored).mapInArrow(_requests(width(spark), True, False), shape))
    found = asked.groupBy("bucket").applyInArrow(_answers, "block long, bucket int, sums binary")
    kind = mine.schema["rows"].dataType.simpleString()
    cogrouped = mine.groupBy("block").cogroup(found.groupBy("block"))
    coded = staged(cogrouped.applyInArrow(_predict(model, own), f"rows {kind}, sizes binary, codes binary"), "scoring-kinds")
    counts = _summed(coded.select("codes"), lambda row: np.bincount(_from_planes(row["codes"]).astype(np.int64), minlength=KINDS), KINDS)
    table = spark.sparkContext.broadcast(log_table(weigh(counts)))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = _from_planes(batch.column("sizes")[i].as_py()).astype(np.int64)
                sums = np.concatenate([[0.0], np.cumsum(table.value[_from_planes(batch.column("codes")[i].as_py()).astype(np.int64)])])
                ends = np.cumsum(sizes)
                yield pa.record_batch({"row": batch.column("rows")[i].values, "n_words": pa.array(sizes, pa.int64()), "log_likelihood": pa.array(sums[ends] - sums[ends - sizes], pa.float64())})

    row = mine.schema["rows"].dataType.elementType.simpleString()
    out = coded.mapInArrow(total, f"row {row}, n_words long, log_likelihood double")
    return out.select("row.*", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_prob"))
