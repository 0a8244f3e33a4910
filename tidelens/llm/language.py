"""Language of whole texts by sparse multinomial logistic regression (operator 12).

A text is a sequence of lower-case letters; whatever is no letter is one blank.  Its features are the counts of all grams of
one to three characters, exact and not hashed, weighted by the logarithm of their inverse document frequency and scaled to
length one.

1. sample: about ``sample`` labelled texts, the same number of each language, picked by hash of the id; grams that two of
   them share are the vocabulary, so the model and what the driver holds are bounded by the sample;
2. statistics: every task counts in how many of all texts to learn from each gram of the vocabulary occurs; Spark adds up;
3. training: follow the regularised leader with an elastic net, text by text in order of the hash; a temperature that
   minimises the loss of texts held back from training calibrates the probabilities;
4. prediction: one pass over all rows, a product of counts and weights for many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack, staged, text_blocks, unpack

LONGEST = 3
#: Labelled texts that the model learns from, all languages together.
SAMPLE = 2_048
#: Up to so many languages, their table goes to every task, so that no language's texts meet in one; beyond, no language is so common.
FEW_LANGUAGES = 20_000
#: Parts of the sample; each is held back once, and the temperature is fitted to what the others say about it.
FOLDS = 3
#: What a text without letters gets.
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a blank.  Unicode has no letters in planes 4 to 16."""
    out = np.full(0x110000, 32, np.int32)
    for c in range(0x40000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters with one blank wherever there are others and around every text, number of the text each is from)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    letters = letter_table()[np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (text[1:] != text[:-1])
    return letters[kept], text[kept]


def grams_of(letters: np.ndarray, text: np.ndarray, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, number of the text each is from), ``step`` letters at a time: one to three letters packed in 21 bits each, not blank
    alone and never across texts."""
    for at in range(0, len(letters), step):
        grams, owner, code = [], [], 0
        for k in range(1, LONGEST + 1):
            n = min(step, len(letters) - k + 1 - at)
            if n <= 0:
                break
            code = (code[:n] if k > 1 else 0) | letters[at + k - 1 : at + k - 1 + n].astype(np.int64) << 21 * (k - 1)
            fit = (text[at : at + n] == text[at + k - 1 : at + k - 1 + n]) & (code != (32 if k == 1 else 32 | 32 << 21))
            grams.append(code[fit])
            owner.append(text[at : at + n][fit])
        yield np.concatenate(grams), np.concatenate(owner)


class Vocabulary:
    """Numbers of known grams: levels of hashed slots with one gram each; what collides in one level lies in the next."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.levels = grams, []
        rest = np.arange(len(grams))
        while len(rest):
            bits = max(8, int(len(rest)).bit_length() + 2)
            table = np.full(1 << bits, -1, np.int32)
            at = self.slot(grams[rest], len(self.levels), bits)
            table[at] = rest
            self.levels.append((bits, table))
            rest = rest[table[at] != rest]

    @staticmethod
    def slot(grams: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93 + 2 * level)
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.grams)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Number of every gram, -1 for unknown ones."""
        out = np.full(len(grams), -1, np.int32)
        todo = np.arange(len(grams))
        for level, (bits, table) in enumerate(self.levels):
            some = grams[todo]
            got = table[self.slot(some, level, bits)]
            hit = (got >= 0) & (self.grams[got] == some)
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
            if not len(todo):
                break
        return out


def gram_counts(texts: list[str], vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, counts of texts x grams, whether each text has a letter) for a few texts at a time."""
    at, step = 0, max(1, 4_000_000 // max(1, len(vocabulary)))
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < step and (end == at or chars + len(texts[end]) < 400_000):
            chars += len(texts[end])
            end += 1
        letters, text = letters_of(texts[at:end])
        flat = np.zeros((end - at) * len(vocabulary), np.int64)
        for grams, owner in grams_of(letters, text):
            number = vocabulary.find(grams)
            known = number >= 0
            flat += np.bincount(owner[known] * np.int64(len(vocabulary)) + number[known], minlength=len(flat))
        lettered = np.bincount(text[letters != 32], minlength=end - at) > 0
        yield at, flat.reshape(end - at, len(vocabulary)), lettered
        at = end


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax((self.features(counts) @ self.weights + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(texts: list[tuple[np.ndarray, np.ndarray, int]], grams: int, classes: int, rounds: int = 3, alpha: float = 1.0, beta: float = 1.0,
                      lasso: float = 0.02, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (grams x classes) and bias by the proximal form of follow-the-regularised-leader; ``lasso`` makes weights zero.

    ``texts`` are (gram numbers, values, class).  Every coordinate has its own rate, which falls with the slopes it has seen.
    The bias is the last coordinate and is not penalised.
    """
    z, n = np.zeros((grams + 1, classes)), np.zeros((grams + 1, classes))

    def weights(at, lasso=lasso, ridge=ridge):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) > lasso, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(ni)) / alpha + ridge), 0.0)

    for _ in range(rounds):
        for number, value, label in texts:
            w, b = weights(number), weights(grams, 0.0, 0.0)
            p = softmax(value @ w + b)
            p[label] -= 1
            for at, own, slope in ((number, w, value[:, None] * p), (grams, b, p)):
                square = slope * slope
                z[at] += slope - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * own
                n[at] += square
    return weights(slice(0, grams)), weights(grams, 0.0, 0.0)


def best_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    if not len(label):
        return 1.0
    choices = np.exp(np.linspace(np.log(0.1), np.log(8), 101))
    loss = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-300).mean() for t in choices]
    return float(choices[int(np.argmin(loss))])


def in_training(key: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text leaves a remainder other than 1 by 3."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 != 1, F.lit(True))


def _sampled(learn: DataFrame, sample: int) -> list[dict]:
    """Gram counts of about ``sample`` texts, the same number of each language, by hash; never more than twice ``sample``."""
    sizes = staged(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")), "languages")
    languages = sizes.count()
    quota = sizes.select("lang", (F.lit(sample / max(1, languages)) / F.col("of_lang")).alias("share"))
    if languages <= FEW_LANGUAGES:
        quota = F.broadcast(quota)
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    chosen = learn.withColumn("order", spread).join(quota, "lang").filter(F.col("order") < F.col("share") * (1 << 30)).select("order", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"grams": [], "counts": []}
            for text in batch.column("text").to_pylist():
                grams, counts = np.unique(np.concatenate([g for g, _ in grams_of(*letters_of([text]))]), return_counts=True)
                out["grams"].append(pack(np.diff(grams, prepend=0)))
                out["counts"].append(pack(counts.astype(np.int32)))
            yield pa.record_batch({"order": batch.column("order"), "lang": batch.column("lang"), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    rows = chosen.mapInArrow(run, "order long, lang string, grams binary, counts binary").limit(2 * sample).toArrow().to_pylist()
    for row in rows:
        row["grams"], row["counts"] = np.cumsum(unpack(row["grams"], np.int64)), unpack(row["counts"], np.int32)
    return sorted((r for r in rows if len(r["grams"])), key=lambda r: (r["order"], r["lang"], r["grams"].tobytes()))


def _document_frequencies(learn: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many texts each gram of the vocabulary occurs, and how many texts there are."""
    shared = learn.sparkSession.sparkContext.broadcast(vocabulary)  # grams of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(shared.value) + 1, np.int64), 0
        for _, _, texts in text_blocks(batches, "text"):
            for _, counts, _ in gram_counts(texts, shared.value):
                seen[:-1] += (counts > 0).sum(0)
            n += len(texts)
        seen[-1] = n
        some = np.flatnonzero(seen)
        yield pa.record_batch({"gram": pa.array(some, pa.int64()), "n": pa.array(seen[some], pa.int64())})

    total = np.zeros(len(vocabulary) + 1, np.int64)
    rows = learn.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return total[:-1], int(total[-1])


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows of ``in_training`` with a language and a text.  Without any, the model knows no language."""
    names = [F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")]
    learn = docs.filter(in_training(key)).select(*names).filter("lang is not null and text is not null")
    rows = _sampled(learn, sample)
    languages = sorted({r["lang"] for r in rows})
    grams, often = np.unique(np.concatenate([r["grams"] for r in rows] or [np.zeros(0, np.int64)]), return_counts=True)
    vocabulary = Vocabulary(grams[often > 1] if (often > 1).any() else grams)
    frequency, n = _document_frequencies(learn, vocabulary) if rows else (np.zeros(0), 0)
    model = Model(vocabulary, np.log((1 + n) / (1 + frequency)) + 1, languages, np.zeros((len(vocabulary), len(languages))), np.zeros(len(languages)))
    texts = []
    for row in rows:
        number = vocabulary.find(row["grams"])
        known = number >= 0
        value = row["counts"][known] * model.idf[number[known]]
        texts.append((number[known], value / max(np.sqrt((value * value).sum()), 1e-12), languages.index(row["lang"])))
    if len(languages) > 1:
        logits = np.zeros((len(texts), len(languages)))
        for fold in range(min(FOLDS, len(texts))):
            w, b = follow_the_leader([t for i, t in enumerate(texts) if i % FOLDS != fold], len(vocabulary), len(languages))
            logits[fold::FOLDS] = [v @ w[i] + b for i, v, _ in texts[fold::FOLDS]]
        model.temperature = best_temperature(logits, np.array([c for *_, c in texts]))
        model.weights, model.bias = follow_the_leader(texts, len(vocabulary), len(languages))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred`` and ``score``, the calibrated probability of that language.

    A null text and a text without letters get ``und`` and 0, as does any text where the model knows no language.  A text of
    unknown grams only gets the language that the bias favours.  Rows keep their multiplicity and null keys; an empty table
    gives an empty one; whole texts are read, many at a time or one long one alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams of the sample x languages
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, block, texts in text_blocks(batches, "text"):
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at, counts, lettered in gram_counts(texts, model.vocabulary) if model.languages else ():
                p = model.probabilities(counts)
                for i, k in enumerate(p.argmax(-1)):
                    if lettered[i]:
                        best[at + i], score[at + i] = model.languages[k], p[i, k]
            yield from pa.table({"row": block.column("row"), "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}).to_batches(4096)

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("row.*", "lang_pred", "score")
