"""Trained operators: held-out accuracy, plain sums and the handling of odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from tidelens.llm import quality, scoring

from .helpers import empty, messy, prose, texts_of


def labelled(spark, n=400):
    r, docs, labels = random.Random(8), [], []
    for i in range(n):
        good = r.random() < 0.8
        text = prose(i, r.randrange(20, 90))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_classifier_separates_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    out = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(out[i] >= 0.3) == bool(truth[i]) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values())


def test_classifier_does_not_learn_from_held_out_rows(spark):
    docs, labels, truth = labelled(spark, 150)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    same = lambda l: sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(docs, l).collect())
    assert same(labels) == same(other)


def test_classifier_on_odd_rows(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (6, 1), (7, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels)
    assert out.columns == ["doc_id", "score"] and out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(empty(spark), labels).collect() == []
    assert {round(r["score"], 6) for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, labels, least=0.0)
    assert kept.columns == docs.columns and sorted(map(repr, texts_of(kept))) == sorted(map(repr, texts_of(docs)))


def test_word_vectors_are_plain_sums(spark):
    texts = ["a b c a", "c b", "", "d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    places, signs = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        words = [zlib.crc32(w.encode()) % quality.BUCKETS for w in t.split()]
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    np.add.at(total[w], places[words[j]], signs[words[j]])
    assert np.allclose(quality.word_vectors(docs), quality.unit(total))


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, quality.FEATURES))
    y = (x[:, 0] + r.standard_normal(3000) > 0).astype(float)
    net = quality.train(x, y)
    p = net(x)
    assert 0.25 <= net.temperature <= 8 and abs(p[y == 1].mean() - p[y == 0].mean()) > 0.2


def plain_codes(texts, corpus, model, own):
    """Kind of prediction of every word by plain counting of words and neighbours."""
    words, pairs = Counter(), Counter()
    for t in corpus:
        found = [None, *scoring_words(t), None]
        if len(found) > 2:
            words.update(found[:-1])
            pairs.update(zip(found, found[1:]))
    out = []
    for t in texts:
        found = scoring_words(t)
        kinds = [int(model.classes[xxh64_intdigest(w) % scoring.BUCKETS]) for w in found]
        codes = []
        for k, w in enumerate(found):
            code = 0
            for step in (-2, -1, 1, 2):
                code = code * scoring.CLASSES + (kinds[k + step] if 0 <= k + step < len(kinds) else 0)
            left, right = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
            n_left, n_right = words[left] - own, words[right] - own
            net = math.exp(model.table[code, kinds[k]]) * (words[w] - own) / max(1, model.mass[kinds[k]] - own)
            p = np.array([net, (pairs[left, w] - own) / max(1, n_left), (pairs[w, right] - own) / max(1, n_right)])
            steps = scoring.level(p)
            size = scoring.magnitude(np.array([n_left, n_right]))
            codes.append(int((((steps[0] * 32 + steps[1]) * 32 + steps[2]) * 8 + size[0]) * 8 + size[1]))
        out.append(codes)
    return out


def plain_scores(rows, corpus, model, own):
    codes = plain_codes([t for _, t in rows], corpus, model, own)
    table = scoring.log_table(scoring.weigh(np.bincount([c for x in codes for c in x], minlength=scoring.KINDS)))
    return sorted((repr(i), len(x), round(float(sum(table[c] for c in x)), 4)) for (i, _), x in zip(rows, codes))


def test_scores_are_plain_sums_of_masked_predictions(spark):
    docs = messy(spark).repartition(3)
    rows = texts_of(docs)
    model = scoring.fit(scoring.blocks(docs, "text", ()))
    got = scoring.score(docs)
    assert got.columns == ["doc_id", "n_words", "log_likelihood", "mean_log_prob"]
    assert sorted((repr(r["doc_id"]), r["n_words"], round(r["log_likelihood"], 4)) for r in got.collect()) == plain_scores(rows, [t for _, t in rows], model, 1)
    other = spark.createDataFrame([(1, prose(6, 500), "x"), (2, "never met", "y"), (3, None, "z")], "doc_id long, text string, rows string")
    got = [(repr(r["doc_id"]), r["n_words"], round(r["log_likelihood"], 4)) for r in scoring.score(other, docs).collect()]
    assert sorted(got) == plain_scores(texts_of(other), [t for _, t in rows], model, 0)
    assert scoring.score(empty(spark)).collect() == []


def scoring_words(text):
    from tidelens.llm.quality import WORD

    return WORD.findall(text or "")


def test_predictions_are_a_distribution(spark):
    """Outside the corpus the experts other than the constant one sum to 1 over all words of the corpus, whatever the neighbours."""
    text = "the cat sat on the mat and the dog lay on the rug"
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    model = scoring.fit(scoring.blocks(docs, "text", ()))
    words = Counter(w for _, t in texts_of(docs) for w in scoring_words(t))
    assert np.allclose(np.exp(model.table).sum(1), 1) and model.mass.sum() == sum(words.values())
    for c in set(model.classes[xxh64_intdigest(w) % scoring.BUCKETS] for w in words):
        assert sum(n for w, n in words.items() if model.classes[xxh64_intdigest(w) % scoring.BUCKETS] == c) == model.mass[c]
    weights = scoring.weigh(np.bincount([c for x in plain_codes([text], [text] * 20, model, 0) for c in x], minlength=scoring.KINDS))
    assert weights.shape == (scoring.CONTEXT**2, 4) and np.allclose(weights.sum(1), 1)


def test_words_of_equal_frequency_differ_by_context(spark):
    """Swapping two words of one class in a text of the same words lowers its score; so does any shuffling."""
    base = [f"red {a} runs on grass while blue {b} swims in water" for a, b in (("fox", "cod"), ("hen", "eel"))]
    corpus = spark.createDataFrame([(i, base[i % 2]) for i in range(60)], "doc_id long, text string")
    swapped = base[0].replace("fox", "?").replace("cod", "fox").replace("?", "cod")
    mixed = " ".join(random.Random(1).sample(base[0].split(), 10))
    docs = spark.createDataFrame([(1, base[0]), (2, swapped), (3, mixed)], "doc_id long, text string")
    score = {r["doc_id"]: r["mean_log_prob"] for r in scoring.score(docs, corpus).collect()}
    assert score[1] > score[2] + 0.3 and score[2] > score[3] + 0.3


def test_copies_speak_for_each_other(spark):
    """A text says nothing about its own words; one that occurs twice is predicted from its copy."""
    once = [(i, prose(100 + i, 80)) for i in range(40)]
    docs = spark.createDataFrame([*once, (40, once[0][1]), (41, once[1][1])], "doc_id long, text string")
    score = {r["doc_id"]: r["mean_log_prob"] for r in scoring.score(docs).collect()}
    assert min(score[i] for i in (0, 1, 40, 41)) > max(score[i] for i in range(2, 40)) + 1


def test_empty_corpus_has_a_model(spark):
    out = {r["doc_id"]: r["n_words"] for r in scoring.score(messy(spark), empty(spark)).collect()}
    assert out[4] == 0 and out[8] == 2
