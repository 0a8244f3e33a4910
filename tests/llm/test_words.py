"""Periodic runs, language and spelling variants against plain versions, and their queries as registered."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelens.llm import language, periodic, variants
from tidelens.llm.queries import QUERIES, planted

from .helpers import empty, messy, prose, texts_of


def plain_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_short_alphabets(letters):
    r = random.Random(letters)
    for k in range(250):
        w, n = [], r.randrange(0, 120)
        period = [r.randrange(letters) for _ in range(r.randrange(1, 20))]
        while len(w) < n:
            w += period if k % 2 and r.random() < 0.9 else [r.randrange(letters)]
        assert periodic.runs_of(w) == plain_runs(w)
        names = [str(x) for x in w]
        assert periodic.runs_of_texts([names, [], ["a"] * 13, names[::-1]]) == [plain_runs(w), [], [(0, 13, 1)], plain_runs(w[::-1])]


def test_runs_of_other_least_lengths():
    r = random.Random(9)
    for least in (1, 2, 5, 30):
        for _ in range(60):
            w = [r.randrange(2) for _ in range(r.randrange(0, 70))]
            assert periodic.runs_of_texts([list(map(str, w))], least)[0] == plain_runs(w, least)


def test_re_pair_derives_the_words_and_leaves_no_pair_twice():
    r = random.Random(2)
    for _ in range(100):
        w = [r.randrange(3) for _ in range(r.randrange(0, 80))]
        rules, starts = periodic.re_pair(w)
        for _, size, places in rules:
            assert len({tuple(w[p : p + size]) for p in places}) == 1 and places == sorted(places)
        cuts = [*starts, len(w)]
        parts = [tuple(w[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert sum(map(list, parts), []) == w
        pairs = [(i, p) for i, p in enumerate(zip(parts, parts[1:]))]
        assert all(j - i == 1 for i, p in pairs for j, o in pairs if i < j and p == o)


def test_a_long_periodic_text_takes_linear_work():
    r = random.Random(1)
    period = [r.randrange(4000) for _ in range(30_000)]
    assert periodic.runs_of((period * 5)[:140_000]) == [(0, 140_000, 30_000)]
    assert periodic.runs_of([1] * 100_000) == [(0, 100_000, 1)]


def test_scan_of_odd_rows(spark):
    docs = messy(spark, [(20, "tick tock " * 50), (21, "a b c " + "x y z " * 9 + "end"), (21, "a b c " + "x y z " * 9 + "end")])
    out = periodic.scan(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=repr)
    want = []
    for i, t in texts_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(w) if len(w) < 1000 else []
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert got == sorted(want, key=repr)
    assert periodic.scan(empty(spark)).collect() == []


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return near, sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else -1, root(w)) for w in n)


def vocabulary(alphabet, longest, size, seed):
    r = random.Random(seed)
    words = {"".join(r.choice(alphabet) for _ in range(r.randrange(1, longest))) for _ in range(size)}
    for w in sorted(words)[: size // 4]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1 :]}
    return {w: r.randrange(1, 40) for w in sorted(words) if w}


@pytest.mark.parametrize("alphabet,longest,size,bucket", [("ab", 8, 250, 100), ("abcé", 14, 400, 300), ("abcdefghijklmnop", 6, 800, 60_000)])
def test_near_words_are_those_of_brute_force(spark, monkeypatch, alphabet, longest, size, bucket):
    monkeypatch.setattr(variants, "BUCKET_ROWS", bucket)
    n = vocabulary(alphabet, longest, size, size)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    near, want = plain_groups(n)
    pairs = [tuple(sorted(r)) for r in variants.near_pairs(words).collect()]
    assert len(pairs) == len(set(pairs)) and sorted(pairs) == sorted((a, b) for a in n for b in near[a] if a < b)
    got = variants.group(words)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or -1, r.root) for r in got.collect()) == want


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(4)) for i in range(40)})
    letters = np.array([[ord(c) for c in w] for w in words])
    machine = variants.Acceptor(np.zeros(len(words), np.int64), letters, np.full(len(words), 4))
    for h in range(5):
        tails = {tuple(sorted(w[4 - h :] for w in words if w.startswith(p))) for p in {w[: 4 - h] for w in words}}
        assert len(machine.first[h]) - 1 == len(tails)
    for row, w in enumerate(words):
        state, place = machine.start[4][row], 0
        for h, c in zip((4, 3, 2, 1), w):
            arc = int(machine.step(h, np.array([state]), np.array([ord(c)]))[0])
            state, place = machine.to[h][arc], place + machine.skip[h][arc]
        assert place == row


def test_chains_of_forms_end_at_the_root(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 5}
    out = {r.word: (r.form, r.root, r.n_near) for r in variants.group(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert out["aaaaa"] == ("aaaab", "abbbb", 1) and out["abbbb"] == (None, "abbbb", 1) and out["zzzzz"] == (None, "zzzzz", 1)
    assert variants.group(spark.createDataFrame([(None, 3), ("", 4), ("x", None)], "word string, n long")).collect() == []


def plain_words(texts):
    total = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_word_counts_of_odd_rows(spark):
    docs = messy(spark, [(30 + i, "ÀÉàéß Straßenbahn wörter×÷ KÄSE-Brötchen Wörter wörteR🙂wörter" + " hello" * 3) for i in range(60)])
    got = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert got == plain_words(texts_of(docs)) and any(len(w) == 4 for w in got) is False
    assert variants.word_counts(empty(spark)).collect() == []


TONGUES = {"xa": "ka ro ti mu sel".split(), "yb": "ög schen ürb lich".split(), "zc": "да не по мир".split()}


def tongue(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(TONGUES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def spoken(spark, n=240):
    rows = [(i, tongue(lang, i, 3 + i % 40), lang) for i in range(n) for lang in [list(TONGUES)[i % 3]]]
    return spark.createDataFrame([*rows, (None, None, "xa"), (n, "123 !", "yb"), (n + 1, "", "yb"), (n + 2, tongue("zc", 1, 30_000), None), (n + 3, "ᚠᚢᚦ", None)], "doc_id long, text string, lang string")


def test_language_of_held_out_rows(spark):
    docs = spoken(spark)
    truth = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    out = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out.values())
    held = [i for i in out if i is not None and i < 240 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 60 and np.mean([out[i].lang_pred == truth[i][1] for i in held]) > 0.97
    assert {i: out[i].lang_pred for i in (None, 240, 241)} == {None: "und", 240: "und", 241: "und"} and out[242].lang_pred == "zc" and out[243].lang_pred in TONGUES


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spoken(spark)
    swapped = docs.withColumn("lang", language.F.when(language.in_training(), language.F.col("lang")).otherwise("xa"))
    both = [sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language.predict(docs, language.fit(d)).collect()) for d in (docs, swapped.repartition(5))]
    assert both[0] == both[1]


def test_language_features_are_plain_tf_idf(spark):
    docs = spoken(spark, 60)
    model = language.fit(docs)
    learn = [r.text for r in docs.filter(language.in_training()).filter("lang is not null and text is not null").collect()]

    def grams(text):
        s = " " + re.sub(r"[^a-zöüäа-я]+", " ", text.lower()).strip() + " "
        return Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k].strip())

    known = ["".join(chr(int(g) >> 21 * k & 0x1FFFFF) for k in range(3)).rstrip("\0") for g in model.vocabulary.grams]
    often = Counter(g for t in learn for g in grams(t))
    assert np.allclose(model.idf, [np.log((1 + len(learn)) / (1 + often[g])) + 1 for g in known])
    text = tongue("xa", 5, 20) + "-" + tongue("zc", 5, 9)
    counts = grams(text)
    want = np.array([counts[g] for g in known]) * model.idf
    (_, got, _), = language.gram_counts([text], model.vocabulary)
    assert np.allclose(model.features(got)[0], want / np.sqrt((want**2).sum()))
    assert (model.weights == 0).any() and (model.vocabulary.find(model.vocabulary.grams) == np.arange(len(known))).all()


def test_long_texts_have_the_grams_of_one_pass():
    texts = ["ab cd" * 40, "", "x", "éa b  -c" * 9]
    letters, text = language.letters_of(texts)
    whole = sorted(zip(*map(list, map(np.concatenate, zip(*language.grams_of(letters, text))))))
    parts = sorted(zip(*map(list, map(np.concatenate, zip(*language.grams_of(letters, text, 7))))))
    assert whole == parts


def test_language_on_odd_rows(spark):
    docs = messy(spark)
    out = language.predict(docs, language.fit(docs))
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == docs.count() and {r.lang_pred for r in out.collect()} == {"en", "und"}
    assert language.predict(empty(spark), language.fit(docs)).collect() == []
    assert {r.lang_pred for r in language.predict(docs, language.fit(empty(spark))).collect()} == {"und"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents as the queries read them: prose, periodic and multilingual texts, odd ones."""
    r = random.Random(4)
    rows = [(i, prose(i % 40, r.randrange(0, 90)) + (" again and" * r.randrange(8, 20) if i % 9 == 0 else ""), "en") for i in range(150)]
    rows += [(200 + i, tongue(lang, i, 30), lang) for i in range(60) for lang in [list(TONGUES)[i % 3]]]
    rows += [(400, None, None), (401, "", "xa"), (402, " \t\x1c x\x85y ", None), (None, "no id here", "en")]
    path = tmp_path_factory.mktemp("words")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_as_registered(spark, folder):
    path, rows = folder
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
            g, n = zlib.crc32(str(i).encode()) // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop))))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in QUERIES["op11_periodic"](spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] > 0 for r in got) > 20
    assert planted({"doc_id": None}, ["a"]) == ["a"]


def test_op12_as_registered(spark, folder):
    path, rows = folder
    got = {r.doc_id: r for r in QUERIES["op12_language"](spark, path).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert np.mean([got[i].lang_pred == lang for i, t, lang in rows if lang and t and i is not None]) > 0.97


def test_op13_as_registered(spark, folder):
    path, rows = folder
    n = plain_words([(i, t) for i, t, _ in rows])
    got = sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or -1, r.root) for r in QUERIES["op13_variants"](spark, path).collect())
    assert got == plain_groups(n)[1] and len(got) > 20
