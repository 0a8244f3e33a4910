"""Operators on pairs: vectors, n-gram sets, benchmark passages; each against all pairs by a plain rule."""

import random

import numpy as np
import pytest

from tidelens.llm import jaccard, tiling, vectors

from .helpers import empty, messy, prose, texts_of


def groups(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == label:
            return label
        label = new


def near_vectors(seed=1, families=12, dims=20):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(families):
        centre = rng.standard_normal(dims)
        out += [centre * rng.uniform(0.5, 2) + rng.standard_normal(dims) * s for s in rng.uniform(0, 0.35, 1 + f)]
    return np.array(out).astype(np.float32)


@pytest.mark.parametrize("tile,grid", [(20_000, 2), (7, 2), (5, 1)])
def test_vectors_against_all_pairs(spark, tile, grid):
    x = near_vectors()
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(500, rows[3][1], 0), (501, rows[3][1], 0), (502, None, 0), (503, [0.0] * 20, 0), (504, [float("nan")] * 20, 0), (505, [None] + [1.0] * 19, 0), (506, [], 0), (507, [1.0, 2.0], 0), (508, [float("inf")] * 20, 0), (509, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table, tile=tile, grid=grid).collect()}
    ids = [r[0] for r in rows]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not a or None in a or None in b:
            return 0.0
        a, b = np.array(np.float32(a), float), np.array(np.float32(b), float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / size) if size > 0 and np.isfinite(size) else 0.0

    linked = [[i != j and cosine(rows[i][1], rows[j][1]) >= 0.95 for j in range(len(rows))] for i in range(len(rows))]
    label = groups(len(rows), linked)
    assert got == {ids[i]: (sum(linked[i]), ids[label[i]], label[i] == i) for i in range(len(rows))}
    assert sum(map(sum, linked)) > 50


def test_vectors_with_odd_keys(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table).collect())
    assert got == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    assert vectors.near_duplicates(table.limit(0)).collect() == []


def test_every_linked_pair_is_within_budget_of_a_block():
    x = near_vectors(3)
    y, cuts = vectors.turned(x), vectors.blocks(x.shape[1], 8)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))):
        assert any(((y[i, c] - y[j, c]) ** 2).sum() <= vectors.budget(c, x.shape[1], 0.95) for c in cuts)


def gram_set(text, size=5):
    words = jaccard.WORD.findall((text or "").lower())
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_join(rows, least=0.8):
    sets = [gram_set(t) for _, t in rows]
    linked = [[i != j and bool(a) and bool(b) and len(a & b) / len(a | b) >= least for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = groups(len(rows), linked)
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for i, (key, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if j == i or (sets[i] and sets[j] == sets[i])]
        out.append((key, smallest(same), sum(linked[i]), smallest(rows[j][0] for j in range(len(rows)) if label[j] == label[i])))
    return sorted(out, key=repr)


def copies(n, seed=5, words=150):
    base, r = prose(seed, words).split(), random.Random(seed)
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(r.randrange(4)):
            text[r.randrange(words)] = f"w{r.randrange(1000)}"
        out.append((1000 + i, " ".join(text)))
    return out


@pytest.mark.parametrize("chunk", [256, 4])
def test_jaccard_against_all_pairs(spark, chunk):
    docs = messy(spark, [*copies(40), (60, "one two three four"), (61, "One  two\nthree four"), (62, prose(2, 40) + " tail")])
    out = [tuple(r) for r in jaccard.join(docs, chunk=chunk).select("doc_id", "class_id", "n_links", "group_id").collect()]
    assert sorted(out, key=repr) == plain_join(texts_of(docs))
    assert jaccard.join(empty(spark)).collect() == []


def test_one_document_per_group(spark):
    docs = messy(spark, copies(12))
    out = jaccard.one_per_group(docs)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 8, 9, 10, 1000] or ids == [1, 2, 3, 4, 5, 6, 8, 9, 10, *[i for i in ids if i >= 1000]]
    assert sum(1 for r in out.collect() if r["doc_id"] is None) == 2
    assert jaccard.one_per_group(empty(spark)).collect() == []


def test_bands_reach_the_recall():
    for least, rows in ((0.8, 5), (0.7, 4), (0.9, 8)):
        assert 1 - (1 - least**rows) ** jaccard.bands_for(least, 0.9999, rows) >= 0.9999


def plain_tiles(pattern, text, least):
    mp, mt, out = [False] * len(pattern), [x is None for x in text], 0
    while True:
        best, longest = [], least
        for i in range(len(pattern)):
            for j in range(len(text)):
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > longest:
                    best, longest = [(i, j)], n
                elif n == longest:
                    best.append((i, j))
        for i, j in best:
            if not any(mp[i : i + longest]) and not any(mt[j : j + longest]):
                out += longest
                mp[i : i + longest] = mt[j : j + longest] = [True] * longest
        if not best:
            return out


def test_tiles_against_plain_greedy_tiling():
    r = random.Random(2)
    for _ in range(600):
        p, t = ([r.randrange(4) for _ in range(r.randrange(1, 30))] for _ in range(2))
        least = r.choice([2, 3, 5])
        tiles = tiling.tile(p, t, least)
        assert sum(n for *_, n in tiles) == plain_tiles(p, t, least)
        for a, b, n in tiles:
            assert n >= least and p[a : a + n] == t[b : b + n]


def test_leaks_catch_reordered_passages(spark):
    items = [(1, prose(31, 40)), (2, prose(32, 20)), (3, "too short item"), (None, prose(33, 12)), (5, None), (6, ""), (1, prose(31, 40))]
    a = items[0][1].split()
    reordered = " ".join([*a[20:], "between", "them", *a[:20]])
    docs = messy(spark, [(40, f"{prose(9, 30)} {reordered} {prose(10, 30)}"), (41, prose(11, 30) + " " + " ".join(a[:12])), (42, (items[1][1] + ", ").upper()), (43, items[3][1]), (43, items[3][1])])
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS node", "'x' AS seed")
    got = sorted(((r["doc_id"], r["item_id"], r["n_matched"]) for r in tiling.leaks(docs, bench).collect()), key=repr)
    want = []
    for i, t in texts_of(docs):
        for j, b in items:
            p, w = (tiling.WORD.findall((x or "").lower()) for x in (b, t))
            if len(w) < 30_000 and len(p) >= 5 and plain_tiles(p, w, 5) >= 0.6 * len(p):
                want.append((i, j, plain_tiles(p, w, 5)))
    assert got == sorted(want, key=repr) and (40, 1, 40) in got and not any(i == 41 for i, *_ in got)
    out = tiling.clean(docs, bench)
    assert out.columns == docs.columns and {40, 42, 43}.isdisjoint({r["doc_id"] for r in out.collect()})
    assert out.count() == docs.count() - 4
    assert tiling.leaks(docs, bench.limit(0)).collect() == [] and tiling.leaks(empty(spark), bench).collect() == []
