"""A small table with every awkward case, and plain versions of the rules."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def messy(spark, more=()):
    """Null and repeated keys, null, empty, blank and very long texts, copies, near copies; other columns with clashing names."""
    near = prose(1, 120).split()
    near[60] = "changed"
    texts = [(1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (2, prose(2, 40)), (None, "only here, once"), (None, None), (3, None), (4, ""), (5, "   \n "), (6, prose(6, 30_000)),
             (7, " ".join(near)), (8, "two words"), (9, "Ünïcode 🙂 ﬁ   <s> x\n\n y\t▁z" + "a" * 300), (10, "password=abcdef123456 \x00 mail a.b@c.example.org 192.168.0.1"), *more]
    rows = [(i, t, None if k % 3 else "en", k, "x", [1], 2.0, "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node long, row string, ids array<int>, score double, bucket string")


def empty(spark):
    return messy(spark).limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
