import math
import random
from collections import Counter

import numpy as np

from loomwork.llm import brown_lm as B


def tokens(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + ["end"]


def test_counts_base_and_normalisation(spark):
    rng = random.Random(2)
    rare = [f"r{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(["The", "É", "x", "y.", "z"] * 20 + rare[: 1 + i * 8]) for _ in range(rng.randrange(50))) if i % 50 else None) for i in range(400)]
    rows += [(7, "The"), (7, "The"), (None, "only here"), (9000, "w " * 50_000)]
    train = [r for r in rows if r[0] is None or r[0] % 4]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 as row", "'q' as word", "2 as c")
    model = B.train(spark.createDataFrame(train, "doc_id bigint, text string").repartition(5))
    c = Counter(t for _, x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    want = sorted((repr(i), len(t := tokens(x)), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, x in rows)
    got = B.score_documents(docs, model).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)
    # each class's transitions share one, up to the mass of words that training doesn't have
    unit = B.UnitOf(model.frequent)
    u = {w: (k + 0.1) / (n + 0.1 * (v + 1)) for w, k in c.items()}
    mass = np.zeros(B.CLASSES)
    for w, p in u.items():
        mass[model.class_of[B.END if w == "end" else unit[w]]] += p
    total = (10**model.gain * mass[None, :]).sum(axis=1)
    assert ((total <= 1 + 1e-9) & (total > 0.99)).all()


def test_score_is_that_of_the_class_path(spark):
    docs = spark.createDataFrame([(i, "a b a b a") for i in range(9)] + [(20, "c d c d")], "doc_id bigint, text string")
    m = B.train(docs)
    unit = B.UnitOf(m.frequent)
    for r in B.score_documents(docs, m).collect():
        text = "c d c d" if r.doc_id == 20 else "a b a b a"
        path = [B.END, *(unit[w] for w in text.encode().split()), B.END]
        k = m.class_of[path]
        assert abs(r.score - r.base_score - m.gain[k[:-1], k[1:]].sum()) < 1e-9
        assert r.score > r.base_score


def test_exchange_finds_alternating_classes_and_never_lowers_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((21, 21), np.float32)
    for _ in range(4000):
        pairs[rng.integers(0, 10), rng.integers(10, 20)] += 1
        pairs[rng.integers(10, 20), rng.integers(0, 10)] += 1
    pairs[20, 0] = pairs[11, 20] = 1
    of = B.exchange(pairs, classes=3, sweeps=10)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    m = B.train(none)
    assert m.tokens == 0 and B.score_documents(none, m).count() == 0
    r = B.score_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), m).first()
    assert (r.n_tokens, r.n_known) == (2, 0) and abs(r.base_score - 2 * math.log10(1.0)) < 1e-9


def test_no_single_move_raises_the_likelihood():
    """What exchange leaves is a local maximum of the class bigrams' likelihood, computed anew for each move."""
    rng = np.random.default_rng(9)
    for n, classes in ((5, 4), (30, 5)):
        pairs = rng.poisson(0.7, (n, n)).astype(np.float32)
        of = B.exchange(pairs, classes)

        def likelihood(of):
            m = np.eye(classes)[of].T @ pairs.astype(float) @ np.eye(classes)[of]
            return B._f(m).sum() - B._f(m.sum(0)).sum() - B._f(m.sum(1)).sum()

        now = likelihood(of)
        for w in range(n - 1):
            for c in range(1, classes):
                other = of.copy()
                other[w] = c
                assert likelihood(other) <= now + 1e-6
