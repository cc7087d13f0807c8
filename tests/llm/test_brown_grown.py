"""Words beyond the most frequent ones have classes by their own neighbours, not by their ending."""

import random

from loomwork.llm import brown_lm as B


def test_words_of_one_ending_part_by_their_neighbours(spark):
    rng = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(1200)] * 20 + ["qqqstation"] * 12, [f"v{i}" for i in range(1200)] * 20 + ["zzzstation"] * 12
    rng.shuffle(nouns)
    rng.shuffle(verbs)
    words = [w for n, v in zip(nouns, verbs) for w in ("the", n, "to", v)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 400])) for i in range(0, len(words), 400)], "doc_id bigint, text string").repartition(3)
    m = B.train(docs)
    unit = B.UnitOf(m.frequent, m.grown)
    assert len(m.frequent) == B.FREQUENT and len(m.grown) == 2404 - B.FREQUENT
    assert B.group_of(b"qqqstation") == B.group_of(b"zzzstation")
    of = {w: m.class_of[unit[w.encode()]] for w in set(words)}
    assert of["qqqstation"] != of["zzzstation"]
    assert not {of[w] for w in nouns} & {of[w] for w in verbs if w[0] == "z"} and not {of[w] for w in verbs} & {of[w] for w in nouns if w[0] == "q"}
    assert unit[b"neverstation"] == B.group_of(b"neverstation")


def test_exchange_goes_on_until_none_moves():
    import numpy as np

    rng = np.random.default_rng(5)
    pairs = rng.poisson(0.3, (400, 400)).astype(np.float32)
    three, none = B.exchange(pairs, 16, 3), B.exchange(pairs, 16)
    sure = lambda of: (B._f(m := np.eye(16)[of].T @ pairs @ np.eye(16)[of]).sum() - B._f(m.sum(0)).sum() - B._f(m.sum(1)).sum())
    assert (three != none).any() and sure(none) > sure(three)
