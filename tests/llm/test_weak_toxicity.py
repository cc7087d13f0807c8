import random

import numpy as np

from loomwork.llm import weak_toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["vile", "rotten", "grumpish", "grumpling", "grumpoid"]
    rows = []
    for i in range(n):
        words = [rng.choice(["tree", "sea", "stone", "grass", "the", "of"]) + rng.choice(["", "s", "y"]) for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "!", ","])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(800, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as y")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = T.train(docs, T.split_training(labels))
    held = {r.doc_id for r in labels.select("doc_id").collect()} - {r.doc_id for r in T.split_training(labels).collect()}
    assert 200 < len(held) < 330
    got = {r.doc_id: r.score for r in T.score_documents(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows if i in held]) > 0.97


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "vile " * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = T.train(docs, labels)
    got = T.score_documents(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.7 for r in got)
    assert T.score_documents(docs.limit(0), model).count() == 0
    one_kind = T.train(docs, spark.createDataFrame([(2, 1), (2, 0)], "doc_id bigint, toxic int"))
    assert all(r.score > 0.7 for r in T.score_documents(docs, one_kind).collect())


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, np.where(y, 1, -1), np.where(y, -1, 1))
    poor = np.where(rng.random(4000) < 0.55, np.where(y, 1, -1), np.where(y, -1, 1))
    given = np.where(rng.random(4000) < 0.97, y, ~y).astype(int)
    m = T.LabelModel().fit(np.stack([good, poor, poor], axis=1), given)
    assert abs(m.table[0, 1, 2] - 0.9) < 0.03 and abs(m.table[1, 1, 2] - 0.55) < 0.05
    assert m.correlation[1, 2] > 0.9 and m.worth[1] < 0.6 < m.worth[0]


def test_beginnings_found_twice():
    f = T.FeaturesOf().of(b"grumpish grumpling")
    assert b"2 grump" in f and b"b grump" in f and b"w grumpish" in f and b"2 grumpi" not in f


def test_label_model_by_enumeration_and_estimated_labels():
    """Posteriors against Bayes' rule over the model's own table, and a label's accuracy that many voters show to be 0.8."""
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.4
    votes = np.stack([np.where(rng.random(6000) < 0.85, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(6000) < 0.9) for _ in range(9)], axis=1)
    given = np.where(rng.random(6000) < 0.8, y, ~y).astype(int)
    m = T.LabelModel().fit(votes, given, trust=None)
    q = m.posterior(votes, given)
    assert abs(m.table[-1, 1, 2] - 0.8) < 0.03 and ((q > 0.5) == y).mean() > 0.97
    for i in range(40):
        odds = m.prior / (1 - m.prior)
        for j, v in enumerate([*votes[i], 2 * given[i] - 1]):
            if v:
                odds *= (m.table[j, 1, v + 1] / m.table[j, 0, v + 1]) ** m.worth[j]
        assert abs(odds / (1 + odds) - q[i]) < 1e-9


def test_an_empty_table_and_one_id_with_many_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    model = T.train(docs, labels)
    assert T.score_documents(docs, model).count() == 0
    many = spark.createDataFrame([(1 + i % 2, ("vile stuff" if i % 2 == 0 else "fine sea") + f" {i}") for i in range(300)], "doc_id bigint, text string")
    got = {r.text.split()[0]: r.score for r in T.score_documents(many, T.train(many, labels, most_labelled=100)).join(many, "doc_id").collect()}
    assert got["vile"] > 0.7 > 0.3 > got["fine"]
