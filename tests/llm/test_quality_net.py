import random
import re
from collections import Counter

import numpy as np

from loomwork.llm import quality_net as Q


def test_sums_are_those_of_brute_force(spark):
    texts = ["a b a, c!", "", None, "longer words here, a b", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    places, signs = Q.index_vectors()
    want, rows = np.zeros((Q.ROWS, Q.WIDTH), np.int64), Q.FormRow()
    for t in texts:
        ids = [rows[x.encode()] for x in re.findall(r"\w+|[^\w\s]", t or "")]
        for i, a in enumerate(ids):
            for j in range(max(0, i - Q.WINDOW), min(len(ids), i + Q.WINDOW + 1)):
                if i != j:
                    want[a, places[ids[j]]] += signs[ids[j]]
    assert (Q.word_vectors(docs) == want).all()


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = [rng.choice(["tree", "sea", "stone", "grass", "the", "of"]) for _ in range(40)]
        good = i % 5 != 0
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as y")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    train = Q.split_training(labels)
    learned = {r.doc_id for r in train.collect()}
    model = Q.train(docs, train)
    got = {r.doc_id: r.score for r in Q.score_documents(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i not in learned]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.98 and model.temperature > 0
    assert Counter(len(r) for r in Q.score_documents(docs.limit(0), model).collect()) == {}


def test_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 90000)], "doc_id bigint, text string")
    model = Q.train(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int"))
    got = Q.score_documents(docs, model).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)


def test_pooling_network_and_temperature_by_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["a b a, station caption", "", "caption " * 5000, "x"]
    vectors = Q.unit_vectors(Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string")))
    rows = Q.FormRow()
    assert rows[b"station"] != rows[b"caption"]  # whole words, not endings
    for t in texts:
        words = re.findall(r"\w+|[^\w\s]", t)
        got = Q.pooled(rows.of(t.encode()), vectors)
        if words:
            mean = np.mean([vectors[rows[w.encode()]] for w in words], axis=0)
            share = [n / len(words) for n in Counter(words).values()]
            assert np.allclose(got, [*mean, (mean[: Q.WIDTH] ** 2).sum(), (mean[Q.WIDTH :] ** 2).sum(), sum(x * x for x in share), max(share)], atol=1e-4)
        else:
            assert not got.any()
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0).astype(int)
    m = Q.fit_network(x, y, vectors)
    for i in range(20):
        hidden = [np.tanh(sum((x[i, k] - m.mean[k]) / m.scale[k] * m.w1[k, j] for k in range(5)) + m.b1[j]) for j in range(len(m.b1))]
        z = (sum(h * w for h, w in zip(hidden, m.w2)) + m.b2) / m.temperature
        assert abs(1 / (1 + np.exp(-z)) - m.probability(x[i : i + 1])[0]) < 1e-9
    kept = np.arange(600) % 5 == 4
    loss = lambda t: -np.log(np.where(y[kept] == 1, p := 1 / (1 + np.exp(-m.logits(x[kept]) / t)), 1 - p)).mean()
    assert all(loss(m.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.5, 8, 61))


def test_an_empty_table_and_one_id_with_many_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert Q.score_documents(empty, Q.train(empty, labels)).count() == 0
    many = spark.createDataFrame([(1 + i % 2, ("fine sea" if i % 2 == 0 else "BUY NOW") + f" {i}") for i in range(400)], "doc_id bigint, text string")
    got = Q.score_documents(many, Q.train(many, labels, most_labelled=200)).collect()
    assert min(r.score for r in got if r.doc_id == 1) > max(r.score for r in got if r.doc_id == 2)
