import random

from loomwork.llm import cube_mix as M


def fill(sizes, weights, most):
    """Shares, resharing what exceeds most times a source's size until nothing does."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_flight_keeps_totals_and_leaves_two():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(0, 60)
        size = [float(rng.choice([0, 3, 3, rng.randrange(1000)])) for _ in range(n)]
        p = [rng.choice([0.0, 1.0, 0.37, rng.random()]) for _ in range(n)]
        q = M.fly(size, p, [rng.random() for _ in range(n)])
        assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, size)) - sum(a * b for a, b in zip(q, size))) < 1e-3
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        assert all(x in (0, 1) for x in M.land(size, q))


def make(spark, rows, **k):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as target")
    return M.mix_sources(docs, **k).collect()


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(8)
    names = ["b", "a", None, "é", "z", "B"]
    rows = [(i, "w " * int(rng.expovariate(0.02)) if i % 97 else None, rng.choices(names, [50, 20, 3, 1, 9, 4])[0]) for i in range(3000)]
    got = make(spark, rows, block=100)
    assert len(got) == len(rows)
    order = sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in order]
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    for n, size, target in zip(order, sizes, want):
        own = [r for r in got if r.source == n]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
    again = make(spark, rows[::-1], block=100)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark):
    assert make(spark, []) == []
    assert [r.taken for r in make(spark, [(1, None, "a"), (None, "", None)])] == [0, 0]
    got = make(spark, [(1, "x y", "a"), (1, "x y", "a"), (2, "z", "b")])
    assert sum(r.taken for r in got) >= 4


def test_repeated_rows_share_what_is_taken(spark):
    rows = [(1, "x y z", "a")] * 3000 + [(2, "u v", "a")] * 7 + [(None, "q", "b")] * 5 + [(k, "w " * (k % 9), "b") for k in range(10, 400)]
    got = make(spark, rows, block=50)
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and all(0 <= r.copies <= 3 for r in own)
    for i in (1, 2, None):
        copies = [r.copies for r in got if r.doc_id == i]
        assert max(copies) - min(copies) <= 1


def test_inclusion_probabilities():
    rng = random.Random(12)
    size = [float(rng.randrange(1, 50)) for _ in range(30)]
    p = [rng.choice([0.2, 0.5, 0.8]) for _ in range(30)]
    n, seen = 3000, [0.0] * 30
    for _ in range(n):
        q = M.fly(size, p, [rng.random() for _ in p])
        seen = [a + b for a, b in zip(seen, q)]
    assert all(abs(a / n - b) < 0.05 for a, b in zip(seen, p))
