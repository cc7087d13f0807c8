import random

import numpy as np

from loomwork.llm import components as K
from loomwork.llm import minhash_join as M


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, percent=85, width=5):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    low = -(2**63)
    links = [(a or (low if a is None else a), b if b is not None else low) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    comp = union_find({low if i is None else i for i, _ in rows}, links)
    return sorted(((i, len(s), None if (c := comp[low if i is None else i]) == low else c, c == (low if i is None else i)) for i, s in sets), key=str)


def check(spark, rows, percent=80, **k):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as digest", "2 as node", "3 as n_shingles")
    got = sorted((tuple(r) for r in M.near_duplicates(docs, percent, **k).collect()), key=str)
    assert got == brute(rows, percent)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 400)] + [(1, 2), (2, 3), (3, 1), (7, 7)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    got = {r.node: r.component for r in K.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = union_find({n for p in links for n in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and set(want) - set(got) <= {n for n in want if sum(n in p for p in links if p[0] != p[1]) == 0}
    assert K.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pairs_under_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (300, M.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.permutation(M.SYMBOLS)[: M.GUARANTEED]] ^= 1
    assert all(set(x) & set(y) for x, y in zip(M.chunk_keys(a), M.chunk_keys(b)))


def test_distance_follows_from_the_similarity():
    assert [M.distance_for(p) for p in (95, 85, 80)] == [M.GUARANTEED, 26, 30] and M.distance_for(0) == M.SYMBOLS


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        n += 1
        rows.append((n * 7 % 1009, " ".join(words)))

    passage = rng.choices(vocabulary, k=60)
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randrange(40, 120))
        add(base)
        for _ in range(rng.randrange(4)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            add(words)
        add(passage + rng.choices(vocabulary, k=40))
    base = rng.choices(vocabulary, k=100)
    for _ in range(60):  # a large group: copies of copies
        base = list(base)
        base[rng.randrange(100)] = rng.choice(vocabulary)
        add(base)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE two"), (5005, "one two three")]
    check(spark, rows)
    check(spark, rows, 85)
    check(spark, rows, block=16, block_bytes=20_000)


def test_shared_ids_nulls_and_repeats(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    check_rows = [(1, a), (1, a), (2, a), (3, b), (None, b), (4, "x"), (None, "y z")]
    check(spark, check_rows)
    docs = spark.createDataFrame([(5, a), (6, b), (9, a), (9, b)], "doc_id bigint, text string")
    assert {r.component_id for r in M.near_duplicates(docs).collect()} == {5}
    assert M.near_duplicates(docs.limit(0)).count() == 0
