import hashlib
import random

from loomwork.llm import simhash as S


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    words, out = S.WordHash(), []
    for k, (i, text) in enumerate(order):
        text, next_ = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + next_[:half]
        f, e, n = (S.fingerprint(x, words) for x in (text, edited, next_))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", S.likeness(f, e), S.likeness(f, n)))
    return sorted(out, key=str)


def test_edits_over_any_number_of_ranges(spark):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(rng.choice(["é", "tree", "Sea", "x", "\n"]) for _ in range(rng.randrange(30)))) for i in range(100)]
    rows += [(30, "twin"), (30, "twin"), (30, None), (None, "no id"), (None, ""), (-7, "minus " * 4000)]
    for parts in (1, 2, 7, 40):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).selectExpr("*", "1 as part", "2 as extra", "3 as n_chars")
        got = S.fingerprints_with_edits(docs, parts=parts).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    r = S.fingerprints_with_edits(docs).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert S.fingerprints_with_edits(docs.limit(0)).count() == 0


def test_all_within_the_radius_are_found(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    all_ = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(4)] + [0, 2**64 - 1]
    names = [f"{x:016x}" for x in all_]
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "fingerprint string")
    for radius in (0, 1, 3, 5):
        got = {(r.query, r.found, r.distance) for r in S.within_radius(df, df, radius).collect()}
        want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in set(all_) for b in set(all_) if (a ^ b).bit_count() <= radius}
        assert got == want
