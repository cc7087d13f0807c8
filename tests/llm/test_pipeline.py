import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from loomwork.llm import cube_mix

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    clean = P.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == list(P.COLUMNS) and 0.8 * n < clean.count() <= n
    assert clean.join(docs, list(P.COLUMNS), "left_anti").count() == 0
    lines = P.drop_common_lines(spark, clean, SF).cache()
    assert lines.columns == list(P.COLUMNS) and lines.count() == clean.count()
    holders = defaultdict(set)
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    rows = clean.collect()
    for r in rows:
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not key(x) or len(holders[key(x)]) < P.COMMON_LINE) for r in rows}
    got = lines.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    near = P.drop_near_duplicates(spark, lines, SF).cache()

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = sorted((r.doc_id, shingles(r.text)) for r in got)
    up = {i: i for i, _ in sets}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= P.ALIKE_PERCENT * len(x | y):
                ra, rb = up[a], up[b]
                up = {i: min(ra, rb) if t in (ra, rb) else t for i, t in up.items()}
    assert {r.doc_id for r in near.collect()} == {i for i, t in up.items() if i == t}
    mixed = P.mix_sources(spark, near, SF).cache()
    copies = {r.doc_id: r.copies for r in cube_mix.mix_sources(near).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    out = P.encode(spark, mixed, SF).collect()
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect()}
    assert len(out) == sum(copies.values()) and all(texts[r.doc_id] == r.decoded_sha256 for r in out)


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x y", None, "a", 3), (7, "", "en", None, 0), (7, "", "en", None, 0)], docs.schema)
    for some in (odd, docs.limit(0)):
        now = some
        for _, stage in P.STAGES:
            now = stage(spark, now, SF)
        now.collect()


def test_run_is_the_stages_in_a_row(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.filter(F.col("n_tokens") < 0).count() == 0 < out.count()


def test_rows_that_repeat_or_lack_ids(spark):
    """Near-duplicates go by row; the mix takes of equal rows what it says in all, whatever else they hold."""
    a, b = "a b c d e f g", "h i j k l m n"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
    rows = [(5, a, "x", "s", 1, 0), (6, b, "x", "s", 1, 0), (9, a, "x", "s", 1, 0), (9, b, "x", "s", 1, 0), (9, "o p q r s t", "x", "s", 1, 0), (None, "u v w x y z", "x", "s", 1, 0), (None, "u v w x y z", None, "s", 1, 0), (None, "q q", "x", "s", 1, 0), (7, "", "x", "s", 1, 0), (7, None, "x", "s", 1, 0)]
    near = P.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF)
    assert near.columns == list(P.COLUMNS)
    got = Counter((r.doc_id, r.text) for r in near.collect())
    assert got == Counter({(5, a): 1, (6, b): 1, (9, "o p q r s t"): 1, (None, "u v w x y z"): 1, (None, "q q"): 1, (7, ""): 1, (7, None): 1})
    for n in (5, 6, 7, 8):
        docs = spark.createDataFrame([(1, "x y", "en" if k else "de", "s", 3, k) for k in range(n)] + [(k, "w " * k, None, "t", 3, 0) for k in range(20)] + [(None, "n", None, None, 1, 0)] * 3, schema)
        taken = Counter()
        for r in cube_mix.mix_sources(docs).collect():
            taken[r.doc_id, r.source] += r.copies
        assert Counter((r.doc_id, r.source) for r in P.mix_sources(spark, docs, SF).collect()) == +taken
