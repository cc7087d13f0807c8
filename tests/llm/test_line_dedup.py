import random
from collections import defaultdict

from loomwork.llm import line_dedup as L


def brute(rows, k):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if key(x) == "" or len(holders[key(x)]) < k]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def check(spark, rows, k, partitions=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_lines", "'x' as keep", "2 as pos", "3 as doc")
    got = L.apply_keep_bitmaps(docs, L.line_keep_bitmaps(docs, k, partitions=partitions)).collect()
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, k)


def test_small_cases(spark):
    rows = [(1, "A\nb\n\n"), (2, " a \nB"), (3, None), (4, ""), (None, "a"), (5, "É\né"), (6, "a\na\na"), (6, "a\na\na"), (7, " a")]
    for k in (1, 2, 3, 4, 5):
        check(spark, rows, k)
    check(spark, [(1, "x")], 1)
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.dedup_lines(docs).count() == 0


def test_hot_lines_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["hot", "Hot ", "warm" + str(rng.randrange(40)), "cold" + str(rng.randrange(4000)), ""]) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch, k, parts in (("7", 3, 5), ("10000", 10, 13), ("1", 2, 3), ("64", 200, 4)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        check(spark, rows, k, parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
