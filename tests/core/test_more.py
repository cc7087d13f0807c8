"""Sources and sinks in round trips, features of programs, new names, windows and blocks."""

import ast
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import corpus as C
from loomwork.operators import knn, names, synth
from loomwork.plans import catalogue
from loomwork.sources import scan, sinks


@pytest.mark.parametrize("width", [1, 2])
def test_token_files_come_back(spark, tmp_path, width):
    lists = [[1, 2, 250], [], [7], list(range(200))]
    rows = spark.createDataFrame([(x,) for x in lists], "ids array<int>").repartition(3)
    sinks.write_token_files(rows, f"{tmp_path}/tokens", width)
    n = sinks.merge_files(f"{tmp_path}/tokens", f"{tmp_path}/train.bin", 64)
    got = scan.token_file(spark, f"{tmp_path}/train.bin", width).first().ids
    assert n == len(got) * width and sorted(got) == sorted(i for x in lists for i in x)
    with pytest.raises(Exception, match="fit"):
        sinks.write_token_files(spark.createDataFrame([([70_000],)], "ids array<int>"), f"{tmp_path}/bad", width)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("a", "z", 3)], "model string, text string, n int")
    sinks.write_routed(rows, f"{tmp_path}/routed", "model")
    assert {(r.model, r.n) for r in spark.read.parquet(f"{tmp_path}/routed").collect()} == {("a", 1), ("b", 2), ("a", 3)}
    sinks.write_results(rows, f"{tmp_path}/results")
    assert sorted((r.model, r.n) for r in spark.read.json(f"{tmp_path}/results").collect()) == [("a", 1), ("a", 3), ("b", 2)]
    sinks.write_shards(rows.select("text").coalesce(1), f"{tmp_path}/shards", 2)
    assert scan.shards(spark, f"{tmp_path}/shards/part*").count() == 2 and sorted(r.text for r in scan.corpus(spark, f"{tmp_path}/shards", strip=True).collect()) == ["x", "y", "z"]
    for _ in range(2):
        sinks.append_history(rows, f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == 6
    for k in (0, 10):
        sinks.append_outcomes(spark.createDataFrame([("hard", k), ("fail", k + 1), ("hard", k + 2)], "outcome string, ex_id int"), f"{tmp_path}/outcomes", "ex_id")
    assert sorted((r.outcome, r.ex_id, r.idx) for r in spark.read.parquet(f"{tmp_path}/outcomes").collect()) == [("fail", 1, 0), ("fail", 11, 1), ("hard", 0, 0), ("hard", 2, 1), ("hard", 10, 2), ("hard", 12, 3)]
    sinks.write_vocab_size(spark, 52, f"{tmp_path}/size")
    assert spark.read.text(f"{tmp_path}/size").first().value == "52"


def test_readers(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a\n\nb\nc\n\n\n\nlost")
    assert [(r.text, r.place) for r in sorted(scan.corpus_strict(spark, f"{tmp_path}/c.txt").collect(), key=lambda r: r.place)] == [("a", 0), ("b\nc", 1), ("", 2)]
    (tmp_path / "e.txt").write_text("")
    assert scan.corpus_strict(spark, f"{tmp_path}/e.txt").count() == 0
    for lang in ("go", "php"):
        (tmp_path / f"{lang}.jsonl").write_text("\n".join(json.dumps({"code": c, "nl": "x"}) for c in (f"{lang} 1", "  ", "")))
    got = scan.by_language(spark, {x: f"{tmp_path}/{x}.jsonl" for x in ("go", "php")})
    assert sorted((r.lang, r.code) for r in got.collect()) == [("go", "go 1"), ("php", "php 1")]
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "c\"": 2}}}))
    assert scan.vocabulary_sizes(spark, f"{tmp_path}/t.json", f"{tmp_path}/c.txt") == (3, 8)
    (tmp_path / "m.jsonl").write_text('{"code": "x", "label": 3, "index": 7}\n')
    assert tuple(scan.jsonl(spark, f"{tmp_path}/m.jsonl").first()) == ("x", 3, 7)


def test_identifiers_of_a_page_of_code(spark):
    code = '#include <iostream>\nusing namespace std;\n// int hidden = 1;\nclass Box { public: int width; };\n/* N gone */ int solve(int n, long MOD) {\n  string s = "in text"; bool ok = max(n, width_2) > __x && _y;\n  cout << s << endl; return var_0_7 + n;\n}\n'
    got = spark.range(1).select(T.identifiers(F.lit(code)).alias("v")).first().v
    assert got == ["Box", "_y", "n", "ok", "s", "solve", "var_0_7", "width", "width_2"]


def test_new_names_are_no_old_ones(spark, tmp_path):
    pages = [(7, "var_0_7 = a + b + var_1_7_;"), (8, "x = y"), (9, ""), (10, None)]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    p = catalogue._picked(spark, str(tmp_path))
    words = F.regexp_extract_all("code", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    for r in p.select("page_id", "code", "picked", T.fresh_names(F.col("picked"), words, F.col("page_id")).alias("new")).collect():
        old = set(r.code.replace(";", " ").split())
        assert len(set(r.new)) == len(r.picked) and not set(r.new) & old


def test_features_of_programs(spark):
    codes = [synth.snippet(k, depth=3, most_lines=15, loops=k % 2 == 1) for k in range(200)] + ["a = 1", "a = 1 + b\nif a < -3:\n\tb = a - -2"]
    got = spark.createDataFrame(list(enumerate(codes)), "k int, code string").select("k", T.program_features(F.col("code")).alias("f")).select("k", "f.*").collect()
    for r in got:
        tree = ast.parse(codes[r.k])
        blocks = [0] * 11
        ops = {"+" if isinstance(n.op, ast.Add) else "-" for n in ast.walk(tree) if isinstance(n, ast.BinOp)}

        def walk(body, level):
            deepest = level
            for n in body:
                if isinstance(n, (ast.If, ast.For)):
                    blocks[level] += 1
                    deepest = max(deepest, walk(n.body, level + 1))
            return deepest

        assert (r.max_depth, r.line_count) == (walk(tree.body, 0), len(codes[r.k].split("\n")))
        assert r.if_count == blocks and set(r.ops) == ops


def test_ranked_names(spark):
    got = [r.n for r in spark.range(0, 26 + 676 + 3).select(names.ranked(F.col("id")).alias("n")).collect()]
    assert got[:2] == ["a", "b"] and got[26:28] == ["aa", "ab"] and got[26 + 676 :] == ["aaa", "aab", "aac"] and len(set(got)) == len(got)


def test_ranked_names_are_those_of_the_sql_beyond_five_letters(spark, tmp_path):
    ids = [0, 1, 18, 19, 493, 494, 12844, 12845, 333962, 333963, 333964, 400_000, 599_999, 5_999_999, 10**9, 10**11, 10**13, None]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("ranked_names", "ranked_names_whole"):
        got = {r.n: r.name for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.sql(catalogue.ORACLE_SQL[name]).fetchall()) and len(got) == len(ids)
    assert got[333964 * 37] == "aaaabm" and got[10**13 * 37] is None


def test_no_token_of_a_long_step_is_lost():
    tok = [str(i) for i in range(20)]
    got = synth.context_windows(tok, [0, 2, 15, 18, 20], 6, whole=True)
    assert {x for _, w, _ in got for x in w} - {"\n\n"} == set(tok)


def test_a_class_larger_than_a_block(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), 0 if i < 150 else int(i % 4), [float(round(x, 1)) for x in rng.normal(size=3)]) for i in range(220)]
    v = knn.normalised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    local = sorted(((r.vec_id, r.label, np.array(r.v)) for r in v.collect()), key=lambda r: r[0])
    total, n = 0.0, 0
    for i, own, x in local:
        size = sum(lab == own for _, lab, _ in local) - 1
        order = sorted((c for c in local if c[0] != i), key=lambda c: (-float(x @ c[2]), c[0]))[:size]
        hits, part = 0, 0.0
        for rank, c in enumerate(order, 1):
            if c[1] == own:
                hits += 1
                part += hits / rank
        total, n = total + part / size, n + 1
    assert all(abs(knn.map_at_r(v, b).first().map_at_r - total / n) < 2e-3 for b in (7, 4096))
    assert knn.map_at_r(v.limit(0)).first().n_queries == 0


def test_blocks_leave_no_copies_of_the_gallery_on_disk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, [float(x) for x in rng.normal(size=32)]) for i in range(2000)]
    v = knn.normalised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")).localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    at = [written()]
    got = []
    for block in (4096, 20):
        got.append(knn.map_at_r(v, block).first())
        at.append(written())
    assert got[0] == got[1] and got[0].n_queries == 2000
    assert at[2] - at[1] < 3 * (at[1] - at[0])


def test_equal_vectors_tie_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=64).tolist(), rng.normal(size=64).tolist()
    rows = [(i, int(rng.integers(3)), x if i % 2 else y) for i in range(301)]
    v = knn.normalised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5))
    for block in (1, 4096):
        got = {}
        for r in knn.neighbours(v, v, 4, block).collect():
            got.setdefault(r.q_id, []).append((r.rank, r.c_id))
        for i in range(301):
            assert [c for _, c in sorted(got[i])] == [c for c in range(i % 2, 301, 2) if c != i][:4]


def test_running_sums_and_ties(spark):
    df = spark.createDataFrame([(i // 3, i, i % 2) for i in range(50)], "k int, i int, v int")
    got = sorted((r.rn, r.i, r.s) for r in C.with_running(df, "v", "s", "k", ("i",)).collect())
    assert got == [(i + 1, i, sum(j % 2 for j in range(i + 1))) for i in range(50)]


def test_the_slice_cuts_tokens_once(spark):
    seen = []
    settled = C.settled
    C.settled = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df)
    try:
        catalogue.QUERIES["corpus_slice"](spark, "/root/testdata/sf0.001")
    finally:
        C.settled = settled
    assert max(p.count("regexp_extract_all") for p in seen) == 1
