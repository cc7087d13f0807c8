import json
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.vocab import BASE, LEGACY, LOOPS, Vocabulary
from loomwork.operators import corpus as C
from loomwork.operators import knn, names, synth
from loomwork.sources import scan, sinks
from loomwork.streaming import facade


def test_vocabularies():
    assert (len(BASE.keywords), len(LOOPS.keywords), len(LEGACY.keywords)) == (52, 57, 77)
    assert BASE.keywords[0] == "\n#STEP\n" and BASE.ids["\n\n"] < BASE.ids["\n"]
    with pytest.raises(ValueError):
        Vocabulary.of(["a"])


def test_spans_of_hand_traces(spark):
    for steps, want in ((3, 37), (2, 18), (0, None)):
        parts = ["a = 1"] + ["@a = 1$" + "b" * 10] * steps
        tok = T.tokens(F.lit("\n#STEP\n".join(parts)))
        bounds = spark.range(1).select(T.boundaries(tok).alias("b")).first().b
        spans = [b - a for a, b in zip(bounds, bounds[2:])]
        got = spark.range(1).select(T.two_back_spans(T.boundaries(tok)).alias("s")).first().s
        assert got == spans and (bool(spans) == (steps >= 2))


def test_base26_and_sequence(spark):
    assert spark.range(1).select(T.base26(F.lit(9300), 3).alias("n")).first().n == "nts"
    got = {r.ordinal: r.state for r in names.sequence(spark, 2).collect()}
    x, want = 123456789 % 676, {}
    for i in range(676):
        want[i] = x
        x = (53 * x + 1) % 676
    assert got == want and got[69] == 174 and got[574] == 315 and len(set(got.values())) == 676
    far = names.sequence(spark, 4, 200_000).filter("ordinal = 199999").first().state
    a, c = names.skip(199_999, 26**4)
    assert far == (a * (123456789 % 26**4) + c) % 26**4


def test_outcomes(spark):
    cases = [("x y", "x y", "hard"), ("x y \n\nmore", "x y", "hard"), ("no\nlast", "yes\nlast\n", "soft"), ("a", "b", "fail"), (None, "b", "fail")]
    df = spark.createDataFrame(cases, "g string, r string, want string")
    assert all(r.got == r.want for r in df.select("want", T.outcome(F.col("g"), F.col("r")).alias("got")).collect())


def test_dedup_ordinals_and_splits_hold_for_any_partitioning(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        assert sorted(r.doc_id for r in C.dedup_keep_first(df).collect()) == list(range(7))
        ranked, n = C.with_ordinal(df, "doc_id")
        assert n == 60 and sorted((r.doc_id, r.rn) for r in ranked.collect()) == [(i, i + 1) for i in range(60)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert C.with_ordinal(empty, "doc_id")[1] == 0


def test_map_at_r_of_four_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, 1, [0.8, 0.2]), (5, 2, [0.5, 0.5])]
    v = knn.normalised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>"))
    r = knn.map_at_r(v).first()
    # 1: nearest 2, right; 2: nearest 1, right; 3: nearest 5, wrong; 4: nearest 2, wrong; 5 is alone
    assert (r.n_queries, r.map_at_r) == (4, 0.5)


def test_blocks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(i % 3), [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    v = knn.normalised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    one, many = ({(r.q_id, r.c_id, r.rank) for r in knn.neighbours(v, v, 5, b).collect()} for b in (1000, 13))
    assert one == many and len(one) == 450


def real_trace(code):
    """Steps as the interpreter's own trace function tells them."""
    steps, space = [], {}
    exec("def func():\n" + "\n".join("\t" + x for x in code.split("\n")), space)

    def local(frame, event, arg):
        if any(abs(v) > 999 for v in frame.f_locals.values()):
            raise ValueError
        steps.append((event, frame.f_lineno - 1 if event == "line" else 0, list(frame.f_locals.items())))
        return local

    old = sys.gettrace()
    sys.settrace(lambda f, e, a: local if f.f_code.co_name == "func" else None)
    try:
        space["func"]()
    finally:
        sys.settrace(old)
    return steps


@pytest.mark.parametrize("loops", [False, True])
def test_traces_are_those_of_the_interpreter(loops):
    seen = set()
    for seed in range(400):
        code = synth.snippet(seed, loops=loops, depth=3 if loops else 2)
        assert 5 <= len(code.split("\n")) <= 10
        try:
            want = real_trace(code)
        except Exception as e:
            want = type(e).__name__
        try:
            got = synth.trace(code)
        except synth.TraceError as e:
            got = str(e)
        assert got == want, code
        seen.add(want if isinstance(want, str) else "kept")
    assert "kept" in seen


def test_state_order_follows_the_text():
    steps = synth.trace("b = 1\nif b > 5:\n\tz = b\nc = b\nz = c")
    assert [n for n, _ in steps[-1][2]] == ["b", "z", "c"] and len(steps) == 5
    with pytest.raises(synth.TraceError, match="UnboundLocalError"):
        synth.trace("a = b\nb = 1")


def test_windows_start_at_boundaries():
    tok = list("abcdefghijklmnopqrst")
    got = synth.context_windows(tok, [0, 4, 8, 12, 16, 20], 9)
    assert [s for s, _, _ in got] == [0, 8, 16] and all(len(x) == len(y) == 9 for _, x, y in got)
    assert got[0][1] == tok[:9] and got[0][2] == tok[1:10] and got[-1][1][-1] == "\n\n"
    assert len(synth.context_windows(tok, [0, 15, 20], 4)) == 1


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ("c",)], "text string").coalesce(1)
    sinks.write_corpus(rows, f"{tmp_path}/corpus")
    assert sorted(r.text for r in scan.corpus(spark, f"{tmp_path}/corpus", strip=True).collect()) == ["a\nb", "c"]
    text = "a,\"q\"\n\tx"
    sinks.write_csv(spark.createDataFrame([(text, 1)], "t string, n int"), f"{tmp_path}/csv")
    assert scan.csv_rows(spark, f"{tmp_path}/csv", "t string, n int").first().t == text
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "m1.json").write_text(json.dumps({"acc": 0.5}))
    assert tuple(scan.json_results(spark, f"{tmp_path}/r/*.json", "model string, acc double").first()) == ("m1", 0.5)
    (tmp_path / "x.bin").write_bytes(bytes([1, 2, 255]))
    assert scan.token_file(spark, f"{tmp_path}/x.bin").first().ids == [1, 2, 255]
    (tmp_path / "y.bin").write_bytes(b"\x01\x00\x00\x07")
    assert scan.token_file(spark, f"{tmp_path}/y.bin", 2).first().ids == [256, 7]


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([("a = 1\n#STEP\n" * rng.randrange(9) + "b",) for _ in range(30)], "text string").coalesce(2)
    sinks.write_corpus(rows, f"{tmp_path}/in")
    facade.to_table(facade.filtered(facade.stream_corpus(spark, f"{tmp_path}/in"), 5), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().collect()
    want = C.route_by_span(scan.corpus(spark, f"{tmp_path}/in"), 5).groupBy("status").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 2
