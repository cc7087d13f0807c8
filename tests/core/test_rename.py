import pytest

from loomwork.operators import rename, synth


def test_renamed_programs_do_the_same():
    for seed in range(100):
        code = synth.snippet(seed, loops=seed % 2 == 1)
        maps = rename.permutations(code, 16, 1)
        assert len({tuple(m.items()) for m in maps}) == 16
        for names in maps[:3]:
            other = rename.rename_tree(code, names)
            try:
                want = [(e, n, [(names[k], v) for k, v in s]) for e, n, s in synth.trace(code)]
            except synth.TraceError as error:
                with pytest.raises(synth.TraceError, match=str(error)):
                    synth.trace(other)
                continue
            assert synth.trace(other) == want


def test_few_names_have_few_permutations():
    assert len(rename.permutations("a = 1", 128, 0)) == 26 and rename.permutations("", 5, 0) == []


def test_edges_of_renamed_programs(spark):
    df = spark.createDataFrame([(1, "a = 1"), (1, "a = 1"), (2, None), (3, "not a program ("), (4, "")], "ex_id long, text string")
    assert sorted(r.ex_id for r in rename.renamed_programs(df, 2).collect()) == [1, 1, 1, 1]


def test_misaligned_sets_are_told(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "index int, code string")
    b = spark.createDataFrame([(0, "q", 1), (1, "r", 1)], "index int, code string, num_renamed int")
    assert rename.aligned(a, b).count() == 2
    with pytest.raises(ValueError):
        rename.aligned(a, b.limit(1))
