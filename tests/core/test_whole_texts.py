"""Queries over whole texts: nothing past a first block is left out."""

from loomwork.functions import text as T
from loomwork.functions.vocab import BASE
from loomwork.plans import catalogue
from pyspark.sql import functions as F


def test_text_windows_hold_every_token(spark, tmp_path):
    texts = ["", "a", "ab. " * 700, "x" * 512, "y" * 513, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = {r.doc_id: r.tok for r in catalogue.stepped(spark, str(tmp_path)).select("doc_id", T.tokens(F.col("text")).alias("tok")).collect()}
    got = {}
    for r in sorted(catalogue.QUERIES["text_windows"](spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.x) == len(r.y) == 512 and r.start == 512 * len(got.get(r.doc_id, []))
        assert r.mask_from == (r.x.index(BASE.boundary) if BASE.boundary in r.x else -1)
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {0, 1, 2, 3, 4} and len(got[2]) > 1 and len(got[4]) == 2
    for i, t in tok.items():
        assert [w for r in got[i] for w in r.x if w != "PAD"] == t
        assert [w for r in got[i] for w in r.y if w != "PAD"] == t[1:]
    assert any(r.mask_from >= 0 for r in got[2][1:])


def test_padded_blocks_take_the_block_of_the_reference(spark, tmp_path):
    spark.createDataFrame([(0, "7" * 397), (1, "7" * 500)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.padded for r in catalogue.QUERIES["padded_blocks"](spark, str(tmp_path)).collect()}
    assert got[0][0] == got[1][0] == -1 and got[0][-2:] == [-2, -3] and got[1][-1] == -2 and len(got[0]) == len(got[1]) == 400
