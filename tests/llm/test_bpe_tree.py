import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from loomwork.llm import bpe_tree

FILE = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe_tree.load_ranks(FILE)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "\n", "it's we'll  they've 're '", "a" * 3000, "äöü" * 500, " \t\n x  y   　z", "x'" + "r" + "e", "日本語のテキスト" * 40, "\u0000\u001c\u0085  ", "🙂🙃" * 50, "123 456,789!!??" * 30, "ab ab" * 700, "the " * 999, "'" * 100 + "ll"]


@pytest.mark.parametrize("leaf", [8192, 16, 5, 1])
def test_ids_are_those_of_the_plain_encoder(leaf):
    bpe = bpe_tree.TreeBpe(RANKS, P.PATTERN, leaf_chars=leaf, leaf_bytes=2)
    for text in TEXTS:
        assert bpe.encode(text) == TIK.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_random_texts_at_any_leaf_size():
    rng = random.Random(5)
    for n in range(400):
        text = "".join(rng.choice("aelrstv'' \n\t.!1 éß漢") for _ in range(rng.randrange(80)))
        bpe = bpe_tree.TreeBpe(RANKS, P.PATTERN, leaf_chars=rng.choice((1, 2, 3, 7)), leaf_bytes=rng.choice((1, 2, 5)), cached=3)
        assert bpe.encode(text) == TIK.encode_ordinary(text), text


def test_long_merge_equals_short_merge():
    bpe, rng = bpe_tree.TreeBpe(RANKS, P.PATTERN), random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"aabetoin r") for _ in range(rng.randrange(1, 60)))
        assert bpe._merge_long(data) == bpe.merge(data)


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "it's", 5), (1, "it's", 5), (2, None, 1), (None, "", 2), (3, "long word " * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = bpe_tree.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        want = TIK.encode_ordinary({1: "it's", 2: "", None: "", 3: "long word " * 5000}[r.doc_id])
        assert r.token_ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe_tree.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0
