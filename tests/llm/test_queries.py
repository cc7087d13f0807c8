"""The queries as they are registered, over the smallest tables: beside their SQL, and against what their contracts say."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from loomwork.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    q = con.sql(Q.ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    order = [q.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in order]) for r in q.fetchall())


def test_op1_counts_and_base_scores(spark, docs):
    got = {r.doc_id: r for r in Q.op1_brown_lm(spark, SF).collect()}
    seen, n_docs = Counter(), 0
    for i, t in docs.items():
        if rest(i, 10):
            n_docs += 1
            seen.update(WORD.findall(lower(t)))
    total, types = sum(seen.values()) + n_docs, len(seen) + 1
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
    assert set(got) == set(docs)
    for i, t in docs.items():
        words, r = WORD.findall(lower(t)), got[i]
        want = sum(base(seen[w]) for w in words) + base(n_docs)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i, 10) == 0, len(words) + 1, sum(seen[w] > 0 for w in words) + 1, total)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0


def test_op2_sizes_targets_and_repeats(spark, docs):
    got = Q.op2_mix_sources(spark, SF).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(WORD.findall(t)) for i, t in docs.items()}
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, Q.op2_mix_sources(spark, SF).collect()))


@pytest.mark.parametrize(("name", "parts", "out", "least"), [("op4_quality_net", 5, 0, 0.3), ("op9_weak_toxicity", 3, 1, 0.7)])
def test_classifiers_tell_held_out_rows(spark, docs, name, parts, out, least):
    got = Q.QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (rest(r.doc_id, parts) == out) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in got)


def test_op3_reads_conversation_minus_one(spark):
    (r,) = Q.op3_chat_format(spark, SF).filter("conv_id = -1").collect()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(said)) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op5_edits(spark, docs):
    got = {r.doc_id: r for r in Q.op5_simhash(spark, SF).collect()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        text, other = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_next == 1 - (int(got[i].fingerprint, 16) ^ int(got[order[(k + 1) % len(order)]].fingerprint, 16)).bit_count() / 64


def test_op7_payloads(spark, docs):
    for r in Q.op7_tiff_media(spark, SF).collect():
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_op10_as_the_library_would(spark, docs):
    import public_tokenizers
    import tiktoken
    from loomwork.llm.bpe_tree import load_ranks

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(Q.TOKENIZER)), special_tokens={})
    for r in Q.op10_bpe_tree(spark, SF).collect():
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
