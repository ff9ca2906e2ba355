"""The queries as they are registered, on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from mdframe.llm import registry
from mdframe.llm.bpe import encoder
from mdframe.llm.common import table
from mdframe.llm.shards import END_OF_TEXT, LENGTH

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {x} as select * from '{DATA}/{x}.parquet'")
    return c


@pytest.fixture(scope="module")
def tokens(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder().ranks, special_tokens={})
    return {r["doc_id"]: (r["text"] or "", enc.encode_ordinary(r["text"] or "")) for r in table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    other = duck.sql(registry.oracle_sql()[name])
    assert sorted(other.columns) == sorted(frame.columns)
    columns = frame.columns
    own = sorted(map(tuple, frame.collect()), key=str)
    assert own and own == sorted((tuple(r[other.columns.index(c)] for c in columns) for r in other.fetchall()), key=str)


def test_byte_bpe(spark, tokens):
    rows = registry.queries()["op3_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        text, ids = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_token_shards(spark, tokens):
    rows = registry.queries()["op7_token_shards"](spark, DATA).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and any(r["slot"] > 0 for r in rows if r["doc_id"] == rows[0]["doc_id"])
    got = {(r["doc_id"], r["seq_no"]): (r["n_tokens"], r["tokens_sha256"]) for r in rows}
    want = {}
    for doc, (_, ids) in tokens.items():
        ids = [*ids, END_OF_TEXT]
        for k in range(-(-len(ids) // LENGTH)):
            piece = ids[k * LENGTH : (k + 1) * LENGTH]
            want[doc, k] = (len(piece), hashlib.sha256(np.array(piece, "<u2").tobytes()).hexdigest())
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("name, columns", [("op8_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op9_language_id", ["doc_id", "held_out", "lang_pred", "score"]), ("op10_quality", ["doc_id", "held_out", "score", "predicted"])])
def test_classifiers(spark, tokens, name, columns):
    rows = registry.queries()[name](spark, DATA).collect()
    assert list(rows[0].asDict()) == columns and sorted(r["doc_id"] for r in rows) == sorted(tokens) and all(0 <= r["score"] <= 1 for r in rows)
