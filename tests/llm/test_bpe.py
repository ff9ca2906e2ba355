import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mdframe.llm.bpe import BATCH_BYTES, digest_documents, digested, encode_documents, encoder, merge_by_rank

from .conftest import prose

ENC = encoder()
REF = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("aab  the ing's\n\t12é")), max_size=80))
def test_equals_library(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)
    assert ENC.decode(ENC.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24))
def test_pieces_equal_merges(raw):
    if raw:
        assert ENC.encode_piece(raw) == [ENC.ranks[p] for p in merge_by_rank(raw, ENC.ranks)] or raw in ENC.ranks


def test_long_runs_are_linear():
    for text in ("a" * 150_000, "ab" * 75_000, " " * 100_000, "xyz!" * 30_000):
        assert ENC.encode(text) == REF.encode_ordinary(text)


def test_documents(odd, empty):
    rows = digest_documents(odd, with_ids=True).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        ids = REF.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    whole = encode_documents(odd).where("doc_id = 4").collect()
    assert len(whole) == 2 and bytes(whole[0]["decoded"]).decode() == texts[4]
    assert digest_documents(empty).collect() == []


def test_ids_of_a_large_batch_are_not_held_at_once():
    """One batch as Spark makes them, ids and all in pieces of bounded size, and nothing remembered when the task is over."""
    texts = [f"{prose(k, 400, 10**6)} é😀" if k % 7 else None for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts, pa.string())], names=["k", "t"])
    made = list(digested(iter([batch.slice(0, 0), batch.slice(5)]), with_ids=True))
    assert max(b.nbytes for b in made) < 2 * BATCH_BYTES < batch.nbytes and not ENC.pieces and not ENC.pairs
    assert [k for b in made for k in b.column(0).to_pylist()] == list(range(5, 3000))
    assert [i for b in made for i in b.column(4).to_pylist()] == [REF.encode_ordinary(t or "") for t in texts[5:]]
