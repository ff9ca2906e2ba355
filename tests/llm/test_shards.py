import time

import numpy as np
import zstandard

from mdframe.llm.common import local_path, new_path
from mdframe.llm.shards import END_OF_TEXT, LENGTH, _encoding, _ids, _packed, _unpacked, feistel, read_slots, write_shards


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(feistel(np.arange(n), n).tolist()) == list(range(n))
    a, b = feistel(np.arange(1000), 1000, 1), feistel(np.arange(1000), 1000, 2)
    assert (a != b).any() and (a == feistel(np.arange(1000), 1000, 1)).all()


def test_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 70):
        rows = [(int(s), None if k % 5 == 3 else int(d), int(q), rng.integers(0, 50257, c).astype("<u2").tobytes()) for k, (s, d, q, c) in enumerate(zip(rng.integers(0, 2**62, n), rng.integers(-(2**63), 2**63 - 1, n), rng.integers(0, 2**31 - 1, n), rng.integers(1, LENGTH + 1, n), strict=True))]
        assert _unpacked(_packed(rows), n) == rows


def test_shards(spark, odd, empty):
    folder = new_path(spark, "shards")
    rows = write_shards(odd.repartition(3), folder, shard_size=64).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    seqs = read_slots(folder, 0, len(rows) + 10, 64)
    assert seqs.shape == (len(rows), LENGTH)
    assert (read_slots(folder, 70, 5, 64) == seqs[70:75]).all()
    enc, found = _encoding(None), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["seq_no"])):
        assert r["shard"] == r["slot"] // 64 and r["byte_offset"] == r["slot"] % 64 * LENGTH * 2
        found.setdefault(r["doc_id"], []).append((r["seq_no"], seqs[r["slot"]][: r["n_tokens"]].tolist()))
    for r in odd.select("doc_id", "text").distinct().collect():
        copies = 2 if r["doc_id"] == 4 else 1
        ids = [*enc.encode_ordinary(r["text"] or ""), END_OF_TEXT]
        pieces = [(k, ids[k * LENGTH : (k + 1) * LENGTH]) for k in range(-(-len(ids) // LENGTH))]
        assert sorted(found[r["doc_id"]]) == sorted(pieces * copies)
    again = new_path(spark, "shards")
    write_shards(odd.repartition(3), again, shard_size=64).count()
    assert local_path(folder) != local_path(again)
    assert write_shards(empty, new_path(spark, "shards")).collect() == []


def test_ids_are_those_of_plain_text():
    enc = _encoding(None)
    for text in (None, "", "a <|endoftext|> b<|endoftext|>", "\x00é😀<|endof", " " * 3000):
        assert _ids(enc, text).tolist() == [*enc.encode_ordinary(text or ""), END_OF_TEXT] and (_ids(enc, text)[:-1] != END_OF_TEXT).all()


def test_packing_is_cheap(odd):
    """Close to the smallest size at less than half of the time that takes."""
    raw = _ids(_encoding(None), odd.where("doc_id = 3").first()["text"]).tobytes()
    rows = [(k, k, 0, raw[k * 512 : (k + 1) * 512]) for k in range(len(raw) // 512)]
    least = lambda run: min(-time.process_time() + (run() and time.process_time()) for _ in range(5))
    data = b"".join(r[3] for r in rows)
    assert least(lambda: _packed(rows)) < 0.5 * least(lambda: zstandard.compress(data, 15))
    assert len(_packed(rows)) < 1.05 * len(zstandard.compress(data, 15)) + 8 * len(rows)
