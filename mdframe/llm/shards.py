"""Token shards in training order.

Every text becomes sequences of ``LENGTH`` token ids. Sequences are numbered in the order of the input; a keyed Feistel permutation with
cycle-walking gives each number a global slot, without any sort by random keys. Ranges of slots are written as shards of fixed stride, so slot
``s`` is at byte ``(s % shard_size) * LENGTH * 2`` of shard ``s // shard_size``: reading on from any slot is one seek.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import new_path, scratch, table, tune

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
LENGTH = 256
STRIDE = LENGTH * 2
SHARD_SIZE = 4096
#: Shards that a task writes, at most.
SHARDS_A_TASK = 64
#: Bytes of sequences that a task gathers by shard before it compresses and sends them.
GATHERED = 32 << 20
#: Effort of zstd on tokens between stages, staged and shuffled; on shuffled ones level 15 takes four times the CPU seconds of 6 for 2 % less.
LEVEL, BLOB_LEVEL = 9, 6
#: Bytes that staged tokens are compressed by: texts repeat one another over longer stretches than Parquet's usual page.
PAGE_BYTES = 8 << 20
KEY = 20240607
ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of ``range(n)``: a balanced Feistel network over the next power of four, walked until back in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


_encodings: dict = {}


def _encoding(path: str | None):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        # the library looks for special tokens by a pattern of them, which must not be empty in ``encode_to_numpy``
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END_OF_TEXT})
    return _encodings[path]


def _ids(enc, text: str | None) -> np.ndarray:
    """A text's ids, none of them special whatever it spells, and an end of text."""
    return np.append(enc.encode_to_numpy(text or "", disallowed_special=()), END_OF_TEXT).astype("<u2")


def _tokens(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """``(doc_id, k, ids, local, part)``: a text's ids and an end of text, as little-endian unsigned 16-bit integers; its number of
    sequences; and how many its partition has before it."""
    def run(it):
        enc, at = _encoding(path), 0
        for batch in it:
            ids = [_ids(enc, t) for t in batch.column(1).to_pylist()]
            k = np.array([-(-len(x) // LENGTH) for x in ids], np.int64)
            end = at + np.cumsum(k)
            at = int(end[-1]) if len(end) else at
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(end - k)], names=["doc_id", "k", "ids", "local"]
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, k long, ids binary, local long").withColumn("part", F.spark_partition_id())


def _planes(values: np.ndarray) -> bytes:
    """Numbers as the differences from one to the next, all lowest bytes first: mostly zeros, which cost nothing when compressed."""
    return np.diff(values, prepend=values.dtype.type(0)).view("u1").reshape(len(values), -1).T.tobytes()


def _numbers(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, "u1", n * size, at).reshape(size, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _packed(rows: list[tuple]) -> bytes:
    """Sequences (slot, doc_id, seq_no, ids) of one shard, compressed together."""
    slot, doc, seq, data = zip(*rows, strict=True)
    parts = [
        np.array(slot, "<i8"), np.array([0 if d is None else d for d in doc], "<i8"), np.array([d is None for d in doc], "u1"),
        np.array(seq, "<i4"), np.array([len(d) // 2 for d in data], "<i4"),
    ]
    return zstandard.compress(b"".join([_planes(x) for x in parts] + list(data)), BLOB_LEVEL)


def _unpacked(blob: bytes, n: int) -> list[tuple]:
    raw = zstandard.decompress(blob)
    out, at = [], 0
    for kind, size in (("<i8", 8), ("<i8", 8), ("u1", 1), ("<i4", 4), ("<i4", 4)):
        out.append(_numbers(raw, kind, n, at).tolist())
        at += size * n
    slot, doc, null, seq, count = out
    rows = []
    for s, d, x, q, c in zip(slot, doc, null, seq, count, strict=True):
        rows.append((s, None if x else d, q, raw[at : at + 2 * c]))
        at += 2 * c
    return rows


def _put(folder: str, name: str, data: bytes) -> bytes:
    """Write a file under another name, rename it, and read it back; a repeated task writes the same bytes again."""
    unique = f".{name}.{os.getpid()}.{os.urandom(4).hex()}"
    if folder.startswith(("file:", "/")):
        base = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
        os.makedirs(base, exist_ok=True)
        with open(f"{base}/{unique}", "wb") as f:
            f.write(data)
        os.replace(f"{base}/{unique}", f"{base}/{name}")
        with open(f"{base}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{unique}") as f:
        f.write(data)
    store.move(f"{base}/{unique}", f"{base}/{name}")
    with store.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, shard_size: int = SHARD_SIZE, seed: int = KEY) -> DataFrame:
    """Write the shards of ``docs`` to ``folder``, shared by all executors, when the result is computed.

    Returns a row for each sequence, from the shard as read back: ``doc_id, seq_no, slot, shard, byte_offset, n_tokens, tokens_sha256``. A null or
    empty text is one sequence that holds the end of text; repeated rows have sequences of their own; rows with a null id come first.
    Places after a sequence's last token hold the end of text too. The last shard may be shorter.
    """
    tokens = _tokens(docs, key, text, path)
    staging = scratch(docs.sparkSession, "tokens")
    tokens.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVEL)).option("parquet.page.size", str(PAGE_BYTES)).parquet(staging)
    held = docs.sparkSession.read.schema(tokens.schema).parquet(staging)
    total, before = 0, {}
    for part, k in sorted(held.groupBy("part").agg(F.sum("k")).collect()):  # a row for each partition of the input
        before[part] = total
        total += k

    def cut(it):
        shards: dict[int, list] = {}
        size = 0

        def send():
            names = sorted(shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([len(shards[x]) for x in names], pa.int64()), pa.array([_packed(shards[x]) for x in names], pa.binary())],
                names=["shard", "rows", "blob"],
            )

        for batch in it:
            docs_, raws, local, part = (batch.column(c).to_pylist() for c in range(4))
            number, rows = [], []
            for doc, raw, start, p in zip(docs_, raws, local, part, strict=True):
                for k in range(-(-len(raw) // STRIDE)):
                    number.append(before[p] + start + k)
                    rows.append((doc, k, raw[k * STRIDE : (k + 1) * STRIDE]))
            for slot, (doc, k, piece) in zip(feistel(np.array(number, np.int64), total, seed).tolist(), rows, strict=True):
                shards.setdefault(slot // shard_size, []).append((slot, doc, k, piece))
                size += STRIDE
            if size >= GATHERED:
                yield from send()
                shards.clear()
                size = 0
        if shards:
            yield from send()

    pad = np.full(LENGTH, END_OF_TEXT, "<u2").tobytes()

    def close(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        back = _put(folder, f"shard-{shard:08d}.bin", b"".join(r[3] + pad[len(r[3]) :] for r in rows))
        at = [r[0] % shard_size * STRIDE for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([shard] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array([len(r[3]) // 2 for r in rows], pa.int32()),
                pa.array([hashlib.sha256(back[a : a + len(r[3])]).hexdigest() for a, r in zip(at, rows, strict=True)], pa.string()),
            ],
            names=["doc_id", "seq_no", "slot", "shard", "byte_offset", "n_tokens", "tokens_sha256"],
        )

    def write(it):
        now, rows = None, []
        for batch in it:
            for shard, n, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if now is not None and shard != now:
                    yield close(now, rows)
                    rows = []
                now = shard
                rows += _unpacked(blob, n)
        if now is not None:
            yield close(now, rows)

    sequences = held.select("doc_id", "ids", "local", "part").mapInArrow(cut, "shard long, rows long, blob binary")
    # slots are a permutation of a known range, so ranges of shards need no sample of the data
    shards = -(-total // shard_size)
    parts = max(1, min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_TASK))))
    dealt = sequences.repartitionById(parts, F.floor(F.col("shard") * parts / max(1, shards)).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(write, "doc_id long, seq_no int, slot long, shard long, byte_offset long, n_tokens int, tokens_sha256 string")


def read_slots(folder: str, start: int, count: int, shard_size: int = SHARD_SIZE) -> np.ndarray:
    """Sequences of slots ``start`` and on from local or mounted shards, a row each; fewer where the shards end."""
    base = folder.removeprefix("file://")
    out, slot = [], start
    while slot < start + count:
        name = f"{base}/shard-{slot // shard_size:08d}.bin"
        if not os.path.exists(name):
            break
        with open(name, "rb") as f:
            f.seek(slot % shard_size * STRIDE)
            raw = f.read(min(shard_size - slot % shard_size, start + count - slot) * STRIDE)
        if not raw:
            break
        out.append(np.frombuffer(raw, "<u2").reshape(-1, LENGTH))
        slot += len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, LENGTH), "<u2")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents, left in the shared folder, and a row for each sequence (see :func:`write_shards`)."""
    tune(spark)
    return write_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
