"""Byte-level BPE by backtracking over longest matches, in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over ``str`` finds all vocabulary entries of
a piece in one pass. Encoding walks from the longest entry at each position and backtracks to the next shorter prefix
whenever two adjacent entries would not stand next to one another in the merge order; that test is memoised. The
result is the one that applying the merges by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from mdframe.llm.common import resting, slices, table, tune

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, and pairs of entries, that a task remembers, at most.
CACHE_PIECES, CACHE_PAIRS = 500_000, 500_000
CACHE_CHARS = 40
#: Bytes of text whose ids are held at once: they are several times as large as the texts.
BATCH_BYTES = 2 << 20

#: The letters, numbers and white space below U+0100, for a faster splitter of Latin-1 texts.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary entry -> rank, from a file of base64 entries and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], limit: int | None = None) -> list[bytes]:
    """The plain algorithm: apply the lowest-ranked merge until none is left. Quadratic; for tables and tests."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (limit is None or rank < limit) and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Pieces(dict):
    """Piece -> ids as little-endian bytes; filled on demand, emptied when it is full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class BytePairEncoder:
    """``encode`` and ``decode`` under a rank file and a splitting pattern; no special tokens."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        import public_tokenizers

        self.ranks = read_ranks(path or vocabulary_path())
        self.entries = {i: t for t, i in self.ranks.items()}
        self.split_any = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.own_pattern = pattern is not None
        self._tables()
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self.encode_piece)

    def _tables(self) -> None:
        """Halves of each entry, the entry of each pair of halves, and the next shorter prefix of each entry."""
        ranks = self.ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        usable = set()
        for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(entry) == 1:
                self.halves[rank] = (rank, rank)
            else:
                parts = merge_by_rank(entry, ranks, rank)
                if len(parts) != 2 or any(p not in ranks for p in parts):
                    continue  # no sequence of merges makes it
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank] = pair
                self.joined[pair] = rank
            usable.add(entry)
            self.trie.add_word(entry.decode("latin-1"), (rank, len(entry)))
        self.trie.make_automaton()
        self.length = {ranks[e]: len(e) for e in usable}
        self.shorter = {}
        for entry in usable:
            for k in range(len(entry) - 1, 0, -1):
                if entry[:k] in usable:
                    self.shorter[ranks[entry]] = ranks[entry[:k]]
                    break

    def split(self, text: str) -> list[str]:
        """The pieces that the pattern makes."""
        if not self.own_pattern:
            try:
                text.encode("latin-1")
                return _LATIN(text)
            except UnicodeEncodeError:
                pass
        return self.split_any(text)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side, memoised."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the latest merge of the two again and again: no pair at the seam may merge earlier than that."""
        joined, halves = self.joined, self.halves
        limit = 1 << 62
        while True:
            made = joined.get((left, right))
            if made is not None and made < limit:
                return False
            inner, outer = halves[left][1], halves[right][0]
            can_left, can_right = inner != left, outer != right
            if can_left and (left > right or not can_right):
                limit, left = left, inner
            elif can_right:
                limit, right = right + 1, outer
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, reach = [0] * n, [0] * n
        for end, (rank, size) in self.trie.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, rank
        open_ends = bytearray(b"\1") * (n + 1)
        length, shorter, known = self.length, self.shorter, self.pairs.get
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            fits = open_ends[end]
            if fits and out:
                fits = known(out[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif token in shorter:
                token = shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def forget(self) -> None:
        """Drop what is remembered of pieces and pairs."""
        self.pieces.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.entries.__getitem__, ids))


_encoders: dict[tuple, BytePairEncoder] = {}


def encoder(path: str | None = None) -> BytePairEncoder:
    """One encoder a process and file."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns ``key``, ``ids`` (array of int) and ``decoded`` (binary). Null and empty texts give empty ids and bytes; repeated
    rows and keys are kept as they are; other columns of ``docs`` are ignored.
    """
    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, BATCH_BYTES):
            ids = [np.frombuffer(enc.encode_bytes(t), "<u4").astype("i4") for t in batch.column(1).to_pylist()]
            decoded = [enc.decode(x.tolist()) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
            flat = np.concatenate(ids) if ids else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(decoded, pa.binary())],
                names=["k", "ids", "decoded"],
            )
        enc.forget()

    out = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return out.mapInArrow(resting(run), "k long, ids array<int>, decoded binary").withColumnRenamed("k", key)


def digested(batches, path: str | None = None, with_ids: bool = False):
    """Record batches ``(k, text)`` to batches of :func:`digest_documents`; what was remembered of the texts goes at the end."""
    enc = encoder(path)
    for batch in slices(batches, BATCH_BYTES):
        n, ids_sha, text_sha, raws = [], [], [], []
        for t in batch.column(1).to_pylist():
            raw = enc.encode_bytes(t)
            n.append(len(raw) // 4)
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            text_sha.append(hashlib.sha256(enc.decode(memoryview(raw).cast("I"))).hexdigest())
            raws.append(raw)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(n)]).astype("i4")
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)
    enc.forget()


def digest_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """As :func:`encode_documents`, but with counts and digests made beside the encoder, so that decoded texts never leave the worker.

    ``with_ids`` adds the ids as an array.
    """
    out = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    schema = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return out.mapInArrow(resting(lambda it: digested(it, path, with_ids)), schema).withColumnRenamed("k", key)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents; a row for each row (see :func:`digest_documents`)."""
    tune(spark)
    return digest_documents(table(spark, sf_dir, "documents"))
