"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A signature holds ``COMPONENTS`` MinHash values of ``BITS`` bits. Two signatures at a Hamming distance (differing components)
of at most ``RADIUS`` must agree, but for one component, in one of ``CHUNKS`` chunks, as ``2 * CHUNKS > RADIUS``. So each
signature is indexed under every chunk with every single component left out; equal keys find all pairs within the radius.

Keys are range-partitioned on (key, id): no key is too hot for its task, as a run of equal keys may span tasks. Runs of two give a
pair; the members of longer runs, and of runs that a border of partitions may have cut, are counted by key and dealt to
blocks of bounded size. There signatures are compared, and trees of the close pairs remain: a dense run of n ids leaves n - 1 pairs.
By a few keys, members first meet their block and some leaders of their run, which joins most near copies; then, by all keys, each pair
of a run that is not joined meets in some block, and members of its largest component are sent to those of the others only. Components are the groups in which links are confirmed on full sets. A large
group first meets its leader, the member nearest to the group's commonest signature, which costs one comparison a member. Members
linked with the leader are of one component, whatever their other links; only the others still meet everyone, in pairs of blocks,
and again only trees of the confirmed links leave a block. No list of all pairs is ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import connected_components, is_empty, resting, slices, staged, table, tune, unstage

COMPONENTS = 64
BITS = 16
CHUNKS = 16
#: Of pairs at a similarity of exactly 0.8 less than one in ten million is farther apart, of those at 0.85 less than one in 10^10.
RADIUS = 2 * CHUNKS - 1
#: Keys of the index, of different chunks, by which most near copies meet; all keys then need not bring those together again.
FIRST_KEYS = 4
#: Members of a long run, about, that meet all others in its first pass.
LEADERS = 16
#: Pairs that a task remembers so as not to write them again.
SEEN_PAIRS = 1_000_000
#: Signatures farther apart than this are not compared in full.
FARTHEST = RADIUS
#: Members of a run in a block; longer runs are dealt to all pairs of their blocks.
LONGEST_RUN = 1024
#: Rows of a run that the scan holds at once.
HELD_ROWS = 4096
#: Documents of a group in a block; two blocks are compared in full at once.
BLOCK = 128
#: Parts to which the members of a large group are dealt where they meet what is known of their group.
SALTS = 64
WORDS_KEPT = 200_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 1 << 63, (CHUNKS, 16), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_words = _Words()


def forget_words() -> None:
    """Drop the hashes of words in this process; a task's function would take a copy of ``_words`` itself along."""
    _words.clear()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text; a shorter text gives its whole sequence as one."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < size:
        return _mixed((w * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = w[: n - size + 1] * _PLACES[0]
    for i in range(1, size):
        s += w[i : n - size + 1 + i] * _PLACES[i]
    return np.unique(_mixed(s))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit MinHash signatures of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    step = np.empty_like(flat)
    for k in range(COMPONENTS):
        np.multiply(flat, _MUL[k], out=step)
        np.add(step, _ADD[k], out=step)
        out[:, k] = (np.minimum.reduceat(step, starts) >> np.uint64(16)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """All keys of each signature: a 64-bit hash for each chunk and each left-out component."""
    keys = []
    for c, cols in enumerate(np.array_split(np.arange(COMPONENTS), CHUNKS)):
        part = sig[:, cols].astype(np.uint64) + np.uint64(1)
        total = (part * _PLACES[: len(cols)]).sum(axis=1, dtype=np.uint64)
        for i in range(len(cols)):
            keys.append(_mixed(total - part[:, i] * _PLACES[i] + _SALT[c, i]))
    return np.stack(keys, axis=1)


def sign(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, digest, sig)`` of each row; digest and sig are null where the set is empty."""
    def run(it):
        for batch in slices(it):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([(x := next(sig)).tobytes() + x.astype(np.uint8).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "digest", "sig"],
            )
        forget_words()

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(resting(run), "doc_id long, n long, digest binary, sig binary")


def _keyed(classes: DataFrame, part: slice) -> DataFrame:
    def run(it):
        for batch in it:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(x[: 2 * COMPONENTS] for x in batch.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
            keys = np.ascontiguousarray(index_keys(sig)[:, part]).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(resting(run), "key long, id long")


def _rows(kind: int, a, b) -> pa.RecordBatch:
    a, b = (np.ascontiguousarray(x, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _scan(it):
    """Of rows sorted by (key, id): pairs of whole runs of two (0), and (key, id) of all other rows that may have a partner (1).

    The first and the last run of a partition may go on in its neighbours, so their rows are members whatever their number.
    """
    held, border = None, True  # rows of the run that is still open, and whether it began the partition
    for batch in it:
        if not len(batch):
            continue
        k, i = (c.to_numpy() for c in batch.columns)
        if held is not None:
            k, i = np.concatenate([held[0], k]), np.concatenate([held[1], i])
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        tail = starts[-1]
        sizes = np.diff(starts)
        if len(sizes):
            starts = starts[:-1]
            many = sizes > 2
            many[0] |= border
            border = False
            two = starts[(sizes == 2) & ~many]
            if len(two):
                yield _rows(0, i[two], i[two + 1])
            more = np.repeat(many, sizes)
            if more.any():
                yield _rows(1, k[:tail][more], i[:tail][more])
        held = k[tail:], i[tail:]
        if len(held[0]) > HELD_ROWS:  # what is left of a long run is treated as a run of a border
            yield _rows(1, *held)
            held, border = (k[:0], i[:0]), True
    if held is not None and len(held[0]):
        yield _rows(1, *held)


def _near(sig: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Trees of the pairs of ids within ``FARTHEST``, of each run of signatures."""
    found = []
    for s in range(2, 6):
        some = starts[sizes == s]
        for p in range(s if len(some) else 0):
            for q in range(p + 1, s):
                near = (sig[some + p] != sig[some + q]).sum(axis=1) <= FARTHEST
                found.append(np.stack([ids[some + p][near], ids[some + q][near]], 1))
    for start, size in zip(starts[sizes > 5], sizes[sizes > 5], strict=True):
        own, some = sig[start : start + size], ids[start : start + size]
        pairs = [np.argwhere((own[r : r + 64, None] != own[None]).sum(axis=2) <= FARTHEST) + [r, 0] for r in range(0, size, 64)]
        x, y = np.concatenate(pairs).T
        known, place = np.unique(some, return_inverse=True)  # members of one component are one vertex
        found.append(np.stack([known[spanning(len(known), place[x], place[y])], known], 1))
    found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0)


def _compare(it):
    """Of rows (block, id, component, short signature) sorted by block: trees of the close pairs of each block, as pairs of components."""
    held, seen = None, set()

    def fresh(found: np.ndarray):
        new = [p for p in map(tuple, found.tolist()) if p not in seen]
        seen.update(new if len(seen) < SEEN_PAIRS else ())
        if new:
            yield _pairs(np.array(new, np.int64))

    for batch in it:
        if not len(batch):
            continue
        k, c = (batch.column(x).to_numpy() for x in (0, 2))
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COMPONENTS)
        if held is not None:
            k, c, sig = (np.concatenate(x) for x in zip(held, (k, c, sig), strict=True))
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        yield from fresh(_near(sig, c, starts[:-1], np.diff(starts)))
        held = k[starts[-1] :], c[starts[-1] :], sig[starts[-1] :]
    if held is not None:
        yield from fresh(_near(held[2], held[1], np.array([0]), np.array([len(held[0])])))


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy(), pa.int64()), pa.array(found[:, 1].copy(), pa.int64())], names=["a", "b"])


def _own_block(key: Column | str, blocks: Column | str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), blocks)


def _all_blocks(name: str, own: Column, blocks: Column) -> Column:
    """Names of all pairs of blocks of ``name`` in which block ``own`` takes part; two names that collide only add comparisons."""
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.xxhash64(F.col(name), F.least(own, o), F.greatest(own, o)))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex in the component of each of ``n``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def similar_sets(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of ``percent`` / 100 or more."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        same = np.array([[0, (both[1:] == both[:-1]).sum()], [0, 0]])
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        same = np.zeros((len(sets), len(sets)))
        wide = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            lo, hi = np.searchsorted(column, [start, start + wide])
            x = np.zeros((len(sets), wide), np.float32)
            x[row[lo:hi], column[lo:hi] - start] = 1
            same += x @ x.T
    i, j = np.triu_indices(len(sets), 1)
    inter = same[i, j]
    ok = 100 * inter >= percent * (size[i] + size[j] - inter)
    return i[ok], j[ok]


def _links(docs: DataFrame, placed: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Trees of the confirmed links among documents that share a block; ``placed`` has ``(id, at)``, the names of a document's blocks."""
    def deal(it):
        for batch in slices(it):
            ids, at = batch.column(0).to_numpy(), batch.column(2)
            packed = pa.array([shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            row, names = np.repeat(np.arange(len(ids)), at.value_lengths().to_numpy()), at.flatten().to_numpy()
            for s in range(0, len(row), 500):
                r = row[s : s + 500]
                yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 500]), pa.array(ids[r]), packed.take(pa.array(r))], names=["block", "id", "s"])
        forget_words()

    def confirm(it):
        held: list = []
        out: list = []

        def close():
            ids = np.array([h[1] for h in held])
            a, b = similar_sets([np.frombuffer(h[2], np.uint64) for h in held], percent) if len(held) > 1 else ((), ())
            if len(a):
                root = spanning(len(ids), a, b)
                on = np.unique(np.r_[a, b])
                out.append(np.stack([ids[root[on]], ids[on]], 1))

        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                    held.clear()
                if not held or held[-1] != row:  # repeated rows of one id count once
                    held.append(row)
            if out:
                yield _pairs(np.unique(np.concatenate(out), axis=0))
                out.clear()
        close()
        if out:
            yield _pairs(np.concatenate(out))

    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").cast("binary").alias("t"))
    rows = rows.join(placed.hint("merge"), "id").select("id", "t", "at")
    dealt = rows.mapInArrow(resting(deal), "block long, id long, s binary").repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(resting(confirm), "a long, b long")


def _salted(members: DataFrame, of_groups: DataFrame) -> DataFrame:
    """Members ``(g, id, ...)`` joined to rows of large groups ``(g, ...)``, so that no group is in one task."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    return members.withColumn("salt", salt).join(of_groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"]).drop("salt")


def _shape(of: DataFrame) -> DataFrame:
    """``(key, n, main, m)`` of the runs with members ``(key, id, c)`` of two components or more: their length, largest component and its length."""
    parts = of.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    runs = parts.groupBy("key").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c")).alias("most"))
    return runs.where("parts > 1").select("key", "n", F.col("most.c").alias("main"), F.col("most.m").alias("m"))


def _met_leaders(of: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``(id, c, block)`` of the members ``(key, id, c)`` of runs: each in a block of its own run's, and some, the leaders, in all of them.

    A run of copies of one text becomes one component by that, at a row a member; pairs that meet in no block are left to :func:`_met`.
    ``shape`` is that of :func:`_shape`: from a file, as ``of``, so that AQE can split the join of a hot key.
    """
    shape = _shape(of) if shape is None else shape
    counted = shape.select("key", F.ceil(F.col("n") / LONGEST_RUN).cast("long").alias("blocks"), F.ceil(F.col("n") / LEADERS).cast("long").alias("one_in"))
    leads = F.pmod(F.xxhash64("id", F.lit(11)), F.col("one_in")) == 0
    own = F.array(F.xxhash64("key", _own_block("id", "blocks")))
    at = F.when(leads, F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("key", o))).otherwise(own)
    return of.join(counted, "key").select("id", "c", F.explode(at).alias("block"))


def _met(of: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``(id, c, block)``: any two members ``(key, id, c)`` of a run that are not of one component ``c`` meet in a block.

    Members of a long run's largest component need not meet one another, so they are dealt to pairs with blocks of the others only.
    The join has one row at most of each member of a run, as ``shape`` (see :func:`_met_leaders`) has one row of each run.
    """
    shape = _shape(of) if shape is None else shape
    m = F.when(F.col("n") > LONGEST_RUN, F.col("m")).otherwise(0)
    mains, rest = F.ceil(m / LONGEST_RUN).cast("long"), F.greatest(F.ceil((F.col("n") - m) / LONGEST_RUN), F.lit(1)).cast("long")
    runs = shape.select("key", "main", mains.alias("mains"), rest.alias("rest"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_main = lambda o, k: F.xxhash64(F.col("key"), F.lit("main"), o, k)
    own, all_rest = _own_block("id", "rest"), _all_blocks("key", _own_block("id", "rest"), F.col("rest"))
    at = F.when(F.col("mains") == 0, all_rest).when(
        F.col("c") == F.col("main"), F.transform(upto("rest"), lambda o: with_main(o, _own_block("id", F.greatest("mains", F.lit(1)))))
    ).otherwise(F.concat(F.transform(upto("mains"), lambda k: with_main(own, k)), all_rest))
    return of.join(runs, "key").select("id", "c", F.explode(at).alias("block"))


def _near_pairs(classes: DataFrame, named: DataFrame, part: slice, known: DataFrame | None) -> DataFrame:
    """Trees ``(a, b)`` of the pairs of signatures within ``FARTHEST`` that share a key of a part of the index.

    ``known`` has ``(id, component)`` of what is together already: then runs within one component are left out, and trees join components.
    Without it the members of a long run meet its leaders and their own block only.
    """
    keyed = _keyed(classes, part).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    runs = staged(keyed.mapInArrow(resting(_scan), "kind int, a long, b long"), "runs")
    members = runs.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    twos = runs.where("kind = 0").select("a", "b").distinct().select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("id"))
    members = members.unionByName(twos)
    if known is None:
        of = staged(members.withColumn("c", F.col("id")), "members")
    else:
        of = staged(members.join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "members")
    shape = staged(_shape(of), "shape")
    met = (_met_leaders if known is None else _met)(of, shape)
    rows = met.join(named, "id").select("block", "id", "c", "sig")
    near = staged(rows.repartition("block").sortWithinPartitions("block").mapInArrow(resting(_compare), "a long, b long"), "near")
    for used in (runs, of, shape):
        unstage(used)
    return near


def _leaders(groups: DataFrame, named: DataFrame) -> DataFrame:
    """``(g, leader)``: of each group the member whose signature differs least from the commonest value of each component."""
    rows = groups.join(named, "id").select("g", "id", F.transform(F.sequence(F.lit(1), F.lit(COMPONENTS)), lambda p: F.substring("sig", p, F.lit(1))).alias("c"))
    votes = rows.select("g", F.posexplode("c").alias("p", "x")).groupBy("g", "p", "x").count()
    common = votes.groupBy("g", "p").agg(F.max(F.struct("count", "x"))["x"].alias("x")).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("m"))
    far = F.aggregate(F.zip_with("c", "m", lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    return _salted(rows, common).select("g", "id", far.alias("far")).groupBy("g").agg(F.min(F.struct("far", "id"))["id"].alias("leader"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose ``size``-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of non-blank characters with A-Z lower-cased; whole texts count. Returns a row for each row of ``docs``:
    ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the smallest id reachable over links, itself included. Null and blank texts
    have no shingles and no links. Rows with equal texts are copies; rows that share an id count as one document. A null
    id gives a null component and is not kept. Other columns are ignored; an empty table gives an empty result.
    """
    signed = staged(sign(docs, size, key, text), "signed")
    classes = staged(
        signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "classes"
    )
    named = classes.select("id", F.substring("sig", COMPONENTS * 2 + 1, COMPONENTS).alias("sig"))
    keys = COMPONENTS  # of each chunk one for each component left out
    first = _near_pairs(classes, named, slice(0, keys, keys // FIRST_KEYS), None)
    known = staged(connected_components(first), "known")
    rest = _near_pairs(classes, named, slice(0, keys), known)
    linked = known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest)
    groups = staged(connected_components(linked).select("id", F.col("component").alias("g")), "groups")
    for used in (first, known, rest):
        unstage(used)

    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = staged(_salted(groups, sizes.where(F.col("n") > BLOCK)), "large")
    placed = groups.join(large.select("id"), "id", "left_anti").select("id", F.array(F.xxhash64("g")).alias("at"))
    if not is_empty(large):
        # in blocks of its own members, each with the leader; the leader is in all of them
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        own = _salted(large, _leaders(large.select("g", "id"), named)).select("id", "g", "leader", blocks.alias("blocks"))
        first = F.when(F.col("id") == F.col("leader"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("g", o)))
        led = placed.unionByName(own.select("id", first.otherwise(F.array(F.xxhash64("g", _own_block("id", "blocks")))).alias("at")))
        links = staged(_links(docs, led, size, percent, key, text), "links")
        joined = staged(connected_components(links).withColumnRenamed("component", "c"), "joined")
        # members outside the largest component of their group meet everyone in it
        parts = large.join(joined, "id", "left").select("g", "id", F.coalesce("c", "id").alias("c"))
        most = parts.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("n"))
        parts = _salted(parts, most.where("n > most.m")).select("g", "id", (F.col("c") == F.col("most.c")).alias("main"), F.col("most.m").alias("m"), (F.col("n") - F.col("most.m")).alias("r"))
        mains, rest = (F.greatest(F.ceil(F.col(x) / BLOCK), F.lit(1)).cast("long") for x in ("m", "r"))
        with_main = lambda o, k: F.xxhash64(F.col("g"), F.lit("main"), o, k)
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        parts = parts.select("g", "id", "main", mains.alias("mains"), rest.alias("rest"))
        parts = parts.withColumn("own", F.when(F.col("main"), _own_block("id", "mains")).otherwise(_own_block("id", "rest")))
        at = F.when(F.col("main"), F.transform(upto(F.col("rest")), lambda o: with_main(o, F.col("own")))).otherwise(
            F.concat(F.transform(upto(F.col("mains")), lambda k: with_main(F.col("own"), k)), _all_blocks("g", F.col("own"), F.col("rest")))
        )
        more = staged(_links(docs, parts.select("id", at.alias("at")), size, percent, key, text), "links")
        joined = connected_components(links.union(more))
        unstage(more)
    else:
        links = staged(_links(docs, placed, size, percent, key, text), "links")
        joined = connected_components(links)

    found = classes.select("digest", F.col("id").alias("rep")).join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    found = staged(found.select("digest", F.coalesce("component", "rep").alias("c")), "found")
    for used in (classes, groups, large, links):
        unstage(used)
    out = signed.join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, the smallest id, with all its columns; rows without an id stay.

    Of rows that share the kept id, as one document, the one with the smallest hash of its text, then of its columns, stays, so that a repeated
    task keeps the same. Ids are settled first and written; texts move only where those ids are too many to be sent to each task.
    """
    found = near_duplicates(docs, size, percent)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = staged(ids.where("not kept or n > 1"), "odd-ids")
    alone = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    again = docs.join(odd.where("kept").select("doc_id"), "doc_id").select(docs.columns)
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*plain))).alias("__row"))
    return alone.union(again.select("__row.*"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word shingles; a row for each row (see :func:`near_duplicates`)."""
    tune(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
