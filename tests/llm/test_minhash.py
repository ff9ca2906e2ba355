import itertools
import random

import numpy as np
import pyarrow as pa

from mdframe.llm import minhash
from mdframe.llm.common import connected_components
from mdframe.llm.minhash import index_keys, keep_one, near_duplicates, shingle_set, signatures, similar_sets


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(set(shingle_set((text or "").encode(), size).tolist()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def check(frame, size=4, percent=80):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    want = brute(rows, size, percent)
    got = near_duplicates(frame, size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is not None and r["component_id"] == r["doc_id"])
    return got


def test_shingles():
    assert len(shingle_set(b"a b c d e", 4)) == 2 and len(shingle_set(b"a b", 4)) == 1 and len(shingle_set(b" \x0b\x1f", 4)) == 1 and len(shingle_set(b"\x0b \t", 4)) == 0
    assert (shingle_set(b"A b C d", 4) == shingle_set(b"a B c D", 4)).all() and len(shingle_set("É é".encode(), 4)) == 1
    assert len(shingle_set(None, 4)) == 0 and len(np.intersect1d(shingle_set(b"a b", 4), shingle_set(b"b a", 4))) == 0


def test_odd_documents(odd, empty):
    got = {(r["doc_id"], r["n_shingles"]) for r in check(odd)}
    assert (1, 0) in got and (2, 0) in got and (6, 1) in got
    assert near_duplicates(empty).collect() == []
    kept = keep_one(odd, 4)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 7 not in ids and None in ids and {1, 2, 3, 6, 8, 11} <= set(ids)


def test_random_families(spark, monkeypatch):
    """Dense families about the threshold, chains, exact copies; blocks and runs so small that members meet in pairs of blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LONGEST_RUN", 8)
    rng, rows = random.Random(5), []
    for family in range(6):
        words = [f"f{family}w{rng.randrange(300)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(40):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    check(spark.createDataFrame(rows[:80], "doc_id long, text string"), size=5)


def test_hot_keys_of_unrelated_texts(spark, monkeypatch):
    """A passage in all texts gives long runs of texts that are not alike; pairs hidden in them are still found, in any order of ids."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LONGEST_RUN", 8)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"k{k}w{j}" for j in range(rng.choice([3, 12, 25, 60]))]
        rows.append(" ".join(passage + own))
        if k % 10 == 0:
            rows.append(" ".join([*passage, *own, "tail"]))
    rng.shuffle(rows)
    got = check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6))
    assert len({r["component_id"] for r in got}) > 60


def test_scan_loses_no_pair(monkeypatch):
    """Runs cut by batches and borders of partitions, and runs longer than a task holds."""
    monkeypatch.setattr(minhash, "HELD_ROWS", 7)
    rng = random.Random(2)
    for _ in range(150):
        rows = sorted({(rng.choice([1, 2, 3, rng.randrange(40)]), rng.randrange(60)) for _ in range(rng.randrange(1, 60))})
        borders = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(5)))
        pairs, members = set(), {}
        for lo, hi in zip([0, *borders], [*borders, len(rows)], strict=True):
            part, batches = rows[lo:hi], []
            while part:
                n = rng.randrange(0, 6)
                batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in part[:n]], pa.int64()) for c in (0, 1)], names=["key", "id"]))
                part = part[n:]
            for batch in minhash._scan(iter(batches)):
                for kind, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind:
                        members.setdefault(a, set()).add(b)
                    else:
                        pairs.add((a, b))
        pairs |= {p for ids in members.values() for p in itertools.combinations(sorted(ids), 2)}
        assert pairs == {(a, b) for k, a in rows for q, b in rows if k == q and a < b}


def test_one_row_of_repeated_ids(spark):
    rows = [(1, f"text {k} of one id", k) for k in (3, 1, 2, 1)] + [(2, "another text here", 5), (None, "a", 1), (None, "a", 1)]
    kept = [sorted(map(tuple, keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(n)).collect()), key=str) for n in (1, 3)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2, None, None]


def test_index_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 65536, (1, minhash.COMPONENTS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(minhash.COMPONENTS, minhash.RADIUS, replace=False)] += 1
        assert np.intersect1d(index_keys(a), index_keys(b)).size
    sets = [np.unique(rng.integers(0, 2**62, 50).astype(np.uint64)) for _ in range(3)]
    assert (signatures(sets)[1] == signatures(sets[1:2])[0]).all()


def test_similar_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    a, b = similar_sets(sets, 50)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_runs_of_copies_are_dealt_once(spark, monkeypatch):
    """Of two runs with one large component, one without and a short one, all pairs that are not joined meet; copies do not multiply."""
    monkeypatch.setattr(minhash, "LONGEST_RUN", 8)
    of = [(1, i, 0 if i < 190 else i) for i in range(200)] + [(2, i, i) for i in range(30)] + [(3, 1, 1), (3, 2, 2), (4, 5, 0), (4, 6, 0)]
    frame = spark.createDataFrame(of, "key long, id long, c long")
    blocks = {}
    for r in minhash._met(frame).collect():
        blocks.setdefault(r["block"], set()).add((r["id"], r["c"]))
    met = {p for b in blocks.values() for p in itertools.combinations(sorted(b), 2) if p[0][1] != p[1][1]}
    assert met >= {((i, c), (j, d)) for k, i, c in of for q, j, d in of if k == q and i < j and c != d}
    assert minhash._met(frame.where("key = 1")).count() < 2 * 190 + 10 * 30  # in pairs of blocks it would be 200 * 25
    first = minhash._met_leaders(frame.where("key = 1")).collect()
    assert {r["id"] for r in first} == set(range(200)) and len(first) < 200 + 25 * 40


def rows_joined(plan):
    """Rows that the joins of a finished plan have made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_joined(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return rows_joined(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(rows_joined(children.apply(k)) for k in range(children.size()))


def test_members_of_long_runs_are_joined_once(spark, monkeypatch):
    """A run twice as long, with one main component and some other members, makes twice the rows: one for each member."""
    monkeypatch.setattr(minhash, "LONGEST_RUN", 8)
    for n in (200, 400):
        of = [(1, i, 0 if i < n - 10 else i) for i in range(n)] + [(2, i, i) for i in range(5)] + [(3, i, 0) for i in range(50)]
        met = minhash._met(spark.createDataFrame(of, "key long, id long, c long"))
        assert {r["id"] for r in met.collect()} == set(range(n))
        assert rows_joined(met._jdf.queryExecution().executedPlan()) == n + 5
