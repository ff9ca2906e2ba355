import numpy as np

from mdframe.llm import embeddings
from mdframe.llm.embeddings import near_vectors


def brute(rows, cosine):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {k: 0 for k in range(len(ok))}, {i: i for i, _ in ok}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = find(ok[a][0]), find(ok[b][0])
                parent[max(p, q)] = min(p, q)
    return {ok[k][0]: n for k, n in links.items()}, {i: find(i) for i in parent}


def check(spark, rows, kind="float"):
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, w int, v string")
    if kind == "float":
        rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    links, component = brute(rows, 0.95)
    got = near_vectors(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_links"] == links.get(r["vec_id"], 0) and r["component_id"] == component.get(r["vec_id"], r["vec_id"])
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])


def test_random_clusters(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOME_BLOCK", 16)
    monkeypatch.setattr(embeddings, "OTHER_BLOCK", 24)
    monkeypatch.setattr(embeddings, "VECTORS_A_PIVOT", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = []
    for c in centres:
        for s in (0.05, 0.12, 0.2):
            rows += [(c + rng.normal(scale=s, size=8)).tolist() for _ in range(8)]
    rows += rng.normal(size=(60, 8)).tolist() + [rows[0], rows[0], (np.array(rows[1]) * 3).tolist()]
    check(spark, list(enumerate(rows)))
    check(spark, list(enumerate(rows[:60])), "double")


def test_many_lengths(spark):
    """Lengths that few vectors have go through no pivots, whatever their number."""
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=1 + k % 40).tolist() for k in range(160)]
    rows += [(np.array(r) * (1 + rng.normal(scale=0.05, size=len(r)))).tolist() for r in rows[:60]]
    check(spark, list(enumerate(rows)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0]), (11, [1.0, 2.0, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (None, [1.0, 2.0])]
    check(spark, rows)
    assert [r["n_links"] for r in near_vectors(spark.createDataFrame([(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-300, 2e-300])], "vec_id long, embedding array<double>")).collect()] == [2, 2, 2]
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(frame).collect() == []
