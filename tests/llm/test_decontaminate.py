import itertools
import random

import duckdb
import pytest

from mdframe.llm import decontaminate
from mdframe.llm.decontaminate import OP6_SQL, contamination, keep_uncontaminated

from .conftest import prose


def cases(spark):
    rng, rows = random.Random(4), []
    items = [(i, prose(100 + i, 20 + i, 5000)) for i in range(8)] + [(8, "short item of six words only"), (9, None), (10, ""), (0, prose(100, 20, 5000)), (None, prose(7, 30))]
    for i in range(120):
        words = prose(i, rng.randrange(3, 90), 5000).split()
        if i % 3 == 0:
            passage = (items[i % 8][1]).split()
            passage = passage[rng.randrange(3) : len(passage) - rng.randrange(4)]
            for _ in range(i % 5):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage]
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:2]], "doc_id long, text string, seed string, item_id int"), spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_CHARS, 600])
def test_equals_sql(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", most)
    docs, items = cases(spark)
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    c.register("benchmark", items.select("item_id", "text").where("item_id is not null").toPandas().astype({"item_id": "int64"}))
    got = sorted(map(tuple, contamination(docs, items).distinct().collect()), key=str)
    want = sorted({tuple(r) for r in c.sql(OP6_SQL).fetchall()}, key=str)
    assert got == want and 20 < sum(r[1] for r in got) < 60


def test_odd_documents(spark, odd, empty):
    docs, items = cases(spark)
    got = contamination(odd, items).collect()
    assert len(got) == odd.count() and not any(r["contaminated"] for r in got)
    assert contamination(empty, items).collect() == [] and contamination(odd, items.limit(0)).where("contaminated").count() == 0
    kept = keep_uncontaminated(odd, odd.selectExpr("4 as item_id", "text").where("doc_id = 4"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and 4 not in ids and 5 not in ids and None in ids and 3 in ids


def test_plan_is_native(spark):
    docs, items = cases(spark)
    assert "Python" not in contamination(docs, items)._jdf.queryExecution().toString()


def windows(doc, item):
    """Most equal words of a window with 80 % equal at any distance, without seeds; None where there is none."""
    size, best = min(12, len(item)), None
    for d in range(-len(item), len(doc) + 1) if size else ():
        same = [0 <= i + d < len(doc) and item[i] == doc[i + d] for i in range(len(item))]
        for s in range(len(item) - size + 1):
            n = sum(same[s : s + size])
            best = n if n * 100 >= size * 80 and n > (best or 0) else best
    return best


def test_every_substitution_is_found(spark):
    rng, items, docs = random.Random(6), [(0, [])], []
    for n in range(1, 15):
        items.append((n, [f"i{n}x{k}" for k in range(n)]))
        for times in range(n - -(-n * 80 // 100) + 2 if n < 13 else 3):
            docs += [[f"gone{k}" if k in places else w for k, w in enumerate(items[-1][1])] for places in itertools.combinations(range(n), times)]
    docs = [[f"p{k}" for k in range(i % 3)] + d[: len(d) - (i % 5 == 1)] + [f"q{k}" for k in range(rng.randrange(3))] for i, d in enumerate(docs)]
    docs += [items[9][1][1:] + ["q"], items[12][1][2:], items[6][1][1:], items[5][1][:-1], []]
    want = sorted((i, n, same) for i, d in enumerate(docs) for n, item in items if (same := windows(d, item)))
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = decontaminate.overlaps(frame, spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 250
