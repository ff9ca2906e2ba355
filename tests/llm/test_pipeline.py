import os
import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from mdframe.llm import minhash
from mdframe.llm.bpe import encoder
from mdframe.llm.common import table
from mdframe.llm.decontaminate import OP6_SQL
from mdframe.llm.quality import fit_quality, rule_matrix
from mdframe.llm.toxicity import fit_toxicity

from .test_classifiers import plain_statistics
from .test_minhash import brute, rows_joined

DATA = "/root/testdata/sf0.01"


def folder_of(spark, path, docs, items, labels):
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_documents(spark, odd, tmp_path):
    folder = folder_of(spark, tmp_path, odd, [(1, odd.where("doc_id = 11").first()["text"])], [])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns
    ids = sorted(r[0] or 0 for r in docs.select("doc_id").collect())
    assert 11 not in ids and ids.count(4) == 1 and 5 not in ids and {0, 1, 2, 3, 6, 8, 12, 13} <= set(ids)
    out = corpus_pipeline.tokens(spark, docs, folder)
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and sorted(r[0] or 0 for r in out.select("doc_id").collect()) == ids


def test_empty_documents(spark, empty, tmp_path):
    folder = folder_of(spark, tmp_path, empty, [], [(1, 0, 1), (2, 1, 0)])
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_near_duplicates_join_members_of_runs_once(spark, monkeypatch):
    """Texts that share a passage give long runs; each of their members is joined once, and all links are found."""
    monkeypatch.setattr(minhash, "LONGEST_RUN", 8)
    seen, met = [], minhash._met

    def counted(of, *more):
        out = met(of, *more)
        out.collect()
        seen.append((rows_joined(out._jdf.queryExecution().executedPlan()), of.count()))
        return out

    monkeypatch.setattr(minhash, "_met", counted)
    rng = random.Random(4)
    rows = []
    for k in range(60):
        own = [f"k{k}w{j}" for j in range(rng.choice([3, 12, 25]))]
        rows += [" ".join([*(f"p{j}" for j in range(60)), *own, *tail]) for tail in ([], ["tail"])[: 1 + (k % 5 == 0)]]
    rows = list(enumerate(rows))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, c in brute(rows, 5, 80).items() if i == c)
    assert len(seen) == 1 and 0 < seen[0][0] <= seen[0][1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_each_stage_equals_brute_force(spark):
    """Every stage drops rows of its own, and just those that a plain version of it drops; the run ends with what is left."""
    docs = table(spark, DATA, "documents").cache()
    labels = table(spark, DATA, "labels")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())

    def settled(name, before):
        path = f"{spark.sparkContext._mdframe_shared}/test-{name}-{os.getpid()}" if hasattr(spark.sparkContext, "_mdframe_shared") else f"/tmp/test-{name}-{os.getpid()}"
        stages[name](spark, before, DATA).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and 0 < after.count() < before.count(), name
        return after

    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = fit_quality(docs, labels)
    x = np.array([list(plain_statistics(t).values()) for t in rows.values()])
    z = rule_matrix(x, [r for r, _ in model.rules]) @ np.array([w for _, w in model.rules]) + model.intercept
    good = settled("quality", docs)
    assert ids(good) == sorted(i for i, s in zip(rows, 1 / (1 + np.exp(-z)), strict=True) if s >= 0.3)

    grammar = fit_toxicity(good, labels)
    clean = settled("toxicity", good)
    assert ids(clean) == [i for i in ids(good) if grammar.score(rows[i]) < 0.3]

    alone = settled("near_duplicates", clean)
    component = brute([(i, rows[i]) for i in ids(clean)], 5, 80)
    assert ids(alone) == sorted(i for i, c in component.items() if i == c)

    c = duckdb.connect()
    c.register("documents", alone.select("doc_id", "text").toPandas())
    c.execute(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    left = settled("decontamination", alone)
    assert ids(left) == sorted(r[0] for r in c.sql(f"select doc_id from ({OP6_SQL}) where not contaminated").fetchall())

    enc = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=encoder().ranks, special_tokens={})
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert out == {i: enc.encode_ordinary(rows[i]) for i in ids(left)}
