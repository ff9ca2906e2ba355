"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold that is never learned from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_ids(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """At most ``most`` ``(doc_id, y)`` rows outside the fold, the first by a hash of the id: the bound is on what a model learns from.

    Repeated ids count once, with their largest label; null ids and labels are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, fold))
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_rows(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """One row of ``docs`` for each sampled id, with ``y``: of rows that share an id the one with the smallest hash of its text.

    The ids are bounded by the sample, hence the broadcast.
    """
    own = [c for c in docs.columns if c != "doc_id"]
    met = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*own, "y"), F.xxhash64(text)).alias("__row"))
    return met.select("doc_id", "__row.*")
