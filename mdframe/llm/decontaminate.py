"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Each mask reads some of a few successive words and ignores the others; the words read are hashed. Equal hashes in a
document and a benchmark item give a hit, whatever stands in the ignored places. Around each hit the two texts are laid side
by side, and windows that hold the hit are compared word by word: enough equal words in one window make an overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import staged, table

#: Places that each mask reads. Every window of 7 to ``WINDOW`` words with ``SHARE`` percent equal holds one of these unchanged.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 3, 5), (0, 1, 2, 5, 6), (0, 2, 3, 4, 5))
#: The same for whole items of fewer words: up to 4 are equal in full, one word of 5 or 6 may differ.
SHORT_MASKS = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)),
    6: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5)),
}
WINDOW = 12
SHARE = 80
#: Benchmark characters whose seeds are broadcast at once, about a row each; a larger benchmark takes as many passes as it needs.
BROADCAST_CHARS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(size: int) -> tuple:
    """Masks of items of ``size`` words; none for an item without words."""
    return SHORT_MASKS.get(size, ()) if size < 7 else MASKS


def _seeded(rows: DataFrame, key: str, text: str, names: tuple[str, str, str], masks: list, own: bool = False) -> DataFrame:
    """A row for each seed: ``key``, word hashes, position, seed and the words that its mask spans; with ``own``, only of masks for texts of that size.

    Words are exploded first and seeds are made of array reads beside each position, so that hashing and the probe of the
    index run in one generated loop. The explodes are outer: else Catalyst computes their inputs again in a filter below.
    A seed is null where a place that its mask reads is beyond the text; its unread places may be.
    """
    words, pos, seed = names
    rows = rows.select(key, word_hashes(F.col(text)).alias(words)).select(key, words, F.posexplode_outer(words).alias(pos, "__w"))
    made = []
    for mask in masks:
        fits = F.col(pos) + mask[-1] < F.size(words)
        if own:
            sizes = [n for n in range(1, 8) if mask in masks_of(n)]
            fits &= F.least(F.size(words), F.lit(7)).isin(*sizes)
        hashed = F.when(fits, F.xxhash64(F.lit(repr(mask)), *[F.get(F.col(words), F.col(pos) + o) for o in mask]))
        made.append(F.struct(hashed.alias("s"), F.lit(mask[-1] + 1).alias("span")) if own else hashed)
    rows = rows.select(key, words, pos, F.explode_outer(F.array(*made)).alias(seed))
    if own:
        rows = rows.select(key, words, pos, F.col(seed)["s"].alias(seed), F.col(seed)["span"].alias("span"))
    return rows.where(F.col(seed).isNotNull())


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, same)`` for each document and item with an overlap; ``same`` is the largest number of equal words in a window.

    A window is ``WINDOW`` words of the item, or the whole of a shorter item, with at least ``SHARE`` percent of its words equal to the document's
    at the same distance; words beyond the document differ. Null texts count as empty; rows with a null id are left out.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__t")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("__t")).where("item_id is not null").distinct()
    chars, sizes = items.agg(F.sum(F.length("__t")), F.collect_set(F.least(F.size(word_hashes(F.col("__t"))), F.lit(7)))).first()
    chars, masks = chars or 0, sorted({m for n in sizes for m in masks_of(n)}) or list(MASKS)
    theirs = _seeded(items, "item_id", "__t", ("iw", "ip", "seed"), masks, own=True)
    ours = _seeded(docs, "doc_id", "__t", ("dw", "dp", "seed"), masks)
    index = theirs.select("item_id", "ip", "seed", "span", F.size("iw").alias("n"), F.xxhash64("iw").alias("iv")).distinct()
    passes, hits = max(1, -(-chars // BROADCAST_CHARS)), None
    start = F.greatest(F.col("dp") - WINDOW + 1, F.lit(0))
    for k in range(passes):
        part = index.where(F.pmod("seed", F.lit(passes)) == k) if passes > 1 else index
        # of the document only the words that a window around the hit can hold go on
        met = ours.join(F.broadcast(part), "seed").select("doc_id", "item_id", "iv", "ip", "span", "n", "dp", start.alias("from"), F.slice("dw", start + 1, F.col("dp") + WINDOW - start).alias("dw"))
        hits = met if hits is None else hits.union(met)
    words = items.select("item_id", word_hashes(F.col("__t")).alias("iw")).distinct().withColumn("iv", F.xxhash64("iw"))
    hits = hits.join(F.broadcast(words) if chars <= BROADCAST_CHARS else words, ["item_id", "iv"])

    size = F.least(F.lit(WINDOW), F.col("n"))
    first = F.greatest(F.lit(0), F.col("ip") + F.col("span") - size)
    last = F.least(F.col("ip"), F.col("n") - size)
    hits = hits.withColumn("size", size).withColumn("first", first).withColumn("last", last)
    place = lambda i: i + F.col("dp") - F.col("ip") - F.col("from")
    equal = F.transform(
        F.sequence(F.col("first"), F.col("last") + F.col("size") - 1),
        lambda i: F.when(F.get(F.col("iw"), i) == F.when(place(i) >= 0, F.get(F.col("dw"), place(i))), 1).otherwise(0),
    )
    hits = hits.select("doc_id", "item_id", "size", (F.col("last") - F.col("first")).alias("shifts"), equal.alias("e"))
    best = F.array_max(
        F.transform(F.sequence(F.lit(1), F.col("shifts") + 1), lambda s: F.aggregate(F.slice("e", s, F.col("size")), F.lit(0), lambda a, x: a + x))
    )
    found = hits.select("doc_id", "item_id", "size", best.alias("same")).groupBy("doc_id", "item_id", "size").agg(F.max("same").alias("same"))
    found = found.where(F.col("same") * 100 >= F.col("size") * SHARE)
    return found.groupBy("doc_id", "item_id").agg(F.max("same").alias("same"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, contaminated, n_items, first_item, same`` from :func:`overlaps`.

    ``first_item`` is the smallest item id, ``same`` the largest number of equal words; null and 0 without an overlap. Rows that share
    an id share their result. Empty tables give no contamination.
    """
    found = overlaps(docs, items, key, text).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("same").alias("m")
    )
    out = docs.select(F.col(key).cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select(
        F.col("doc_id").alias(key), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        "first_item", F.coalesce("m", F.lit(0)).cast("int").alias("same"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns; rows with a null id stay.

    The ids found are written first, so that texts move only where those are too many to be sent to each task.
    """
    found = staged(overlaps(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all items; a row for each row (see :func:`contamination`)."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All alignments of a document and an item that share a word, without seeds.
OP6_SQL = r"""
WITH d0 AS (SELECT DISTINCT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
i0 AS (SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, d, unnest(w) AS x, unnest(range(len(w))) AS p FROM (SELECT *, row_number() OVER () AS d FROM d0)),
iw AS (SELECT item_id, i, unnest(w) AS x, unnest(range(len(w))) AS q, len(w) AS n, least(12, len(w)) AS size FROM (SELECT *, row_number() OVER () AS i FROM i0)),
e AS (SELECT doc_id, d, item_id, i, p - q AS away, q, n, size FROM dw JOIN iw USING (x)),
a AS (SELECT d, i, away FROM e GROUP BY d, i, away, size HAVING count(*) * 100 >= size * 80),
c AS (
  SELECT doc_id, item_id, size, greatest(count(*) OVER (PARTITION BY d, i, away ORDER BY q RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING),
         count(*) FILTER (q >= n - size) OVER (PARTITION BY d, i, away)) AS same
  FROM e SEMI JOIN a USING (d, i, away)),
f AS (SELECT doc_id, item_id, max(same) AS same FROM c WHERE same * 100 >= size * 80 GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, min(item_id) AS first_item, max(same) AS same FROM f GROUP BY 1)
SELECT d.doc_id, g.n IS NOT NULL AS contaminated, coalesce(g.n, 0)::BIGINT AS n_items, g.first_item, coalesce(g.same, 0)::INTEGER AS same
FROM documents d LEFT JOIN g USING (doc_id)
"""
