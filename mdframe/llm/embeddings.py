"""Near-duplicate embeddings: an exact metric range join over pivot cells.

On unit vectors a cosine of at least ``c`` is a distance of at most ``r = sqrt(2 - 2 c)`` and an angle of at most ``acos(c)``.
Each vector is at home in the cell of its nearest pivot. A neighbour of a vector at home in cell ``p`` is within ``r`` of that
cell's side of the bisector of ``p`` and its own pivot, and by the triangle inequality its angle to ``p`` is at most the cell's
radius plus the range's angle. Each vector is replicated to the cells where both bounds leave room, so that every cell holds all
neighbours of its home vectors and cells join independently, in blocks of bounded size. Counts add up over the home vectors; of
links only spanning trees leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import connected_components, staged, table, tune, unstage
from mdframe.llm.minhash import spanning

#: Vectors from which pivots are chosen; the smallest by a hash of their values.
PIVOT_SAMPLE = 4000
MOST_PIVOTS = 64
VECTORS_A_PIVOT = 3000
#: Home and other rows of a cell that meet in one task.
HOME_BLOCK, OTHER_BLOCK = 2048, 4096
#: Slack for single precision; what falls in it is computed again in double precision.
SLACK = 1e-4


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit vectors of the sample, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    best = sample @ sample[0]
    for _ in range(min(count, len(sample)) - 1):
        k = int(np.argmin(best))
        chosen.append(k)
        best = np.maximum(best, sample @ sample[k])
    return sample[chosen]


def places(unit: np.ndarray, pivots: np.ndarray, cosine: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, pivots and whether at home, of all places of the given unit vectors; ``radius`` is the largest angle at home in each cell."""
    eps = 1e-6
    reach = np.sqrt(2 - 2 * cosine) + eps
    cos = np.clip(unit @ pivots.T, -1, 1)
    home = cos.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
    own = np.take_along_axis(cos, home[:, None], 1)
    furthest = np.cos(np.minimum(np.pi, radius + np.arccos(cosine) + eps))
    near = ((own - cos) <= reach * gap + eps) & (cos >= furthest - eps)
    near[np.arange(len(unit)), home] = True
    row, pivot = np.nonzero(near)
    return row, pivot, pivot == home[row]


def join_block(ids, weights, vectors, left, right, cosine: float):
    """Links between ``left`` rows (at home) and ``right`` rows of a block: weighted counts of left rows, and (id, root) trees."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])  # powers of two: no digit changes, and no product overflows
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    single = unit.astype("f4")
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    sim = single[x] @ single[y].T
    i, j = np.nonzero(sim >= cosine - SLACK)
    i, j = x[i], y[j]
    keep = ids[i] != ids[j]
    i, j = i[keep], j[keep]
    exact = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (np.linalg.norm(vectors, axis=1)[i] * np.linalg.norm(vectors, axis=1)[j])
    i, j = i[exact >= cosine], j[exact >= cosine]
    counts = np.bincount(i, weights[j], len(ids)).astype("i8")
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    first = np.searchsorted(ids[order], ids)  # rows with one id are one vertex
    root = spanning(len(ids), first[i], first[j])
    touched = np.unique(np.r_[first[i], first[j]])
    return counts, ids[order][touched], ids[order][root[touched]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _linked(rows: pa.Table, left: np.ndarray, right: np.ndarray, dim: int, cosine: float) -> pa.Table:
    """Rows ``(id, n, root)`` of what :func:`join_block` finds."""
    ids = rows.column("id").to_numpy()
    counts, linked, roots = join_block(ids, rows.column("w").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim), left, right, cosine)
    some = np.flatnonzero(counts)
    return pa.table({
        "id": pa.array(np.r_[ids[some], linked]), "n": pa.array(np.r_[counts[some], np.zeros(len(linked), "i8")]), "root": pa.array(np.r_[ids[some], roots]),
    })


def _of_dimension(classes: DataFrame, dim: int, cosine: float, kind: str) -> DataFrame:
    """``(id, n, root)`` rows of blocks for the vectors of one dimension; n is null in rows that only give a root."""
    own = classes.where(F.size("v") == dim)
    count = own.count()
    sample = own.orderBy(F.xxhash64("v"), "id").select("v").limit(PIVOT_SAMPLE).collect()
    pivots = choose_pivots(_unit(np.array([r[0] for r in sample], "f8")), int(np.clip(count // VECTORS_A_PIVOT, 4, MOST_PIVOTS)))

    def widths(it):
        for batch in it:
            if len(batch):
                cos = np.clip(_unit(_matrix(batch.column(0), dim)) @ pivots.T, -1, 1)
                cell, angle = cos.argmax(axis=1), np.arccos(cos.max(axis=1))
                cells = np.unique(cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.astype("i8")), pa.array(np.array([angle[cell == c].max() for c in cells])), pa.array(np.bincount(cell)[cells].astype("i8"))],
                    names=["cell", "angle", "h"],
                )

    radius, down, across = np.full(len(pivots), -np.pi), np.zeros(len(pivots), int), np.zeros(len(pivots), int)
    seen = own.select("v").mapInArrow(widths, "cell long, angle double, h long").groupBy("cell").agg(F.max("angle"), F.sum("h"))
    for cell, angle, h in seen.collect():  # at most MOST_PIVOTS rows
        radius[cell], down[cell] = angle, -(-h // HOME_BLOCK)

    def census(it):
        for batch in it:
            if len(batch):
                _, pivot, _ = places(_unit(_matrix(batch.column(0), dim)), pivots, cosine, radius)
                cells, n = np.unique(pivot, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype("i8")), pa.array(n.astype("i8"))], names=["cell", "n"])

    for cell, n in own.select("v").mapInArrow(census, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        across[cell] = -(-n // OTHER_BLOCK)

    def spread(it):
        for batch in it:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            row, cell, home = places(_unit(_matrix(batch.column(2), dim)), pivots, cosine, radius)
            used = down[cell] > 0
            row, cell, home = row[used], cell[used], home[used]
            mixed = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = []
            for is_left in (False, True):
                some = np.flatnonzero(home) if is_left else np.arange(len(row))
                r, c = row[some], cell[some]
                times = across[c] if is_left else down[c]
                own_block = mixed[r].astype(int) % (down[c] if is_left else across[c])
                r2, c2, o2 = np.repeat(r, times), np.repeat(c, times), np.repeat(own_block, times)
                k = np.arange(len(r2)) - np.repeat(np.cumsum(times) - times, times)
                i, j = (o2, k) if is_left else (k, o2)
                out.append((c2, i, j, r2, np.full(len(r2), is_left)))
            c, i, j, r, l = (np.concatenate(x) for x in zip(*out, strict=True))
            for s in range(0, len(c), 20_000):
                t = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[t].astype("i8")), pa.array(i[t].astype("i4")), pa.array(j[t].astype("i4")), pa.array(l[t])]
                    + [batch.column(k).take(pa.array(r[t])) for k in (0, 1, 2)],
                    names=["cell", "i", "j", "at_home", "id", "w", "v"],
                )

    def block(rows: pa.Table) -> pa.Table:
        home = rows.column("at_home").to_numpy().astype(bool)
        return _linked(rows.combine_chunks(), home, ~home, dim, cosine)

    spread_out = own.mapInArrow(spread, f"cell long, i int, j int, at_home boolean, id long, w long, v array<{kind}>")
    return spread_out.groupBy("cell", "i", "j").applyInArrow(block, "id long, n long, root long")


def near_vectors(rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links between all pairs of vectors with a cosine of at least ``cosine`` in double precision, whatever the other columns say.

    Returns a row for each row of ``rows``: ``vec_id, n_links, component_id, kept``. ``n_links`` counts the other rows linked
    directly, equal vectors included; ``component_id`` is the smallest id reachable, itself included. Vectors that are null,
    empty, zero or hold null or non-finite components have no links, and vectors of different lengths have none with one another.
    Rows that repeat an id with an equal vector are linked like other equal rows. A null id is not kept and gives a null component.
    """
    kind = "float" if "float" in dict(rows.dtypes)[vector] else "double"
    values = F.col(vector).cast(f"array<{kind}>")
    rows = rows.select(rows[key].cast("long").alias("id"), rows[vector].alias(vector)).withColumn("v", values)
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.col("id").isNotNull() & sound, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(kind))).alias("v"))
    rows = rows.withColumn("d", F.sha2(F.to_binary(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x))), ""), F.lit("utf-8")), 256))
    given = staged(rows, "vectors")
    classes = staged(given.where("v is not null").groupBy("d").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")), "classes")
    # vectors of lengths that few have are a group each; only the lengths of more vectors than a block holds need pivots
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dims = sorted(r[0] for r in lengths.where(F.col("n") > HOME_BLOCK).collect())
    few = classes.select("id", "w", "v", F.size("v").alias("dim")).join(lengths.where(F.col("n") <= HOME_BLOCK).select("dim"), "dim")

    def whole(rows: pa.Table) -> pa.Table:
        return _linked(rows.combine_chunks(), np.ones(rows.num_rows, bool), np.ones(rows.num_rows, bool), rows.column("dim")[0].as_py(), cosine)

    found = few.select("id", "w", "v", "dim").groupBy("dim").applyInArrow(whole, "id long, n long, root long")
    for dim in dims:
        found = found.union(_of_dimension(classes.select("id", "w", "v"), dim, cosine, kind))
    found = staged(found, "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = staged(
        classes.select("d", "id", "w").join(counts, "id", "left").join(joined, "id", "left")
        .select("d", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "id").alias("c")),
        "known",
    )
    for used in (found, classes):
        unstage(used)
    out = given.select("id", "d").join(known, "d", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors; a row for each row (see :func:`near_vectors`)."""
    tune(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)
