"""Shared helpers: tables, shared-folder staging, and distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Give workers this package. Arrow batches are bounded in bytes by Spark itself, so no setting of the session is touched."""
    ship(spark)


def slices(it: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with a bounded number of text bytes (column 1), so that what a task makes of them is bounded too; a longer text is one."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def rest() -> None:
    """Give back to the system what the allocators of this process hold and do not use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def resting(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``: a worker outlives its tasks, and what one has held would count beside the stages after it."""
    def rested(it):
        yield from run(it)
        rest()

    return rested


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master only; on a cluster executors would write to their own disks, so it is an error.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_mdframe_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="mdframe-")
        spark.sparkContext._mdframe_shared = made
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that is removed when the application ends, whatever still reads it until then."""
    path = new_path(spark, label)
    fs, hpath = _file_system(spark, path)
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    :func:`unstage` removes the files as soon as nothing reads them; those that a lazy result reads go when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._mdframe_path = path
    return back


def unstage(df: DataFrame | None) -> None:
    """Remove what :func:`staged` wrote, once nothing reads it any more."""
    path = getattr(df, "_mdframe_path", None)
    if path is not None:
        fs, hpath = _file_system(df.sparkSession, path)
        fs.delete(hpath, True)
        fs.cancelDeleteOnExit(hpath)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has long columns ``a`` and ``b`` (loops and repeats allowed, nulls ignored). Returns one row
    ``(id, component)`` for each vertex on an edge between two different vertices; ``component`` is the smallest
    id in its component. An empty input gives an empty result.

    Contraction: every vertex points to its smallest neighbour, pointers are doubled until they rest on a root, and
    the edges between different roots form the next, at most half as large, graph. Only counts reach the driver;
    each round is written to the shared folder. Both inputs of each join come from files, so AQE can split hubs.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = staged(edges.distinct(), "cc-edges")
    mapping = None
    while not is_empty(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = staged(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("p")),
            "cc-parent",
        )
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp")).where("p != pp")
            if is_empty(up):
                break
            jumped = staged(
                parent.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")),
                "cc-jump",
            )
            moved = not is_empty(jumped.where("moved"))
            unstage(parent)
            parent = jumped.select("id", "p")
            parent._mdframe_path = jumped._mdframe_path
            if not moved:
                break
        if mapping is None:
            mapping = parent
        else:
            new = staged(
                mapping.join(parent.select(F.col("id").alias("p"), F.col("p").alias("q")), "p", "left").select(
                    "id", F.coalesce("q", "p").alias("p")
                ),
                "cc-map",
            )
            unstage(mapping)
            mapping = new
        left = parent.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        contracted = (
            edges.join(left, "a").join(right, "b").where("pa != pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        new_edges = staged(contracted, "cc-edges")
        unstage(edges)
        edges = new_edges
        if mapping is not parent:
            unstage(parent)
    if mapping is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return mapping.select("id", F.col("p").alias("component"))


def local_path(path: str) -> str:
    return path[len("file://"):] if path.startswith("file://") else path
