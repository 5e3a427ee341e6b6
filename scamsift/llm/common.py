"""Helpers that the corpus operators share: lineage cuts, free names, Arrow batches, joins with hot keys, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; keeps a Python worker's memory bounded.
SLICE_BYTES = 1 << 20
#: Sides of joins with up to this many rows of a few numbers each are broadcast.
BROADCAST_ROWS = 100_000
#: A key is hot if it holds more than this share of the rows, so at most 1 / share keys are.
HOT_SHARE = 1 / 1000
#: Graphs of up to this many edges are finished within one task.
TASK_EDGES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. A temporary folder is used only where that is
    unset and everything runs in one process (master ``local`` or ``local[...]``).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scamsift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application, which can be removed when that has ended."""
    return f"{shared_dir(spark)}/scamsift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and the planner sees true sizes."""
    spark = df.sparkSession
    folder = folder or fresh(spark, "cut")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until ``df`` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def text_column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch that hold about ``limit`` bytes of text each, at least one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def annotate(df: DataFrame, text: str, columns: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with more columns that ``fn`` makes from slices of its text column.

    ``columns`` is a DDL list of the new columns; a column of ``df`` of the same name (in
    any case) gives way. One pass over the partitions, no shuffle, rows stay in place.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(columns)
    names = {f.name.lower() for f in added}
    kept = [c for c in df.columns if c.lower() not in names]
    (body,) = free(df, "__text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_column(df, text).alias(body))
    schema = StructType([f for f in source.schema if f.name != body] + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, body):
                at = piece.schema.get_field_index(body)
                own = [piece.column(i) for i in range(piece.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(own + fn(piece.column(at)), names=[*kept, *(f.name for f in added)])

    return source.mapInArrow(run, schema)


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, found without reading more than that."""
    return df.limit(most + 1).count() <= most


def joined(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has at most one row a key and only narrow columns.

    A side of up to ``most`` rows is broadcast. Otherwise rows are shuffled by key, but for
    those of hot keys, which stay in place: there are at most 1 / ``HOT_SHARE`` such keys, so
    their part of the side is broadcast. Both are read several times and should be tables
    that were written. Null keys match nothing; rows with one should be kept apart.
    """
    if small(side, most):
        return rows.join(F.broadcast(side), key, how)
    least = max(most, int(rows.count() * HOT_SHARE))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(key)
    hot = cut(side.join(F.broadcast(cut(hot)), key))
    if hot.isEmpty():
        return rows.join(side, key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task to rows ``node``, ``root``: the least node of the component."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    edges = np.concatenate(held, axis=1)
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(edges.shape)
    up = list(range(len(nodes)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array(up)
    while (root[root] != root).any():
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``: long): rows ``node``, ``root``.

    The root is the smallest node of a component. The graph is contracted at random: in each
    round a node joins the node of the least hash among itself and its neighbours, with a new
    hash each round, and edges are drawn between the joined nodes. Whatever the shape and the
    numbering, a round leaves an expected constant share of the nodes at most, so the rounds
    grow with the logarithm of the nodes; a star takes one. Once ``task_edges`` edges or fewer
    are left one task finishes them, and the rounds are undone. Hubs are pre-aggregated and
    looked up as hot keys; the driver sees counts only. Edges with a null end are ignored.
    """
    spark = edges.sparkSession
    folders: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        folders.append(fresh(spark, "components"))
        return cut(df, folders[-1])

    def proper(a: str, b: str, df: DataFrame) -> DataFrame:
        return written(df.where(f"{a} != {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())

    left = proper("a", "b", edges)
    rounds: list[DataFrame] = []
    while not small(left, task_edges):
        rank = lambda c, seed=len(rounds): F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("node"))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        rounds.append(written(best.select(F.col("a").alias("node"), F.least("best", rank("a"))["node"].alias("rep"))))
        for end, name in (("a", "x"), ("b", "y")):
            left = joined(left, rounds[-1].select(F.col("node").alias(end), F.col("rep").alias(name)), end)
        left = proper("x", "y", left)
    label = left.coalesce(1).mapInArrow(_united, "node bigint, root bigint")
    for found in reversed(rounds):
        label = joined(found, written(label.select(F.col("node").alias("rep"), "root")), "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    if rounds:
        label = written(label)
        label = joined(label, written(label.groupBy("root").agg(F.min("node").alias("least"))), "root").select("node", F.col("least").alias("root"))
    label = cut(label)
    remove(spark, *folders)
    return label
