"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

The rows of each partition are counted, and how many of them go to each shard is drawn
from the multivariate hypergeometric distribution, so that the row sums are the
partitions' counts and the column sums the shards' sizes. Every partition is permuted and
cut at the drawn counts; the pieces are exchanged; every shard is permuted again. Each
arrangement of rows over places is then equally likely, and shard sizes differ by one row
at most. Whole rows move, once; permuting and cutting a partition is dealing its rows the
permuted labels of their shards, so it needs their positions only. The driver holds the
matrix, whose size is bounded by ``parts`` times ``shards``, and a count for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import free, fresh, remove


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: partitions with these counts; columns: shards whose sizes differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), dtype=np.int64)
    left = total
    for i, n in enumerate(counts):
        rest, rest_left = n, left
        for j in range(shards - 1):
            x = 0
            if rest and room[j]:
                x = int(_draw(rng, int(room[j]), rest_left - int(room[j]), rest))
            rest_left -= int(room[j])
            out[i, j] = x
            rest -= x
        out[i, shards - 1] = rest
        room -= out[i]
        left -= n
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw for populations of any size.

    numpy takes up to 10**9. Beyond, binomial proposals are accepted in proportion to the
    ratio of the two probabilities, relative to its maximum; it is a product of one factor
    for each step between the proposal and the place of the maximum.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > good + bad:
        return good - _draw(rng, good, bad, good + bad - n)
    top = int(np.clip(round((n * good - good) / (good + bad)), 0, min(n, good)))

    def log_step(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log((good - x) / good) - np.log((bad - n + x + 1) / bad)

    while top < min(n, good) and log_step(np.array([float(top)]))[0] > 0:
        top += 1
    while top > 0 and log_step(np.array([float(top - 1)]))[0] < 0:
        top -= 1
    while True:
        x = int(rng.binomial(n, good / (good + bad)))
        if x > good or n - x > bad:
            continue
        steps = log_step(np.arange(min(x, top), max(x, top), dtype=float)).sum()
        if np.log(rng.random()) <= (steps if x > top else -steps):
            return x


def shuffle_documents(docs: DataFrame, shards: int = 40, seed: int = 42, parts: int = 4096, lanes: int | None = None, folder: str | None = None) -> DataFrame:
    """Whole rows of ``docs`` dealt to ``shards`` and written: all columns, ``shard`` (int) and ``slot`` (long).

    Each shard is a Parquet folder ``shard=N`` in ``folder`` (None: a new one in the shared
    folder); the rows read back from there are returned. ``slot`` runs from 0 without gaps in
    each shard. A shard's second permutation runs in ``lanes`` pieces, so that no task holds a
    whole shard (None: one for 250 000 rows, 64 at least and 4096 at most). Null and repeated ids are rows like any other. Columns of the names
    ``shard`` and ``slot`` are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    places, second, lanes_, rank, ahead = free(docs, "__place", "__second", "__lane", "__rank", "__before")
    base = fresh(spark, "sharding")
    # Rows, places and draws are written to the shared folder once, so a task that runs again reads the same ones.
    place = F.monotonically_increasing_id()
    docs.select(*[F.col(f"`{c}`") for c in names], place.alias(places), F.rand(seed).alias(second)).write.option("compression", "zstd").parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    source = F.shiftright(places, 33).cast("int")
    held = rows.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    counts = [0] * parts
    start: dict[int, int] = {}  # where a partition's rows begin among those that share its row of the matrix
    for r in held:
        start[r["source"]] = counts[r["source"] % parts]
        counts[r["source"] % parts] += r["n"]
    lanes = lanes or int(np.clip(sum(counts) // (250_000 * shards), 64, 4096))
    live = [p for p in range(parts) if counts[p]]
    drawn = dict(zip(live, matrix([counts[p] for p in live], shards, seed), strict=True))

    @F.pandas_udf("int")
    def dealt(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[int, np.ndarray] = {}
        for batch in places:
            at = batch.to_numpy()
            out = np.empty(len(at), dtype=np.int32)
            own = at >> 33
            for p in np.unique(own).tolist():
                k = p % parts
                if k not in kept:
                    kept.clear()
                    kept[k] = np.random.default_rng([seed, k]).permutation(np.repeat(np.arange(shards, dtype=np.int16), drawn[k]))
                mine = own == p
                out[mine] = kept[k][start[p] + (at[mine] & ((1 << 33) - 1))]
            yield pd.Series(out)

    sent = rows.withColumn("shard", dealt(places)).withColumn(lanes_, F.floor(F.col(second) * lanes).cast("int"))
    lane = sent.groupBy("shard", lanes_).agg(F.count(F.lit(1)).alias("n"))
    before = lane.withColumn(ahead, F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy(lanes_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = sent.withColumn(rank, F.row_number().over(W.partitionBy("shard", lanes_).orderBy(second, places)) - 1)
    placed = within.join(F.broadcast(before), ["shard", lanes_])  # at most shards * lanes rows
    folder = folder or f"{base}/shards"
    done = placed.select(*[F.col(f"`{c}`") for c in names], (F.col(ahead) + F.col(rank)).cast("long").alias("slot"), "shard")
    done.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    remove(spark, f"{base}/rows")
    schema = T.StructType([*(f for f in docs.schema if f.name in names), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def shuffle_rows(docs: DataFrame, shards: int = 40, seed: int = 42, key: str = "doc_id", text: str = "text", parts: int = 4096, lanes: int | None = None) -> DataFrame:
    """Rows ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, read off the shards of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16; the crc32 of a null text is
    that of the empty text. The law is ``rows``: each row is placed on its own, copies of a
    text too, and counts of shards differ by one at most. ``grown_shard`` is null, as it
    belongs to the law ``key``. An empty table gives no rows.
    """
    placed = shuffle_documents(docs, shards, seed, parts, lanes)
    body = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    size = (F.octet_length(body).cast("long") + 16).alias("size")
    return placed.select(F.col(f"`{key}`").alias("doc_id"), size, F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
