"""A bounded sample of labelled documents, with the statistics of their whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate
from .text_stats import FEATURES, features, statistics


def sample(docs: DataFrame, labels: DataFrame, rows: int, keep: Column | None = None, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of at most ``rows`` labelled documents.

    Label rows are taken in the order of a hash of their id, so the sample does not depend
    on the layout of the files. Null ids and labels other than 0 and 1 are left out; of
    several labels of an id the least counts, and of several documents of an id the one
    whose text has the least hash, so repeated rows change nothing. ``keep`` further
    restricts the ids (an expression over ``doc_id``). The label side of the join has at most
    ``rows`` rows, which bounds the broadcast; statistics are taken only for its documents.
    Empty tables give no rows.
    """
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("__y")).where("doc_id is not null and __y in (0, 1)")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def inputs(batch: pa.Array) -> list[pa.Array]:
        return [pa.array(list(features(statistics(batch))), type=pa.list_(pa.float64()))]

    each = annotate(texts, "text", "__x array<double>", inputs).select("doc_id", "__y", "__x", F.xxhash64("text").alias("__h"))
    got = each.groupBy("doc_id").agg(F.min(F.struct("__h", "__y", "__x")).alias("__one")).select("__one.__x", "__one.__y").orderBy("doc_id").toPandas()
    x = np.array(got["__x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return x, got["__y"].to_numpy(dtype=int)
