"""Embedding near-dedup: an exact metric range join.

Pivots cut the unit sphere into cells; a cell with too many vectors is cut again by pivots
of its own, so the cells are the leaves of a tree. A vector's home is the leaf that it
reaches by its nearest pivots. By the triangle inequality a partner within distance r lies
in the cell of pivot j only if the vector is within r of the bisector of j and every other
pivot beside it; the vector visits exactly those cells. Of two cells only the one that comes
later sends visitors to the other, so a pair is found once, in the home of one of the two.
Cells then join independently: home vectors in memory, visitors streamed past them.

Leaves have a bounded number of home vectors, however dense a region is: vectors of one and
the same direction, which no pivot can part, are dealt out by a hash and visit each other.
Where distances are so much alike that bisectors exclude nothing, every exact join compares
all cells; visits then grow with the square of the vectors over the size of a leaf.

Equal vectors are one class, joined once. A task adds up links and keeps a forest of them,
so pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, joined
from .simhash import _Forest

SLACK = 1e-9  # widens visits, never the comparison
#: Cells that a node of the tree has at most.
FAN = 64
#: Bytes of all pivots together; cells beyond that are dealt out by a hash.
TREE_BYTES = 32 << 20


@dataclass
class Node:
    """A cut of a cell: ``pivots`` of its children, or none if a hash deals the vectors out; a child is a node or a leaf's number."""

    pivots: np.ndarray | None
    children: list
    gaps: np.ndarray | None = field(default=None)

    def __post_init__(self) -> None:
        if self.pivots is not None:
            self.gaps = np.stack([np.linalg.norm(self.pivots - p, axis=1) for p in self.pivots])


def _dealt(ids: np.ndarray, depth: int, n: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(depth + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) % np.uint64(n)).astype(np.int64)


def place(tree: Node | int, unit: np.ndarray, ids: np.ndarray, reach: float, visits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, row, whether the leaf is the row's home) for every leaf that a row's vector belongs to or, if asked, visits."""
    leaves, rows, homes = [], [], []

    def go(node: Node | int, at: np.ndarray, home: np.ndarray, depth: int) -> None:
        if not len(at):
            return
        if not isinstance(node, Node):
            leaves.append(np.full(len(at), node, dtype=np.int64))
            rows.append(at)
            homes.append(home)
            return
        n = len(node.children)
        if node.pivots is None:
            own, open_ = _dealt(ids[at], depth, n), np.ones((len(at), n), dtype=bool)
        else:
            near = unit[at] @ node.pivots.T
            own = near.argmax(axis=1)
            if visits:
                # How far the vector is on the wrong side of the bisector of j and i: the gap of its cosines over the pivots' distance.
                open_ = np.stack([(near - near[:, [j]] <= reach * node.gaps[j] + SLACK).all(axis=1) for j in range(n)], axis=1)
        for j, child in enumerate(node.children):
            mine = home & (own == j)
            take = mine | (open_[:, j] & (~home | (own > j))) if visits else mine
            go(child, at[take], mine[take], depth + 1)

    go(tree, np.arange(len(unit)), np.ones(len(unit), dtype=bool), 0)
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(leaves), np.concatenate(rows), np.concatenate(homes)


def _unit(lists: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one width."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def grow(found: DataFrame, total: int, width: int, leaf: int, kind: str) -> tuple[Node | int, int]:
    """A tree whose leaves have about ``leaf`` home vectors and at most four times as many, and the number of leaves.

    A cell's pivots are vectors of its own, taken by a hash of their class: as many as its
    size asks for, so that dense regions get more. A few such samples come to the driver,
    and at most ``TREE_BYTES`` of pivots are kept; cells that these don't reach, the smallest
    ones, are dealt out by a hash like vectors of one direction.
    """
    room = TREE_BYTES // (8 * width)
    tree: Node | int = 0
    sizes, n_leaves = {0: total}, 1
    for depth in range(64):
        large = {k: n for k, n in sizes.items() if n > (2 if depth == 0 else 4) * leaf}
        if not large:
            break
        want = {k: int(np.clip(-(-n // leaf), 2, FAN)) for k, n in large.items()}
        share = {}
        for k in sorted(large, key=lambda k: (-large[k], k)):
            if room >= want[k]:
                room -= want[k]
                share[k] = (1.5 * want[k] + 8) / large[k]

        def pick(batches: Iterator[pa.RecordBatch], tree=tree, share=share, depth=depth) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    ids = batch.column(0).to_numpy()
                    home, row, _ = place(tree, _unit(batch.column(1)), ids, 0.0, visits=False)
                    lucky = _dealt(ids[row], 1000 + depth, 1 << 30) < np.array([share.get(k, 0.0) for k in home.tolist()]) * (1 << 30)
                    yield pa.RecordBatch.from_arrays([pa.array(home[lucky]), pa.array(ids[row[lucky]]), batch.column(1).take(pa.array(row[lucky]))], names=["leaf", "c", "v"])

        sample = found.select("c", "v").mapInArrow(pick, f"leaf bigint, c bigint, v {kind}").toPandas().sort_values("c")
        cuts: dict[int, Node] = {}
        for k in large:
            v = sample["v"][sample["leaf"] == k].tolist()[: want[k]]
            x = np.array(v, dtype=float).reshape(len(v), width)
            x = np.unique(x / np.sqrt((x * x).sum(axis=1))[:, None], axis=0)
            apart = len(x) > 1 and np.abs(x - x[0]).max() > 1e-6
            n = len(x) if apart else want[k]
            cuts[k] = Node(x if apart else None, list(range(n_leaves, n_leaves + n)))
            n_leaves += n

        def refined(node: Node | int) -> Node | int:
            if not isinstance(node, Node):
                return cuts.get(node, node)
            node.children = [refined(c) for c in node.children]
            return node

        tree = refined(tree)

        def count(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            held: dict[int, int] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    home = place(tree, _unit(batch.column(1)), batch.column(0).to_numpy(), 0.0, visits=False)[0]
                    for k, n in zip(*np.unique(home, return_counts=True), strict=True):
                        held[int(k)] = held.get(int(k), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["leaf", "n"])

        sizes = {r["leaf"]: r["n"] for r in found.select("c", "v").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    return tree, n_leaves


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, leaf: int = 16_384) -> DataFrame:
    """Rows ``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Rows are linked if the cosine of their vectors, in double precision, is at least
    ``cosine``. Null, empty and zero vectors and vectors with null or non-finite components
    link with nothing; neither do vectors of different widths. Rows with the same id are
    rows of their own. ``component_id`` is the smallest id that links reach (null ids are
    passed over), its own id where there are no links; ``kept`` says that it is the own id
    (false for a null id). Only the two named columns take part. An empty table gives no rows.
    """
    kind = "array<float>" if dict(vectors.select(F.col(f"`{vector}`").alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast(kind).alias("v"))
    # abs(x) < inf is false for NaN (the greatest value here) and infinite components, null for null ones.
    fine = F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # A vector's class: the digest of its components' shortest exact decimals. It stands for the vector as a key.
    same = F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    rows = rows.select("vec_id", F.when(fine, same).alias("same"), F.when(fine, F.col("v")).alias("v"))
    found = rows.where("same is not null").groupBy("same").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    found = cut(found.select(F.monotonically_increasing_id().alias("c"), "same", "v", "least", "copies"))
    widths = {r[0]: r[1] for r in found.groupBy(F.size("v")).count().collect()}
    results = found.select("c", F.lit(None).cast("long").alias("d"), F.lit(0).cast("long").alias("links")).limit(0)
    for width, total in sorted(widths.items()):
        results = results.union(_join(found.where(F.size("v") == width), total, width, cosine, leaf, kind))
    results = cut(results)
    links = results.where("d is null").groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(results.where("d is not null").select(F.col("c").alias("a"), F.col("d").alias("b")))
    own = found.select("c", "same", "least", "copies").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")).join(links, "c", "left")
    own = cut(own.select("same", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = joined(own, cut(own.groupBy("root").agg(F.min("least").alias("component_id"))), "root")
    keyed = cut(rows.select("vec_id", "same"))
    out = joined(keyed.where("same is not null"), cut(names.select("same", "n_links", "component_id")), "same").select("vec_id", "n_links", "component_id")
    out = out.union(keyed.where("same is null").select("vec_id", F.lit(0).cast("long"), F.lit(None).cast(keyed.schema["vec_id"].dataType)))
    linked = F.col("n_links").cast("long")
    out = out.select("vec_id", linked.alias("n_links"), F.when(linked > 0, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _join(found: DataFrame, total: int, width: int, cosine: float, leaf: int, kind: str) -> DataFrame:
    """Rows (c, null, links) to add up, and (c, d, 0) for edges that preserve the components of all links."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    tree, n_leaves = grow(found, total, width, leaf, kind)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                leaves, row, home = place(tree, _unit(batch.column(2)), batch.column(0).to_numpy(), reach)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(~home), *(batch.column(i).take(take) for i in range(3))], names=["leaf", "visits", "c", "copies", "v"])

    sent = found.select("c", "copies", "v").mapInArrow(send, f"leaf bigint, visits boolean, c bigint, copies bigint, v {kind}")
    sent = sent.repartition(min(n_leaves, 4096), "leaf") if n_leaves > 1 else sent.coalesce(1)
    return sent.sortWithinPartitions("leaf", "visits").mapInArrow(lambda batches: _links(batches, cosine), "c bigint, d bigint, links bigint")


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cells, home vectors first, to links and edges."""
    at, forest, own, sums = None, _Forest(), [], {}

    def emit(c: list, d: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["c", "d", "links"])

    def flush() -> Iterator[pa.RecordBatch]:
        if sums:
            yield emit(list(sums), [None] * len(sums), list(sums.values()))
            sums.clear()

    def compare(mine: tuple, other: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        near = mine[2] @ other[2].T >= cosine
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if not len(i):
            return
        for keys, copies in ((mine[0][i], other[1][j]), (other[0][j], mine[1][i])):
            for k, n in zip(*_added(keys, copies), strict=True):
                sums[k] = sums.get(k, 0) + n
        x, y = (mine[0][i], other[0][j]) if len(i) < 2000 else _stars(mine[0][i], other[0][j])
        edges = [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if forest.join(a, b)]
        if edges:
            yield emit([a for a, _ in edges], [b for _, b in edges], [0] * len(edges))
        if len(sums) > 100_000:
            yield from flush()

    for whole in batches:
        ids = whole.column(0).to_numpy()
        visits = whole.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero((ids[1:] != ids[:-1]) | (visits[1:] != visits[:-1]))[0] + 1).tolist(), len(ids)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(start, end, 1024):
                piece = whole.slice(k, min(1024, end - k))
                if ids[k] != at:
                    at, own = ids[k], []
                new = (piece.column(2).to_numpy(), piece.column(3).to_numpy(), _unit(piece.column(4)))
                for mine in own:
                    yield from compare(mine, new, False)
                if not visits[k]:
                    yield from compare(new, new, True)
                    own.append(new)
    yield from flush()


def oracle(cosine: float = 0.95) -> str:
    """``near_duplicates`` as DuckDB SQL over ``embeddings``, by all pairs: for small tables."""
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, embedding :: DOUBLE[] AS e FROM embeddings),
    fine AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
    links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.r != b.r WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {cosine} ELSE false END),
    reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    names AS (SELECT reach.a, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
    told AS (SELECT vec_id, coalesce(n, 0) :: BIGINT AS n_links, CASE WHEN n > 0 THEN least ELSE vec_id END AS component_id FROM v LEFT JOIN counts ON counts.a = r LEFT JOIN names ON names.a = r)
    SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM told"""


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique.tolist(), np.bincount(at, weights=values, minlength=len(unique)).astype(np.int64).tolist()


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the components of the pairs (a, b), one a node: the node and its component's least."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new
