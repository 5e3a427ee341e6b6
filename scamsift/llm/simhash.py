"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 meet half way: each emits its ball of radius 1, the
variants are shuffled, and equal variants collide. The half left over by the odd radius is
covered by masks: the 64 bits form four blocks, a ball is emitted around the 48 bits
outside each block, and a pair at distance 3 has a bit in some block, so at most two
differing bits remain outside it. Every colliding pair is then checked on all 64 bits.
Only distinct fingerprints take part, so exact copies cost one row.

A bucket never leaves its task as all its pairs: a task keeps a forest of the links it
has found and emits an edge only if it joins two trees, which preserves all components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, components, cut, free, joined

BITS, RADIUS, BLOCKS = 64, 3, 4
_WIDTH = BITS // BLOCKS
_LOWER = bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text's word shingles, as an unsigned integer."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()
    take = shingle - 1 if len(words) >= shingle else len(words) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, last[take:], strict=False)])
    n = len(hashes) // 8
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded scratch for very long texts
        piece = np.frombuffer(hashes, dtype=np.uint8)[8 * at : 8 * (at + (1 << 16))]
        counts += np.unpackbits(piece.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; null and wordless texts have 0."""

    def run(texts: pa.Array) -> list[pa.Array]:
        values = texts.cast(pa.large_binary()).to_pylist()
        return [pa.array(np.array([fingerprint(t or b"") for t in values], dtype=np.uint64).view(np.int64))]

    return annotate(docs, text, f"{name} bigint", run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(prints: DataFrame) -> DataFrame:
    """Rows ``block``, ``key``, ``fp``: for every block, the ball of radius 1 around the bits outside it."""
    rows = []
    for block in range(BLOCKS):
        inside = ((1 << _WIDTH) - 1) << (_WIDTH * block)
        keep = ((1 << BITS) - 1) ^ inside
        for flip in [0] + [1 << b for b in range(BITS) if not inside >> b & 1]:
            rows.append(f"named_struct('block', {block}Y, 'keep', {_sql(keep)}, 'flip', {_sql(flip)})")
    return prints.select("fp", F.expr(f"inline(array({', '.join(rows)}))")).selectExpr("block", "(fp & keep) ^ flip AS key", "fp")


def _sql(x: int) -> str:
    x = _signed(x)
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


class _Forest:
    """Union-find over the fingerprints that were linked so far; starts anew when it has grown too large, which only costs edges."""

    def __init__(self, most: int = 500_000):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up = self.up
        at = up.setdefault(x, x)
        while up[at] != at:
            up[at] = up[up[at]]
            at = up[at]
        return at

    def join(self, x: int, y: int) -> bool:
        if len(self.up) > self.most:
            self.up = {}
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _bucket(prints: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the radius, a piece at a time.

    A bucket's members agree on the 48 bits outside the block but for a flip each. Small
    buckets are compared in pieces; beyond that, every mask of up to three bits within the
    block is looked up, so the work grows with the members and not with their square.
    """
    if len(prints) <= 4096:
        for at in range(0, len(prints), 512):
            near = np.bitwise_count(prints[at : at + 512, None] ^ prints[None, :]) <= RADIUS
            i, j = np.nonzero(near)
            lower = i + at < j
            yield i[lower] + at, j[lower]
        return
    width = np.uint64(_WIDTH * block)
    inside = (prints >> width) & np.uint64((1 << _WIDTH) - 1)
    outside = prints & ~(np.uint64((1 << _WIDTH) - 1) << width)
    order = np.lexsort((outside, inside))
    inside, outside = inside[order], outside[order]
    key = inside
    for mask in [m for m in range(1 << _WIDTH) if m.bit_count() <= RADIUS]:
        t = mask.bit_count()
        want = inside ^ np.uint64(mask)
        lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        for step in range(int((hi - lo).max(initial=0))):  # at most 49 outsides share an inside
            has = np.nonzero(lo + step < hi)[0]
            other = lo[has] + step
            near = (has < other) & (np.bitwise_count(outside[has] ^ outside[other]) + t <= RADIUS)
            yield order[has[near]], order[other[near]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (block, key, fp) rows to the edges of a forest of links."""
    forest = _Forest()
    out: list[tuple[int, int]] = []
    kept: list[np.ndarray] = []

    def take(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> None:
        new = np.nonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))[0] + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        pairs = list(zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist(), strict=True))
        out.extend((x, y) for x, y in pairs if forest.join(x, y))
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            members = fp[at : at + n]
            signed = members.view(np.int64).tolist()
            star = np.bitwise_count(members ^ members[0]) <= RADIUS
            if star.all():
                out.extend((signed[0], y) for y in signed[1:] if forest.join(signed[0], y))
                continue
            for i, j in _bucket(members, int(block[at])):
                out.extend((signed[x], signed[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(signed[x], signed[y]))

    def flush() -> pa.RecordBatch:
        a, b = zip(*out, strict=True) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()]))
        block, key = kept[-1][0], kept[-1][1]
        if block[0] == block[-1] and key[0] == key[-1] and len(kept) > 1 and (kept[0][0, -1], kept[0][1, -1]) == (block[0], key[0]):
            continue
        rows = np.concatenate(kept, axis=1)
        tail = np.nonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[0]
        end = int(tail[-1]) + 1 if len(tail) else 0
        kept = [rows[:, end:]]
        if end:
            take(rows[0, :end], rows[1, :end], rows[2, :end].copy().view(np.uint64))
        if out:
            yield flush()
    if kept:
        rows = np.concatenate(kept, axis=1)
        take(rows[0], rows[1], rows[2].copy().view(np.uint64))
    yield flush()


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``, long), whose components are those of all links."""
    dealt = variants(prints).repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    return dealt.mapInArrow(_links, "a bigint, b bigint").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """Rows ``fp``, ``root`` for every fingerprint in ``prints`` (``fp``); a null fp is left out."""
    own = prints.select("fp").where("fp is not null").distinct()
    linked = components(links(own))
    return own.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest key that links reach.

    Every row of ``docs`` gives a row; repeated rows stay. Null and wordless texts have
    fingerprint zero and are linked like any other. A null key never is a component's id
    unless the component has no other key. Only the key and the text take part, whatever
    other columns there are. An empty table gives no rows.
    """
    prints = cut(with_fingerprint(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", F.col("__fp").alias("fp")))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(classes(least).join(least, "fp"))
    names = joined(found, cut(found.groupBy("root").agg(F.min("least").alias("component_id"))), "root")
    return joined(prints, cut(names.select("fp", "component_id")), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one with the smallest key.

    Rows that equal each other in all columns are one document, of which one row stays; of
    different rows with the smallest key, the one with the least hash. A null key is chosen
    only if its class has no other. Null and wordless texts are one class. The columns of
    ``docs`` come back as they were, whatever their names. An empty table gives no rows.
    """
    row, own, body = free(docs, "__row", "__key", "__text0")
    tagged = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    prints = with_fingerprint(tagged.select(F.col(f"`{key}`").alias(own), row, F.col(f"`{text}`").alias(body)), body)
    prints = cut(prints.select(F.col(own).alias("k"), F.col(row).alias("r"), F.col("__fp").alias("fp")))
    rank = F.struct(F.col("k").isNull().alias("null"), "k", "r", "fp")
    least = cut(prints.groupBy("fp").agg(F.min(rank).alias("best")))
    found = classes(least).join(least, "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = found.select("best.k", "best.r", "best.fp")
    copies = prints.groupBy("k", "r", "fp").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col("p.fp") == F.col("c.fp"), F.col("p.r") == F.col("c.r"), F.col("p.k").eqNullSafe(F.col("c.k"))]
    chosen = cut(copies.alias("p").join(chosen.alias("c"), same).select("p.k", "p.r", "p.n"))
    stay = tagged.alias("d").join(chosen.alias("c"), [F.col(f"d.{row}") == F.col("c.r"), F.col(f"d.`{key}`").eqNullSafe(F.col("c.k"))])
    once = stay.where("c.n = 1").select(*[F.col(f"d.`{c}`") for c in docs.columns])
    if chosen.where("n > 1").isEmpty():
        return once
    return once.union(stay.where("c.n > 1").select(*[F.col(f"d.`{c}`") for c in docs.columns]).dropDuplicates())
