"""Language identification by prediction by partial matching over bytes.

For each language, counts of bytes after contexts of 0 to 3 bytes form a context tree. The
probability of a byte follows escape method C: in the longest context the language knows,
a byte seen c times of n, among k kinds, has c / (n + k); an unseen byte pays the escape
k / (n + k) and is tried in the next shorter context, down to a uniform byte. The counts
are frozen after training, so a byte's cost depends on its context alone, and a text's
exact code length under each language is a sum of costs. Texts are lower-cased; a text
starts after line feeds.

A tree is kept as sorted arrays of the contexts and bytes that its language has, so a model
grows with what was seen in training and not with the alphabet. The different runs of four
bytes in a slice of text are looked up once a language, and its bytes pick up the costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut, fold, joined, slices
from .text_stats import _raw, _strings

ORDER = 3
UNKNOWN = "und"
#: Bytes that are worked on at once, however long a text is.
CHUNK = 1 << 20
#: A score is the posterior of a stretch of this many bytes with the text's average code lengths.
STRETCH = 64
#: Bits by which noise is less likely than a language before a text is read.
NOISE_BITS = 16.0


def runs(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For pieces of the bytes: where the piece starts, and each byte with the three before it in its text as one number."""
    for start in range(0, len(raw), CHUNK):
        end = min(start + CHUNK, len(raw))
        key = np.zeros(end - start, dtype=np.uint32)
        lo, hi = np.searchsorted(at, [start - ORDER, end], "left")
        starts, ends = at[:-1][lo:hi], at[1:][lo:hi]
        for back in range(ORDER, -1, -1):
            before = np.full(end - start, 10, dtype=np.uint8)
            skip = min(max(0, back - start), end - start)
            before[skip:] = raw[start - back + skip : max(start - back + skip, end - back)]
            for k in range(back):  # the first bytes of each text see line feeds
                first = starts + k
                first = first[(first < ends) & (first >= start) & (first < end)]
                before[first - start] = 10
            key = key << np.uint32(8) | before
        yield start, key


@dataclass(frozen=True)
class Tree:
    """Of each order: runs of context and byte with their bits, and contexts with the bits of an escape from them."""

    grams: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray) -> Tree:
        """The tree of counts of runs of four bytes."""
        grams, bits, contexts, escapes = [], [], [], []
        for order in range(ORDER + 1):
            own, at = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(own))
            context, at = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(at, weights=n, minlength=len(context)), np.bincount(at, minlength=len(context))
            grams.append(own)
            bits.append(-np.log2(n / (total[at] + kinds[at])).astype(np.float32))
            contexts.append(context)
            escapes.append(-np.log2(kinds / (total + kinds)).astype(np.float32))
        return Tree(tuple(grams), tuple(bits), tuple(contexts), tuple(escapes))

    def cost(self, keys: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each run of four."""
        out = np.zeros(len(keys), dtype=np.float32)
        open_ = np.arange(len(keys))
        for order in range(longest, -1, -1):
            own = keys[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            known, at = _find(self.grams[order], own)
            out[open_[known]] += self.bits[order][at[known]]
            open_, own = open_[~known], own[~known] >> np.uint32(8)
            known, at = _find(self.contexts[order], own)
            out[open_[known]] += self.escapes[order][at[known]]
        out[open_] += 8
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


@dataclass(frozen=True)
class ContextTrees:
    langs: list[str]
    trees: list[Tree]
    noise: Tree | None  # of all languages together; only its bytes without context are used

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code lengths in bits, a row a text, a column a language and a last one for bytes without context."""
        raw, at = _raw(texts)
        out = np.zeros((len(at) - 1, len(self.langs) + 1))
        for start, keys in runs(raw, at):
            where, unique = pd.factorize(keys)
            lo, hi = (np.clip(x, start, start + len(keys)) - start for x in (at[:-1], at[1:]))
            for i in range(len(self.langs) + 1):
                cost = self.trees[i].cost(unique) if i < len(self.langs) else self.noise.cost(unique, 0) if self.noise else np.zeros(len(unique))
                total = np.concatenate(([0.0], np.cumsum(cost[where], dtype=np.float64)))
                out[:, i] += total[hi] - total[lo]
        return out


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four bytes of texts, lower-cased, and how often each occurs."""
    raw, at = _raw(_strings(pc.utf8_lower(_strings(texts))))
    found = [np.unique(keys, return_counts=True) for _, keys in runs(raw, at)]
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def train_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
    """Context trees of the counted runs of each language; languages in alphabetical order."""
    langs = sorted(counts)
    noise = Tree.of(*(np.concatenate([counts[lang][i] for lang in langs]) for i in (0, 1))) if langs else None
    return ContextTrees(langs, [Tree.of(*counts[lang]) for lang in langs], noise)


def train_texts(texts: dict[str, list[str]]) -> ContextTrees:
    return train_counts({lang: counted(pa.array(own, pa.large_string())) for lang, own in texts.items()})


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", modulus: int = 5, held: int = 0, docs_a_lang: int = 300, docs_in_all: int = 20_000) -> ContextTrees:
    """Trees from a bounded sample of whole documents of any length.

    Every value of the language column is learned, from about ``docs_a_lang`` documents, or
    from fewer, but at least about 8, where that would be more than ``docs_in_all``
    altogether. Documents of the held-out fold or with a null id, text or language are left
    out. A document is taken if a hash of its id and text falls under the share that its
    language needs, or is the least of its language, so the sample depends neither on the
    order of rows nor on the layout of files; repeated rows are taken alike. Runs of bytes
    are counted where the documents are; the driver gets the counts.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("k is not null and t is not null and l is not null")
    rows = rows.where(fold(F.col("k"), modulus) != held).withColumn("h", F.pmod(F.xxhash64("k", F.octet_length("t")), F.lit(1 << 40)))
    sizes = cut(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")))
    n_langs = sizes.count()
    want = max(8, min(docs_a_lang, docs_in_all // max(1, n_langs)))
    bound = sizes.select("l", F.greatest("least", (F.least(F.lit(1.0), F.lit(float(want)) / F.col("n")) * float(1 << 40)).cast("long")).alias("bound"))
    taken = joined(rows, bound, "l").where("h <= bound").select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t"):
                names = piece.column(0)
                for name in pc.unique(names).to_pylist():
                    keys, n = counted(piece.column(1).filter(pc.equal(names, name)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["l", "key", "n"])

    got = taken.mapInArrow(count, "l string, key bigint, n bigint").groupBy("l", "key").agg(F.sum("n").alias("n")).toPandas()
    return train_counts({name: (part["key"].to_numpy().astype(np.uint32), part["n"].to_numpy()) for name, part in got.groupby("l")})


def identify(docs: DataFrame, model: ContextTrees, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    The language with the shortest code is predicted; of equally short ones the first in
    alphabetical order. The score is its posterior against the other languages, with equal
    priors, and against bytes without any context (noise, ``NOISE_BITS`` less likely), for a
    stretch of ``STRETCH`` bytes with the text's average code lengths (a shorter text counts
    as it is). A text that
    is half one language and half another has a low score, however long it is, and so has
    gibberish. ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Columns of these names are replaced, others stay, whatever their names; repeated
    rows stay and are predicted alike. An empty table gives no rows.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        lower = pc.utf8_lower(_strings(texts))
        letter = pc.match_substring_regex(lower, r"\pL").to_numpy(zero_copy_only=False)
        if not model.langs:
            return [pa.array([UNKNOWN] * len(lower), pa.string()), pa.array(np.zeros(len(lower)))]
        bits = model.bits(lower)
        best = bits[:, :-1].argmin(axis=1)
        length = np.maximum(1, pc.binary_length(lower).to_numpy(zero_copy_only=False))
        gap = (bits - bits[np.arange(len(bits)), best][:, None]) * np.minimum(1, STRETCH / length)[:, None]
        gap[:, -1] += NOISE_BITS
        score = 1 / np.exp2(-np.clip(gap, -1000, 1000)).sum(axis=1)
        names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letter, np.minimum(1.0, score), 0.0))]

    return annotate(docs, text, "lang_pred string, score double", run)
