"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. The first tier is a minimal
perfect hash (hash and displace) over the vocabulary: its slot holds the only token that a
pre-token can equal, and the bytes are compared. Pre-tokens that miss are merged with a
heap of candidate pairs over a linked list of bytes, lowest rank first, leftmost first.

Texts are worked on a slice at a time: the pattern's cuts are found for all characters of
the slice at once, equal pre-tokens are looked up once, and ids and the bytes that they
decode to are gathered from there.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import annotate
from .text_stats import _raw, _strings

#: Ids of pre-tokens seen by this process, by tokenizer; a worker keeps them from task to task.
_CACHES: dict[tuple, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
#: Bytes of the longest pre-token that is kept.
LONGEST_KEPT = 64
# Fixed value: the pattern whose cuts ``cuts`` finds without a regular expression.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What follows an apostrophe in that pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SIGN, _LETTER, _DIGIT, _BLANK = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: letter, number, white space (the Unicode property) or another sign."""
    out = np.full(0x110000, _SIGN, dtype=np.uint8)
    for start in range(0, 0x110000, 0x10000):
        text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(start, start + 0x10000))
        for kind, name in ((_LETTER, "L"), (_DIGIT, "N"), (_BLANK, "White_Space")):
            for m in regex.finditer(rf"\p{{{name}}}+", text):
                out[start + m.start() : start + m.end()] = kind
    out[0xD800:0xE000] = _SIGN
    return out


def _points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte that each starts at. Bytes that are no UTF-8 count as U+FFFD each."""
    if not len(raw) or raw.max() < 128:
        return raw, np.arange(len(raw))
    at = np.nonzero((raw & 0xC0) != 0x80)[0]
    if not len(at) or at[0] != 0:
        at = np.concatenate(([0], at))
    lead = raw[at].astype(np.uint32)
    width = np.diff(np.append(at, len(raw)))
    want = np.where(lead < 0x80, 1, np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2)))
    point = np.where(want == 1, lead, lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.uint32)[want])
    for k in range(1, 4):
        more = np.nonzero(want > k)[0]
        point[more] = point[more] << np.uint32(6) | raw[np.minimum(at[more] + k, len(raw) - 1)] & 0x3F
    point[(want != width) | (point >= 0x110000)] = 0xFFFD
    return point, at


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes where the pre-tokens of ``WORDS_PATTERN`` start, for texts that lie one after another with offsets ``at``."""
    point, byte = _points(raw)
    n = len(point)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _kinds()[point]
    first = np.zeros(n + 1, dtype=bool)  # of a text
    first[np.searchsorted(byte, at)] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.nonzero(new)[0]
    end = np.append(run[1:], n)
    blank = kind[run] == _BLANK
    start = np.zeros(n, dtype=bool)
    # A run of other characters takes a space before it along.
    head = run[~blank]
    led = ~first[head] & (point[head - 1] == 0x20)
    start[head - led] = True
    # White space before something else leaves its last character to what follows.
    a, b = run[blank], end[blank]
    last = first[b]
    start[a[last | (b - a > 1)]] = True
    start[b[~last] - 1] = True
    # An apostrophe that starts a pre-token takes its ending along.
    mark = head[(point[head] == 0x27) & ~led]
    mark = mark[(mark + 1 < n) & ~first[mark + 1]]
    mark = mark[kind[mark + 1] == _LETTER]
    for ending in ENDINGS:
        fits = np.ones(len(mark), dtype=bool)
        for k, c in enumerate(ending, 1):
            there = np.minimum(mark + k, n - 1)
            fits &= (mark + k < n) & ~first[there] & (point[there] == ord(c))
        hit = mark[fits]
        start[hit + 1] = False
        past = hit + 1 + len(ending)
        past = past[past < n]
        # What follows starts anew, but a space that a later run takes along already does.
        start[past[(kind[past] == _LETTER) | first[past]]] = True
    return byte[start]


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one displacement a bucket of about four keys.

    A bucket's displacement d >= 0 puts a key with hash h into slot ``mix(h, d) % n``; a
    bucket of one key names its slot as ``-1 - d``.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        for self.seed in range(100):
            h = self.hashes(keys)
            if len(np.unique(h)) == n and self._place(h):
                return
        raise ValueError("keys are not distinct")

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k, self.seed) for k in keys), dtype=np.uint64, count=len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _mixed(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)

    def _place(self, h: np.ndarray, most: int = 1 << 20, chunk: int = 256) -> bool:
        bucket = self._bucket(h)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot = np.full(self.n, -1, dtype=np.int64)
        groups = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        taken = np.zeros(self.n, dtype=bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            keys = groups[b]
            if len(keys) < 2:
                break
            for start in range(0, most, chunk):
                d = np.arange(start, start + chunk)
                at = self._mixed(h[keys][None, :], d[:, None])
                ordered = np.sort(at, axis=1)
                fine = ~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fine.any():
                    k = int(fine.argmax())
                    break
            else:
                return False
            self.shift[b] = d[k]
            taken[at[k]], self.slot[at[k]] = True, keys
        free = iter(np.nonzero(~taken)[0].tolist())
        for b in range(self.buckets):
            if len(groups[b]) == 1:
                a = next(free)
                self.shift[b], self.slot[a] = -1 - a, groups[b][0]
        return True

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash, the position of the only key that it can belong to."""
        d = self.shift[self._bucket(h)]
        return self.slot[np.where(d < 0, -1 - d, self._mixed(h, np.maximum(d, 0)))]


class Tokenizer:
    """Encodes and decodes by a rank file; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str, keep: int = 500_000):
        self.tokens, self.ids = tokens, np.array(ids, dtype=np.uint32)
        self.rank = dict(zip(tokens, ids, strict=True))
        self.by_id = {i: t for t, i in self.rank.items()}
        self.table = PerfectHash(tokens)
        self.pattern = pattern
        self.keep = keep
        self._ready()

    def _ready(self) -> None:
        self.plain = regex.compile(self.pattern).finditer
        # White space as the Unicode property has it, without U+001C..U+001F.
        strict = self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.strict = regex.compile(strict).finditer
        self.spelt = pa.array([self.by_id.get(i, b"") for i in range(max(self.by_id, default=-1) + 1)], pa.large_binary())
        self.two = [-1] * 65536  # ranks of pairs of bytes
        for token, i in self.rank.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = i
        self.packed = [struct.pack("<I", i) for i in self.ids.tolist()]
        self.cache, self.older = _CACHES.setdefault((self.pattern, self.table.seed, len(self.tokens), self.tokens[-1]), ({}, {}))

    def starts(self, texts: pa.Array) -> np.ndarray:
        """The bytes, counted over all texts, where pre-tokens start."""
        raw, at = _raw(texts)
        if self.pattern == WORDS_PATTERN:
            return cuts(raw, at)
        out: list[int] = []
        for begin, text in zip(at[:-1].tolist(), texts.to_pylist(), strict=True):
            # The engines differ only on U+001C..U+001F, so the slower pattern is kept for these.
            found = (self.strict if regex.search("[\x1c-\x1f]", text) else self.plain)(text)
            out.extend(begin + len(text[: m.start()].encode()) if not text.isascii() else begin + m.start() for m in found)
        return np.array(out, dtype=np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("plain", "strict", "cache", "by_id", "spelt", "packed", "two", "rank", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.rank = dict(zip(self.tokens, self.ids.tolist(), strict=True))
        self.by_id = {i: t for t, i in self.rank.items()}
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token by heap merging: the heap has the rank of each pair of neighbours and where it starts, as one number."""
        rank, n = self.rank, len(piece)
        if n == 1:
            return [rank[piece]]
        get, two, bits = rank.get, self.two, n.bit_length()
        after = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n))
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            r = heappop(heap)
            i = r & low
            if pair[i] != r >> bits:
                continue  # one of the two parts has changed
            mid = after[i]
            stop = after[mid]
            pair[mid] = -1
            after[i] = stop
            if stop < n:
                before[stop] = i
                pair[i] = r = get(piece[i : after[stop]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = -1
            if (j := before[i]) >= 0:
                pair[j] = r = get(piece[j:stop], -1)
                if r >= 0:
                    heappush(heap, r << bits | j)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pre-tokens, each as little-endian bytes."""
        if 2 * len(self.cache) > self.keep:  # what was seen lately stays for another half
            self.older.clear()
            self.older.update(self.cache)
            self.cache.clear()
        get, old = self.cache.get, self.older.get
        found = [get(p) or old(p) for p in pieces]
        new = [i for i, f in enumerate(found) if f is None]
        if self.older:
            self.cache.update((p, f) for p, f in zip(pieces, found, strict=True) if f is not None and len(p) <= LONGEST_KEPT)
        if new:
            at = self.table.find(self.table.hashes([pieces[i] for i in new])).tolist()
            for i, k in zip(new, at, strict=True):
                p = pieces[i]
                if self.tokens[k] == p:
                    found[i] = self.packed[k]
                else:
                    own = self.merge(p)
                    found[i] = struct.pack(f"<{len(own)}I", *own)
                if len(p) <= LONGEST_KEPT:
                    self.cache[p] = found[i]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids start; texts are large strings without nulls."""
        raw, at = _raw(texts)
        starts = self.starts(texts)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(at), dtype=np.int64)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self.look_up(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        flat, ends = _raw(ids)
        return flat.view("<u4"), ends[np.searchsorted(starts, at)] // 4

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after another, and where each id's bytes start."""
        return _raw(self.spelt.take(pa.array(ids)))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return Tokenizer([base64.b64decode(t) for t, _ in rows], [int(r) for _, r in rows], pattern)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and with ``ids`` the ids as token_ids.

    Token ids are packed as little-endian unsigned 32-bit integers, four bytes each, which
    takes a fraction of the memory of an array column.

    A null text counts as empty: no tokens. The decoded digest is taken of the bytes that
    the ids decode to, not of the text. Columns of these names are replaced, others stay,
    whatever their names; repeated rows stay and are encoded alike. An empty table gives no
    rows.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        own, at = tokenizer.encode(_strings(texts))
        spelt, byte = tokenizer.decode(own)
        packed, bounds, back = memoryview(np.ascontiguousarray(own)).cast("B"), at.tolist(), byte[at].tolist()
        spelt = memoryview(np.ascontiguousarray(spelt))
        digest = lambda data, edges, size: pa.array([hashlib.sha256(data[size * a : size * b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)], pa.string())
        out = [pa.array(np.diff(at)), digest(packed, bounds, 4), digest(spelt, back, 1)]
        return [*out, pa.array([bytes(packed[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())] if ids else out

    return annotate(docs, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids, run)
