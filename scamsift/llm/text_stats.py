"""Document statistics, computed for whole Arrow slices at once.

A word is a run of characters other than space and U+0009..U+000D. A null text counts as
empty. All figures of a text come from the whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that models score, in the order of ``features``.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "symbols_per_word", "upper_share", "digit_share",
    "mark_share", "bang_per_word", "distinct_share", "repeat_share", "dup_line_share", "log_line_words",
)

_KINDS = np.zeros((5, 256), dtype=bool)
_KINDS[0, list(b"#*$%&|<>")] = True
_KINDS[1, ord("A") : ord("Z") + 1] = True
_KINDS[2, ord("0") : ord("9") + 1] = True
_KINDS[3, list(b".,;:?-'\"()")] = True
_KINDS[4, ord("!")] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _ids(values: np.ndarray) -> tuple[np.ndarray, int]:
    codes, unique = pd.factorize(values)
    return codes.astype(np.int64), max(1, len(unique))


def _strings(array: pa.Array) -> pa.Array:
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return pc.fill_null(array.cast(pa.large_string()), "")


def _encode(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets, from 0."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each statistic as an int64 array, one value a text."""
    texts = _strings(texts)
    n = len(texts)
    raw, at = _raw(texts)
    kinds = [_sums(_KINDS[k][raw], at) for k in range(len(_KINDS))]

    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat, doc = words.flatten(), np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(doc, minlength=n)
    ids, unique = _encode(flat)
    chars = pc.utf8_length(unique).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = np.bincount(doc, weights=chars[ids], minlength=n).astype(np.int64) if len(ids) else np.zeros(n, np.int64)
    own, _ = _ids(doc * max(1, len(unique)) + ids)
    distinct = np.zeros(n, np.int64)
    if len(own):
        first = np.zeros(own.max() + 1, np.int64)
        first[own] = doc
        distinct = np.bincount(first, minlength=n)

    repeated = np.zeros(len(ids), dtype=bool)
    if len(ids) >= 3:
        pair, pairs = _ids(ids[:-2] * max(1, len(unique)) + ids[1:-1])
        window, windows = _ids(pair * max(1, len(unique)) + ids[2:])
        inside = doc[:-2] == doc[2:]
        own, _ = _ids(doc[:-2][inside] * windows + window[inside])
        twice = np.zeros(len(window), dtype=bool)
        twice[inside] = np.bincount(own)[own] >= 2 if len(own) else False
        repeated[:-2] |= twice
        repeated[1:-1] |= twice
        repeated[2:] |= twice
    n_repeat = np.bincount(doc[repeated], minlength=n)

    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line, unique_lines = _encode(lines.flatten())
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(unique_lines)), 0).to_numpy(zero_copy_only=False)
    held = full[line] if len(line) else np.zeros(0, bool)
    key, _ = _ids(line_doc[held] * max(1, len(unique_lines)) + line[held])
    n_lines = np.bincount(line_doc[held], minlength=n)
    n_dup = n_lines.copy()
    if len(key):
        first = np.zeros(key.max() + 1, np.int64)
        first[key] = line_doc[held]
        n_dup -= np.bincount(first, minlength=n)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": kinds[0], "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_upper": kinds[1], "n_digits": kinds[2], "n_marks": kinds[3], "n_bangs": kinds[4], "n_distinct": distinct, "n_lines": n_lines,
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The model's inputs, one row a text, in the order of ``FEATURES``; all finite, also for empty texts."""
    words, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, np.log1p(s["n_symbols"] / words), s["n_upper"] / chars, s["n_digits"] / chars,
        s["n_marks"] / chars, np.log1p(s["n_bangs"] / words), s["n_distinct"] / words, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, np.log1p(s["n_words"] / lines),
    ])
