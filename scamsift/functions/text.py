"""Text: canonical form, tokens, n-grams and extractors, as column functions.

The fold keeps one order: compatibility decomposition, look-alike characters, digits and
signs, lower case, combining marks. It is applied once; a second pass may change more.
Null texts are treated as empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import FOLDED_SCRIPTS, LATER_READINGS

#: An ASCII word boundary: Java's ``\\b`` also knows letters of other scripts, which the patterns don't.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space as scripts on the web know it.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# Digits and signs that stand for letters.
LEET = ("013457@$", "oleastas")
# Combining signs that extend a token in ten Indic scripts.
INDIC_MARKS = (
    r"ऀ-ःऺ-़ा-ॏ॑-ॗॢ-ॣঁ-ঃ়া-ৄে-ৈো-্ৗৢ-ৣ৾"
    r"ਁ-ਃ਼ਾ-ੂੇ-ੈੋ-੍ੑੰ-ੱੵઁ-ઃ઼ા-ૅે-ૉો-્ૢ-ૣૺ-૿"
    r"ଁ-ଃ଼ା-ୄେ-ୈୋ-୍୕-ୗୢ-ୣஂா-ூெ-ைொ-்ௗ"
    r"ఀ-ఄ఼ా-ౄె-ైొ-్ౕ-ౖౢ-ౣಁ-ಃ಼ಾ-ೄೆ-ೈೊ-್ೕ-ೖೢ-ೣೳ"
    r"ഀ-ഃ഻-഼ാ-ൄെ-ൈൊ-്ൗൢ-ൣඁ-ඃ්ා-ුූෘ-ෟෲ-ෳ"
)
TOKEN = rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{INDIC_MARKS}]+"
#: The same for Java, which tries the many ranges of marks only on characters beyond ASCII.
FAST_TOKEN = rf"[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_]++|(?![\x00-\x7F])[{INDIC_MARKS}]++)+"
# Extractor patterns, with bounded repeats so that they stay linear.
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){1,10}[a-zA-Z]{2,24}"
EMAIL = rf"[a-zA-Z0-9._%+-]{{1,64}}@{DOMAIN}"
URL = rf"""\b(?:https?:\/\/|www\.)[^\s<>"')]+|\b{DOMAIN}(?:\/[^\s<>"')]*)?"""
PHONE = r"\+?\d[\d\s().-]{7,}\d"
PAGE_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKD", s))


def nfkd(text: Column) -> Column:
    """Compatibility decomposition, which Spark has no function for."""
    return F.pandas_udf(_nfkd, "string")(text)


def _latin(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Pairs whose character belongs to a folded script, stays as it is when decomposed and reads as one ASCII letter, maybe by way of a digit."""
    leet, out = dict(zip(*LEET, strict=True)), {}
    for char, reads in pairs:
        reads = leet.get(reads, reads)
        known = any(a <= ord(char) <= b for a, b in FOLDED_SCRIPTS)
        if known and len(reads) == 1 and reads.isascii() and reads.isalpha() and re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", char)) == char:
            out[char] = reads
    return out


@lru_cache(maxsize=1)
def confusables() -> dict[str, str]:
    """Characters that read as one ASCII letter by the Unicode confusables data, which come with Spark (in ICU).

    ``load_confusables`` reads the published file instead, for another version of Unicode.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    chars = [c for a, b in FOLDED_SCRIPTS for c in map(chr, range(a, b + 1)) if unicodedata.normalize("NFD", c) == c]
    builder = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
    reads = builder().build().getSkeleton("\n".join(chars)).split("\n")
    found = _latin(zip(chars, reads, strict=True)) | LATER_READINGS
    if len(found) < 150:
        raise RuntimeError("no confusables in this Spark: give those of load_confusables")
    return found


def load_confusables(spark: SparkSession, path: str) -> dict[str, str]:
    """Characters that read as one ASCII letter, from a file in the format of the Unicode confusables list."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9A-Fa-f]+\s*;\s*[0-9A-Fa-f]+\s*;")).collect()  # some thousand lines
    return _latin(tuple(chr(int(x.strip(), 16)) for x in r["value"].lstrip("\ufeff").split(";")[:2]) for r in rows)


_confusables = confusables


def fold(text: Column, digits: bool = True, unicode: bool = True, confusables: dict[str, str] | None = None) -> Column:
    """The canonical fold. ``unicode=False`` leaves out the decomposition, for texts known to be ASCII or decomposed."""
    t = F.coalesce(text, F.lit(""))
    if unicode:
        table = _confusables() if confusables is None else confusables
        t = nfkd(t)
        t = F.translate(t, "".join(table), "".join(table.values()))
    if digits:
        t = F.translate(t, *LEET)
    return F.regexp_replace(F.lower(t), "[\\u0300-\\u036F]", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize(text: Column, digits: bool = True, unicode: bool = True, confusables: dict[str, str] | None = None) -> Column:
    return squeeze(fold(text, digits, unicode, confusables))


def rule_text(text: Column, unicode: bool = True, confusables: dict[str, str] | None = None) -> Column:
    """The form that the tactic rules read: no separators within numbers, plain apostrophes, normalised."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[.,](?=\d)", "")
    return normalize(F.regexp_replace(t, "[‘’ʼ´`]", "'"), unicode=unicode, confusables=confusables)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(FAST_TOKEN), F.lit(0))


def ngrams(words: Column, longest: int = 2) -> Column:
    """All runs of 1 to ``longest`` tokens, joined by a space: shorter ones first, each in the order of the text."""
    return let(words, lambda w: F.concat(*[_runs(w, n) for n in range(1, longest + 1)]))


def _runs(words: Column, n: int) -> Column:
    out, left = words, F.greatest(F.size(words) - n + 1, F.lit(0))
    for k in range(1, n):
        out = F.zip_with(F.slice(out, 1, left), F.slice(words, k + 1, left), lambda a, b: F.concat_ws(" ", a, b))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used (also within lambdas)."""
    return F.transform(F.array(value), body)[0]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each evaluated once a row: later uses can't inline the expression again.

    A generator of one row stands between; plain projections may be merged with what uses them.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), lambda e: F.lower(e)))


def urls(text: Column) -> Column:
    """Links in the order of the text, each once. The domain of an e-mail address counts as a link."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + URL.replace(r"\b", EDGE).replace(r"\s", SPACE[1:-1])), F.lit(0))
    kept = F.filter(found, lambda u: ~u.rlike("(?i)^[a-z0-9._%+-]+@"))
    cut = F.transform(kept, lambda u: F.regexp_replace(u, "[.,;:!?)]+$", ""))
    return F.array_distinct(F.filter(cut, lambda u: u.contains(".")))


def phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 8))


def truncate(text: Column, n: int = 60) -> Column:
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words: minutes, hours and days are rounded half up."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / 60000 + 0.5)
    hours, days = F.floor(minutes / 60 + 0.5), F.floor(F.floor(minutes / 60 + 0.5) / 24 + 0.5)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(days, F.lit("d ago")))
