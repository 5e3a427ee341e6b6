"""Rule bodies as data.

A body is a small tree over one text. It is tested in Arrow batches, where one pass of an
automaton finds which words a text contains: a pattern runs only if the text has one of the
words that its matches can't do without, which are read off the parsed pattern. The same tree
compiles to a Spark column for a single rule and to DuckDB SQL for checking.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _parser as parser  # the public parse tree of patterns has no other door

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import EDGE, let

def java(pattern: str) -> str:
    """The pattern for Java, whose ``\\b`` would also count letters of other scripts.

    A boundary that opens a word only has to look back and one that closes a word only
    ahead, as the character on its other side belongs to the word. Only where a word can
    end in white space the full test stays.
    """
    if r"re:\s" in pattern:
        return pattern.replace(r"\b", EDGE)
    out, at = [], 0
    for m in re.finditer(r"\\b", pattern):
        opens = re.match(r"[A-Za-z0-9(]", pattern[m.end() :]) is not None
        out += [pattern[at : m.start()], "(?<![A-Za-z0-9_])" if opens else "(?![A-Za-z0-9_])"]
        at = m.end()
    return "".join([*out, pattern[at:]])


#: Words that matches need are kept up to this many; more would cost what the expression does.
MOST_WORDS = 120
Words = frozenset[str]


def _better(a: Words | None, b: Words | None) -> Words | None:
    """The set whose shortest word is longer; of two such the smaller one."""
    rank = lambda w: (min(map(len, w)), -len(w)) if w else (0, 0)
    return max((a, b), key=rank) if a and b else a or b


def _union(sets: list[Words | None]) -> Words | None:
    return frozenset().union(*sets) if sets and all(sets) else None


def _of_sequence(items) -> Words | None:
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        if op is parser.LITERAL and not chr(arg).isspace():
            run += chr(arg)
            continue
        if len(run) > 1:
            best = _better(best, frozenset((run,)))
        run = ""
        if op is parser.SUBPATTERN:
            best = _better(best, _of_sequence(arg[3]))
        elif op is parser.BRANCH:
            best = _better(best, _union([_of_sequence(x) for x in arg[1]]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
            best = _better(best, _of_sequence(arg[2]))
    return best


@lru_cache(maxsize=None)
def words_of(pattern: str) -> Words | None:
    """Words without white space one of which any match contains; None if there are none to tell."""
    found = _of_sequence(parser.parse(pattern))
    return found if found and len(found) <= MOST_WORDS else None


class Finder:
    """Finds which of a set of words a text contains, in one pass over the text."""

    def __init__(self, words: Words):
        self.words = words
        self.finder = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "finder": None}

    def __call__(self, text: str) -> set[str]:
        if self.finder is None:
            self.finder = self._made()
        return self.finder(text)

    def _made(self):
        try:
            import ahocorasick
        except ImportError:
            return lambda text: {w for w in self.words if w in text}
        automaton = ahocorasick.Automaton()
        for w in self.words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        return lambda text: {w for _, w in automaton.iter(text)}


@lru_cache(maxsize=None)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def gated(t: Column, words: Words | None, test: Column) -> Column:
    """``test``, evaluated only where the text has one of the words."""
    if not words:
        return test
    some = F.lit(False)
    for w in sorted(words, key=lambda w: (len(w), w)):
        if not any(v != w and v in w for v in words):
            some = some | t.contains(w)
    return F.when(some, test).otherwise(False)


@dataclass(frozen=True)
class Body:
    def column(self, t: Column, context: dict[str, Column]) -> Column:
        raise NotImplementedError

    def test(self, t: str, known: dict[str, bool], found: set[str]) -> bool:
        """Whether the body holds for a text; ``found``: words that the whole text contains, of all those that patterns need."""
        raise NotImplementedError

    def patterns(self) -> set[str]:
        """The patterns that are gated by words."""
        parts = [*getattr(self, "parts", ()), *([self.part] if hasattr(self, "part") else [])]
        return set().union(*(p.patterns() for p in parts))

    def words(self) -> Words | None:
        """Words one of which a text for which the body holds contains. Patterns that become a space take no such word in, as words hold none."""
        return None

    def sql(self, t: str, context: dict[str, str]) -> str:
        raise NotImplementedError

    def __and__(self, other: Body) -> Body:
        return All((self, other))

    def __or__(self, other: Body) -> Body:
        return Any((self, other))

    def __invert__(self) -> Body:
        return Not(self)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# RE2 has no look-ahead. What follows a word and excludes it is removed with the word first.
_AHEAD: list[tuple[str, str, str]] = []


def excluded(pattern: str, word: str, following: str) -> str:
    """Registers ``word(?!following)`` within a pattern for the SQL form."""
    item = (f"{word}(?!{following})", word, f"{word}(?:{following})")
    if item not in _AHEAD:
        _AHEAD.append(item)
    return pattern


@dataclass(frozen=True)
class Has(Body):
    """The text matches the pattern somewhere."""

    pattern: str

    def column(self, t, context):
        return gated(t, self.words(), t.rlike(java(self.pattern)))

    def words(self):
        return words_of(self.pattern)

    def test(self, t, known, found):
        words = words_of(self.pattern)
        return (words is None or not words.isdisjoint(found)) and compiled(self.pattern).search(t) is not None

    def patterns(self):
        return {self.pattern}

    def sql(self, t, context):
        pattern = self.pattern
        for ahead, word, strip in _AHEAD:
            if ahead in pattern:
                pattern, t = pattern.replace(ahead, word), f"regexp_replace({t}, {quote(strip)}, ' ', 'g')"
        return f"regexp_matches({t}, {quote(pattern)})"


@dataclass(frozen=True)
class All(Body):
    parts: tuple[Body, ...]

    def column(self, t, context):
        # when() keeps the cheap first parts first; a conjunction may be reordered.
        out = self.parts[-1].column(t, context)
        for p in reversed(self.parts[:-1]):
            out = F.when(p.column(t, context), out).otherwise(False)
        return out

    def words(self):
        best = None
        for p in self.parts:
            best = _better(best, p.words())
        return best

    def test(self, t, known, found):
        return all(p.test(t, known, found) for p in self.parts)

    def sql(self, t, context):
        return "(" + " AND ".join(p.sql(t, context) for p in self.parts) + ")"


@dataclass(frozen=True)
class Any(Body):
    parts: tuple[Body, ...]

    def column(self, t, context):
        out = self.parts[0].column(t, context)
        for p in self.parts[1:]:
            out = out | p.column(t, context)
        return out

    def words(self):
        return _union([p.words() for p in self.parts])

    def test(self, t, known, found):
        return any(p.test(t, known, found) for p in self.parts)

    def sql(self, t, context):
        return "(" + " OR ".join(p.sql(t, context) for p in self.parts) + ")"


@dataclass(frozen=True)
class Not(Body):
    part: Body

    def column(self, t, context):
        return ~self.part.column(t, context)

    def test(self, t, known, found):
        return not self.part.test(t, known, found)

    def sql(self, t, context):
        return f"(NOT {self.part.sql(t, context)})"


@dataclass(frozen=True)
class Known(Body):
    """A fact about where the text comes from."""

    name: str

    def column(self, t, context):
        return F.coalesce(context[self.name], F.lit(False))

    def test(self, t, known, found):
        return known[self.name]

    def sql(self, t, context):
        return f"coalesce({context[self.name]}, false)"


@dataclass(frozen=True)
class Without(Body):
    """The part holds after these patterns have been replaced by a space, in turn."""

    removed: tuple[str, ...]
    part: Body

    def column(self, t, context):
        for p in self.removed:
            t = F.regexp_replace(t, java(p), " ")
        return self.part.column(t, context)

    def words(self):
        return self.part.words()

    def test(self, t, known, found):
        for p in self.removed:
            words = words_of(p)
            if words is None or not words.isdisjoint(found):
                t = compiled(p).sub(" ", t)
        return self.part.test(t, known, found)

    def patterns(self):
        return self.part.patterns() | set(self.removed)

    def sql(self, t, context):
        for p in self.removed:
            t = f"regexp_replace({t}, {quote(p)}, ' ', 'g')"
        return self.part.sql(t, context)


@dataclass(frozen=True)
class WithoutNear(Body):
    """The part holds after matches of ``pattern`` with ``near`` within ``reach`` characters have become a space."""

    pattern: str
    near: str
    reach: int
    part: Body

    def column(self, t, context):
        def walk(p: Column) -> Column:
            found, between, text = p["found"], p["between"], p["t"]

            def step(state: Column, i: Column) -> Column:
                match, gap = F.get(found, i), F.get(between, i)
                at = state["at"] + F.length(gap)
                start = F.greatest(F.lit(0), at - self.reach)
                around = F.substring(text, start + 1, at + F.length(match) + self.reach - start)
                kept = F.when(around.rlike(java(self.near)), " ").otherwise(match)
                return F.struct((at + F.length(match)).alias("at"), F.concat(state["out"], gap, kept).alias("out"))

            first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
            walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda s: F.concat(s["out"], F.coalesce(F.get(between, F.size(found)), F.lit(""))))
            return F.when(F.size(found) > 0, walked).otherwise(text)

        parts = F.struct(F.regexp_extract_all(t, F.lit(java(self.pattern)), F.lit(0)).alias("found"), F.split(t, java(self.pattern)).alias("between"), t.alias("t"))
        return let(let(parts, walk), lambda x: self.part.column(x, context))

    def words(self):
        return self.part.words()

    def test(self, t, known, found):
        near = compiled(self.near)
        around = lambda m: t[max(0, m.start() - self.reach) : m.end() + self.reach]
        return self.part.test(compiled(self.pattern).sub(lambda m: " " if near.search(around(m)) else m[0], t), known, found)

    def sql(self, t, context):
        cut, match = f"string_split_regex({t}, {quote(self.pattern)})", f"regexp_extract_all({t}, {quote(self.pattern)})"
        chars = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
        at = f"({chars(f'list_slice({cut}, 1, i)')} + {chars(f'list_slice({match}, 1, i - 1)')}) :: BIGINT"
        around = f"substr({t}, greatest(0, {at} - {self.reach}) + 1, {at} + length(({match})[i]) + {self.reach} - greatest(0, {at} - {self.reach}))"
        kept = f"CASE WHEN i > len({match}) THEN '' WHEN {Has(self.near).sql(around, context)} THEN ' ' ELSE ({match})[i] END"
        return self.part.sql(f"array_to_string(list_transform(range(1, len({cut}) + 1), lambda i: ({cut})[i] || {kept}), '')", context)


@dataclass(frozen=True)
class InClause(Body):
    """The part holds within one clause, clauses being cut at . ! and ?"""

    part: Body

    def column(self, t, context):
        return F.exists(F.split(t, "[.!?]"), lambda c: self.part.column(c, context))

    def words(self):
        return self.part.words()

    def test(self, t, known, found):
        return any(self.part.test(c, known, found) for c in re.split("[.!?]", t))

    def sql(self, t, context):
        return f"(len(list_filter(string_split_regex({t}, '[.!?]'), lambda c: {self.part.sql('c', context)})) > 0)"


@dataclass(frozen=True)
class InWindow(Body):
    """The part holds within two adjacent sentences (or the whole text if it has no more than two)."""

    part: Body

    def column(self, t, context):
        def pairs(cut: Column) -> Column:
            two = F.zip_with(F.slice(cut, 1, F.size(cut) - 1), F.slice(cut, 2, F.size(cut) - 1), lambda a, b: F.concat_ws(" ", a, b))
            return F.when(F.size(cut) <= 2, F.array(F.array_join(cut, " "))).otherwise(two)

        windows = let(F.split(F.regexp_replace(t, r"([.!?।])\s+", "$1\n"), r"\n+"), pairs)
        return F.exists(windows, lambda w: self.part.column(w, context))

    def words(self):
        return self.part.words()

    def test(self, t, known, found):
        cut = re.split(r"\n+", re.sub(r"([.!?।])[ \t\n\x0b\f\r]+", "\\1\n", t))
        windows = [" ".join(cut)] if len(cut) <= 2 else [f"{a} {b}" for a, b in zip(cut, cut[1:], strict=False)]
        return any(self.part.test(w, known, found) for w in windows)

    def sql(self, t, context):
        cut = f"string_split_regex(regexp_replace({t}, '([.!?।])\\s+', '\\1' || chr(10), 'g'), '\\n+')"
        pairs = f"list_transform(range(1, len({cut})), lambda i: ({cut})[i] || ' ' || ({cut})[i + 1])"
        return f"(len(list_filter(CASE WHEN len({cut}) <= 2 THEN [{t}] ELSE {pairs} END, lambda w: {self.part.sql('w', context)})) > 0)"


@dataclass(frozen=True)
class AtLeast(Body):
    n: int
    parts: tuple[Body, ...]

    def column(self, t, context):
        out = F.lit(0)
        for p in self.parts:
            out = out + p.column(t, context).cast("int")
        return out >= self.n

    def words(self):
        return _union([p.words() for p in self.parts])

    def test(self, t, known, found):
        return sum(p.test(t, known, found) for p in self.parts) >= self.n

    def sql(self, t, context):
        return "((" + " + ".join(f"({p.sql(t, context)}) :: INT" for p in self.parts) + f") >= {self.n})"


@lru_cache(maxsize=None)
def _rule_words(body: Body) -> Words | None:
    words = body.words()
    return words if words and len(words) <= 3 * MOST_WORDS else None


@dataclass(frozen=True)
class Rule:
    id: str
    weight: float
    detail: str
    body: Body

    def column(self, t: Column, context: dict[str, Column]) -> Column:
        return gated(t, self.words(), self.body.column(t, context))

    def words(self) -> Words | None:
        return _rule_words(self.body)
