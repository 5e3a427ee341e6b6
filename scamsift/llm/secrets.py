"""Secret scans: fixed patterns, then assignment-aware lexing.

The patterns find sensitive assignments, access keys and long hexadecimal runs. The lexer
reads name-literal pairs from source and configuration syntax: assignments, keys of objects,
keyword arguments and setters with strings of all quotes, in brackets and over several lines,
joined by operators; XML elements and attributes; command-line flags; unquoted values of
.env, INI, properties and YAML lines and of lists of settings such as ``a=1;b=2``. Constants
are propagated to the names that use them, before or after their definition and through
items, and a literal is scored by the words of the names it reaches and by the form of the
whole value that it is a piece of. Literals that score high enough and that no pattern span
covers are added as spans of kind ``literal``. The scan takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, free

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of the class is maximal, so shorter runs can't match
#: Every text with a span of some kind matches one of these (for RE2, on Arrow data): of a pattern, or of a sensitive name.
_ANY = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:pass|pwd|secret|token|key|credential|bearer|auth|pin)"
_SENSE = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|pin", re.IGNORECASE | re.ASCII)

# Words of names that hold secrets, with the score each gives its literal.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "pin": 0.4, "key": 0.4,
}
# Pairs of words that are one of these when written apart.
COMPOUND = (("pass", "word"), ("pass", "wd"), ("pass", "phrase"), ("api", "key"), ("private", "key"), ("access", "key"))
# Words of names that say a literal is no secret itself.
HARMLESS = ("name", "id", "url", "uri", "path", "file", "type", "length", "expiry", "field", "label", "placeholder", "hint", "regex", "format")
# Literals that only stand for a secret.
STAND_INS = ("changeme", "example", "placeholder", "your", "xxxx", "dummy", "test", "todo", "redacted", "none", "null", "undefined", "true", "false")

_NAME = r"(?<![\w$])(?<![\w$]\.)[A-Za-z_$][\w$]*+(?:(?:\.|->|::)[A-Za-z_$][\w$]*+)*+"
_ITEMS = r"""(?:\[\s*+["'][\w.-]++["']\s*+\])*+"""
_OP = r"(?::=|=>|\+=|=(?![=~>])|:(?![:=/]))"
#: What gets a value: a name with items, a quoted key, or a setter's call; then an operator, or the call's comma or bracket.
_HEAD = re.compile(
    rf"""(?:(?P<name>{_NAME})(?P<items>{_ITEMS})["']?|["'](?P<key>[\w.$-][\w .$-]{{0,100}})["'])(?::\s?[A-Za-z_][\w.]*+)?[ \t]*+(?P<op>{_OP})"""
    rf"""|(?<![\w$])(?:set|put|add|with)(?P<set>[A-Z_]\w*+)\((?=\s*+["'`])|(?<![\w$])(?:set|put|add|with)\w*+\(\s*+["'](?P<put>[\w.-]++)["']\s*+,""",
    re.ASCII,
)
_REF = re.compile(rf"(?P<name>[A-Za-z_$][\w$]*+(?:(?:\.|->|::)[A-Za-z_$][\w$]*+)*+)(?P<items>{_ITEMS})", re.ASCII)
_ITEM = re.compile(r"[\w.-]+", re.ASCII)
_BLANK = re.compile(r"(?:[ \t]|\\\r?\n)*+")  # a backslash continues a line
_BLANKS = re.compile(r"\s*+")
_QUOTE = re.compile(r"""[rRbBuUfF]{0,2}(\"\"\"|\'\'\'|["'`])""")
_BODY = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+"'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'"), "`": re.compile(r"(?:[^`\\]|\\.)*+`", re.DOTALL),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.DOTALL), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.DOTALL),
}
_JOINT = re.compile(r"""\+(?!=)|\.\.|\.(?=\s*+["'$])|&(?=\s*+["'\w])|(?=[rRbBuUfF]{0,2}["'`])""")
#: Settings with an unquoted value: alone on a line, maybe with a comment; the line below a YAML block mark; one of a list parted by separators; a flag's.
_KEY = r"(?P<name>[A-Za-z_$][\w$.-]*+)[ \t]*+(?::=|=>|=(?![=~>])|:(?![:=/]))[ \t]*+"
_ATTRIBUTES = r"""(?:\s++[\w:.-]++\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'))*?"""
_BARE = (
    re.compile(rf"""^[ \t]*+(?:export[ \t]++|set[ \t]++|-[ \t]++)*+{_KEY}(?P<value>[^\s"'`#;][^\s]*+)[ \t]*+(?=$|\r|[#;]|//)""", re.ASCII | re.MULTILINE),
    re.compile(rf"^[ \t]*+(?:-[ \t]++)*+{_KEY}[|>][+-]?[ \t]*+\r?\n[ \t]++(?P<value>[^\s]++)[ \t]*+(?=$|\r)", re.ASCII | re.MULTILINE),
    re.compile(rf"""(?<=[;,{{&?])[ \t]*+{_KEY}(?P<value>[^\s"'`;,&}}]++)(?=[ \t]*+(?:[;,&}}\r]|$))""", re.ASCII | re.MULTILINE),
    re.compile(r"""(?<![\w-])--?(?P<name>[A-Za-z][\w-]*+)[ \t]++(?P<value>[^\s"'`-][^\s"'`]*+)""", re.ASCII),
    re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+(?P<value>[^<>\s]++)\s*+(?=</)", re.ASCII),
    re.compile(rf"""<[\w:.-]++{_ATTRIBUTES}\s++(?:key|name|id)\s*+=\s*+["'](?P<name>[\w.:-]++)["'](?:{_ATTRIBUTES}\s++value\s*+=\s*+["']|[^<>]*+(?<!/)>\s*+)(?P<value>[^<>"'\s]++)(?=["'<\s])""", re.ASCII),
)
#: Unquoted values that are code, not literals: whole calls and subscripts of a name, and what opens a bracket at a line's end.
_CODE = re.compile(r"[A-Za-z_$][\w$.]*+(?:[(\[]\S*[)\]]|[(\[{])", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
CUTOFF = 0.6
#: What redaction puts in a secret's place; no secret itself.
MARK = "[removed]"


def name_score(name: str) -> float:
    """How much a literal under this name is expected to be secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(re.split(r"\.|->|::", name)[-1])]
    if not words or words[-1] in HARMLESS:
        return 0.0
    pairs = ["".join(p) for p in zip(words, words[1:], strict=False) if p in COMPOUND]
    return max(SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0.0)) for w in words + pairs)


def literal_score(text: str) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    low = text.lower()
    if len(text) < 8 or text == MARK or any(c.isspace() for c in text) or low.startswith(("${", "{{", "<", "%(", "http://", "https://")) or any(s in low for s in STAND_INS):
        return 0.0
    counts = Counter(text).values()
    bits = -sum(c / len(text) * math.log2(c / len(text)) for c in counts)
    mixed = sum(any(t(c) for c in text) for t in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in text)
    return min(1.0, 0.15 * mixed + bits / 4)


class _Pairs:
    """The name-literal pairs of a text: values are made of literal spans, of values known before, and of names still to come."""

    def __init__(self, text: str):
        self.text = text
        self.values: list[list] = []
        self.known: dict[str, int] = {}
        self.sensitive: list[tuple[float, int]] = []
        self.dead: set[str] = set()  # quotes that have no closing one from here on

    def literal(self, at: int) -> tuple[tuple[int, int], int] | None:
        m = _QUOTE.match(self.text, at)
        if m is None or m[1] in self.dead:
            return None
        body = _BODY[m[1]].match(self.text, m.end())
        if body is None:
            if m[1] not in ('"', "'"):
                self.dead.add(m[1])
            return None
        return (m.end(), body.end() - len(m[1])), body.end()

    def value(self, at: int) -> tuple[list, int]:
        """The parts of the expression at ``at`` and where its last literal ends. A call or an operator other than joining ends it, with what it has."""
        text, parts, open_, end = self.text, [], 0, at
        blank = _BLANKS.match(text, at).end()
        if blank > at and _QUOTE.match(text, blank):
            at = blank
        while True:
            at = (_BLANKS if open_ else _BLANK).match(text, at).end()
            if text[at : at + 1] == "(":
                open_, at = open_ + 1, at + 1
                continue
            found = self.literal(at)
            if found is not None:
                parts.append(found[0])
                at = end = found[1]
            else:
                m = _REF.match(text, at)
                if m is None or text[m.end() : m.end() + 1] in ("(", "[", "{"):
                    return parts, end
                parts.append(_path(m))
                at = m.end()
            after = (_BLANKS if open_ else _BLANK).match(text, at).end()
            while open_ and text[after : after + 1] == ")":
                open_ -= 1
                after = (_BLANKS if open_ else _BLANK).match(text, after + 1).end()
            joint = _JOINT.match(text, after)
            if joint is None:
                return parts, end
            at = joint.end()
            if joint.end() > joint.start():
                at = _BLANKS.match(text, at).end()

    def read(self) -> None:
        at, text = 0, self.text
        while m := _HEAD.search(text, at):
            parts, end = self.value(m.end())
            at = max(m.end(), end)
            if not parts:
                continue
            path = _path(m) if m["name"] else m["key"] or m["set"] or m["put"]
            before = self.known.get(path)
            value = [self.known.get(p, p) if isinstance(p, str) else p for p in parts]
            if m["op"] == "+=" and before is not None:
                value.insert(0, before)
            self.values.append(value)
            self.known[path] = len(self.values) - 1
            if sense := _sense(path):
                if before is not None and before in value and self.sensitive and self.sensitive[-1][1] == before:
                    self.sensitive.pop()  # a value that grows is judged when it is whole, its pieces then count as well
                self.sensitive.append((sense, len(self.values) - 1))

    def parts(self, start: int) -> list[tuple[int, int]]:
        """All literal spans that a value is made of, in order; each value is followed 8 times at most, so k = k + k can't grow without end."""
        out, count, stack = [], Counter(), [start]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                item = self.known.get(item)
            if isinstance(item, tuple):
                out.append(item)
            elif item is not None and count[item] < 8:
                count[item] += 1
                stack.extend(reversed(self.values[item]))
        return out


def _path(m: re.Match) -> str:
    items = _ITEM.findall(m["items"] or "")
    return "\0".join([m["name"], *items])


def _sense(path: str) -> float:
    """The score of a name, or of its last item; a plain item of a sensitive container counts a little less than the container."""
    name, *items = path.split("\0")
    if not items:
        return name_score(name)
    last = name_score(items[-1])
    words = _WORDS.findall(items[-1])
    return last or (0.0 if words and words[-1].lower() in HARMLESS else 0.9 * name_score(name))


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a name, with constants propagated."""
    pairs = _Pairs(text)
    pairs.read()
    best: dict[tuple[int, int], float] = {}
    for sense, value in pairs.sensitive:
        parts = pairs.parts(value)
        score = sense * literal_score("".join([text[a:b] for a, b in parts]).replace(MARK, "").strip())
        for a, b in parts:
            if text[a:b].strip() not in ("", MARK):
                best[a, b] = max(best.get((a, b), 0.0), score)
    for pattern in _BARE:
        for m in pattern.finditer(text):
            sense = name_score(m["name"])
            a = m.start("value")
            b = a + len(m["value"].rstrip(",;"))
            value = text[a:b]
            if sense and value != MARK and not value.startswith(("(", "$(")) and not _QUOTE.match(value) and value not in pairs.known and not _CODE.fullmatch(value):
                score = sense * literal_score(value.replace(MARK, ""))
                best[a, b] = max(best.get((a, b), 0.0), score)
    return [(a, b, s) for (a, b), s in best.items()]


def scan(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) in code points, in order; kind is a position in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    if _SENSE.search(text):
        starts, reach = [a for a, _, _ in found], list(accumulate((b for _, _, b in found), max))
        for a, b, score in literals(text):
            before = bisect_right(starts, a)
            if score >= CUTOFF and not (before and reach[before - 1] >= b):
                found.append((a, 3, b))
    return sorted(found)


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(texts: pa.Array) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Text and spans of each row; texts without any trigger aren't decoded."""
    texts = pc.fill_null(texts, "")
    hit = pc.match_substring_regex(texts, _ANY).to_pylist()
    return [(t := texts[i].as_py(), scan(t)) if h else ("", []) for i, h in enumerate(hit)]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_literal, base_sha256 and spans.

    A null text counts as empty: no spans, the digest of the empty string. Spans are
    ``kind:start:end`` in code points, end exclusive, by start and then kind. Columns of
    these names are replaced; repeated rows stay. An empty table gives no rows.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        rows = [s for _, s in _scanned(texts)]
        counts = [[sum(k == want for _, k, _ in s) for s in rows] for want in range(4)]
        digest = [hashlib.sha256(_spell([x for x in s if x[1] < 3]).encode()).hexdigest() for s in rows]
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_spell(s) for s in rows], pa.string())]

    return annotate(docs, text, "n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string", run)


def redact_text(text: str, mark: str = MARK) -> str:
    """``text`` with every secret replaced: of an assignment its value, of other kinds the span.

    Removing a span can join characters into a new one, so this goes on until none is left.
    """
    for _ in range(len(text) + 1):  # each pass takes at least one character that is no mark
        cuts = []
        for a, k, b in scan(text):
            if k == 0:
                m = _ASSIGN.match(text, a)
                a = m.start(2) if m else a
            cuts.append((a, b))
        if not cuts:
            break
        out, at = [], 0
        for a, b in sorted(cuts):
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mark]
            at = b
        text = "".join([*out, text[at:]])
    return text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text column; a null text stays null, n_chars (if there) follows the text.

    Rows, also repeated ones, stay as they are otherwise, with all columns, whatever their
    names. An empty table gives no rows.
    """
    (clean,) = free(docs, "__clean")

    def run(texts: pa.Array) -> list[pa.Array]:
        hit = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
        if not any(hit):
            return [texts.cast(pa.string())]
        return [pa.array([redact_text(t) if h else t for h, t in zip(hit, texts.to_pylist(), strict=True)], pa.string())]

    out = annotate(docs, text, f"{clean} string", run)
    made = {text: F.col(clean)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length(clean).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
