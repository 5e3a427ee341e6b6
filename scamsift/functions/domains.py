"""Hosts and domains: parsing, public suffixes, punycode, look-alikes."""

from __future__ import annotations

import ipaddress
import pkgutil
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .constants import BRANDS, FIXTURE_SUFFIXES, SHORTENERS
from .text import LEET
from .text import confusables as _confusables

PARSED = "array<struct<url:string,host:string,shown:string,domain:string,like:struct<brand:string,legit:string,kind:string>>>"

_SCHEME = re.compile(r"https?://", re.IGNORECASE)
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _ipv4(host: str) -> str | None:
    """A host whose last label is a number, as a dotted quad; None if it isn't a valid address."""
    parts = host.rstrip(".").split(".")
    if len(parts) > 4:
        return None
    try:
        numbers = [int(p, 16) if p[:2].lower() == "0x" and len(p) > 2 else 0 if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]))


@lru_cache(maxsize=65536)
def host_of(url: str | None) -> str | None:
    """The host of a link, in lower case, ASCII form, without one leading ``www.``; None if there is none.

    International labels get their IDNA 2003 form.
    """
    if url is None:
        return None
    rest = _SCHEME.sub("", url.strip(), count=1) if _SCHEME.match(url.strip()) else url.strip()
    authority = re.split(r"[/?#\\]", rest.replace("\t", "").replace("\n", "").replace("\r", ""), maxsplit=1)[0]
    host = authority.rpartition("@")[2]
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    if port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        return None
    if host.startswith("["):
        return None
    if not host.isascii():
        try:
            host = ".".join(label.encode("idna").decode() if not label.isascii() else label for label in re.split("[.。．｡]", unicodedata.normalize("NFKC", host)))
        except UnicodeError:
            return None
    host = host.lower()
    if not host or _FORBIDDEN.search(host):
        return None
    if re.fullmatch(r"\d+|0x[0-9a-f]*", host.rstrip(".").rpartition(".")[2]):
        host = _ipv4(host)
    return re.sub(r"^www\.", "", host) if host else None


@lru_cache(maxsize=65536)
def punycode_to_unicode(host: str | None) -> str | None:
    """``host`` with its ``xn--`` labels decoded; a malformed label stays as it is."""

    def decode(label: str) -> str:
        if not label.startswith("xn--"):
            return label
        try:
            return label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return label

    return ".".join(map(decode, host.split("."))) if host is not None and "xn--" in host else host


@lru_cache(maxsize=1)
def public_suffixes() -> tuple[str, ...]:
    """All rules of the public suffix list beside this module, whichever Spark runs and wherever its libraries are.

    It is the list in the HTTP client of Spark 4.1, as published. ``load_suffixes`` reads a newer one from a file.
    """
    return tuple(_rules(pkgutil.get_data(__package__, "public_suffix_list.dat").decode().splitlines()))


def _rules(lines: Iterable[str]) -> list[str]:
    return [x.split()[0] for x in lines if x.strip() and not x.startswith("//")]


def load_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Rules of a public suffix list in its published format (comments and blank lines are passed over)."""
    return tuple(_rules(r[0] for r in spark.read.text(path).collect()))  # about ten thousand short lines


@dataclass(frozen=True)
class Suffixes:
    exact: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]

    @staticmethod
    @lru_cache(maxsize=8)
    def of(rules: tuple[str, ...]) -> Suffixes:
        return Suffixes(frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r[0] == "!"))

    def registrable(self, host: str | None) -> str | None:
        """The public suffix and one label more; the last two labels where no rule applies; a suffix itself stays."""
        if not host:
            return host
        labels = host.split(".")
        tails = [".".join(labels[i:]) for i in range(len(labels))]
        suffix = next((".".join(labels[i + 1 :]) for i, t in enumerate(tails) if t in self.exceptions), None)
        if suffix is None:
            suffix = next((t for i, t in enumerate(tails) if t in self.exact or (i + 1 < len(tails) and tails[i + 1] in self.wild)), None)
        if suffix is None:
            return ".".join(labels[-2:])
        return host if suffix == host else ".".join(labels[-(suffix.count(".") + 2 if suffix else 1) :])


def registrable_domain(host: Column, suffixes: tuple[str, ...] | None = None) -> Column:
    """The registrable domain of a host, by the whole public suffix list if no rules are given. Few hosts repeat a lot, so each batch looks up its different ones."""
    rules = Suffixes.of(suffixes or public_suffixes())

    def domains(hosts: pd.Series) -> pd.Series:
        return hosts.map({h: rules.registrable(h) for h in hosts.dropna().unique()})

    return F.pandas_udf(domains, "string")(host)


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def reads_as(shown: str, table: dict[int, str] | None = None) -> str:
    """What a (decoded, decomposed) domain reads as: folded, ``rn`` as ``m``, letters, dots and hyphens only."""
    folded = shown.translate(table or {}).translate(_LEET).lower()
    return re.sub("[^a-z.-]", "", re.sub("[\u0300-\u036f]", "", folded).replace("rn", "m"))


_LEET = str.maketrans(*LEET)


class Links:
    """Reads links: host, the host as shown, registrable domain and the brand that it imitates. A host is worked out once a batch of rows and kept."""

    def __init__(self, suffixes: tuple[str, ...], genuine_first: bool, looks: dict[str, str]):
        self.rules, self.genuine_first, self.looks = Suffixes.of(suffixes), genuine_first, str.maketrans(looks)
        self.brands = [(b, d, reads_as(d), reads_as(d).split(".")[0]) for b, domains, _ in BRANDS for d in domains]
        self.hosts: dict[str, tuple] = {}

    def like(self, host: str, plain: str, domain: str) -> dict | None:
        """The first brand and domain in order that say anything decide: genuine, or a homoglyph, subdomain, compound or typo look-alike."""
        labels = plain.split(".")
        own = reads_as(".".join(labels[-len(domain.split(".")) :]), self.looks)
        above = [reads_as(x, self.looks) for x in labels[: max(0, len(labels) - 2)]]
        label = own.split(".")[0]
        parts = label.split("-")
        first = None
        for brand, legit, reads, name in self.brands:
            if domain == legit or host == legit or host.endswith("." + legit):
                kind = "genuine"
            elif own == reads:
                kind = "homoglyph"
            elif name in above:
                kind = "subdomain"
            elif len(parts) > 1 and name in parts:
                kind = "compound"
            elif label != name and len(label) >= 4 and edits(label, name, most := 2 if len(name) > 8 else 1) <= most:
                kind = "typo"
            else:
                continue
            first = first or {"brand": brand, "legit": legit, "kind": kind}
            if kind == "genuine" or not self.genuine_first:
                return None if kind == "genuine" else first
        return first

    def host(self, host: str) -> tuple:
        if host not in self.hosts:
            if len(self.hosts) > 65536:
                self.hosts.clear()
            shown = punycode_to_unicode(host)
            plain = shown if shown.isascii() else unicodedata.normalize("NFKD", shown)
            domain = self.rules.registrable(host)
            self.hosts[host] = (shown, domain, self.like(host, plain, domain))
        return self.hosts[host]

    def read(self, urls: Iterable[str] | None) -> list[dict]:
        out = []
        for url in urls if urls is not None else ():
            if (host := host_of(url)) is not None:
                shown, domain, like = self.host(host)
                out.append({"url": url, "host": host, "shown": shown, "domain": domain, "like": like})
        return out


def parse_urls(urls: Column, suffixes: tuple[str, ...] | None = None, genuine_first: bool = False, confusables: dict[str, str] | None = None) -> Column:
    """For each link its host, the host as shown to a reader, its registrable domain and like: the brand that it imitates
    (brand, legit, kind), null if none or genuine. Links without a host are left out.

    With ``genuine_first`` a host that any entry knows as genuine is genuine.
    """
    links = Links(suffixes or public_suffixes(), genuine_first, _confusables() if confusables is None else confusables)
    return F.pandas_udf(lambda lists: lists.map(links.read), PARSED)(urls)


def registrable_sql(host: str, suffixes: tuple[str, ...] = FIXTURE_SUFFIXES) -> str:
    """``registrable_domain`` as a DuckDB expression, for few rules."""
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    exact = [s for s in suffixes if s[0] not in "*!"]
    wild, exceptions = [s[2:] for s in suffixes if s.startswith("*.")], [s[1:] for s in suffixes if s[0] == "!"]
    labels = f"string_split({host}, '.')"
    tail = lambda i: f"array_to_string(list_slice({labels}, {i} + 1, len({labels})), '.')"
    starts = f"range(0, len({labels}))"
    first = lambda test: f"list_filter({starts}, lambda i: {test})[1]"
    known = first(f"list_contains({q(exact)}, {tail('i')}) OR (i + 1 < len({labels}) AND list_contains({q(wild)}, {tail('(i + 1)')}))")
    return tail(f"coalesce({first(f'list_contains({q(exceptions)}, {tail('i')})')}, CASE WHEN {known} IS NOT NULL THEN greatest({known} - 1, 0) END, greatest(len({labels}) - 2, 0))")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, ``most + 1`` beyond ``most``."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def mixes_scripts(shown: Column) -> Column:
    """Whether a label holds Latin letters and letters of another script."""
    return F.exists(F.split(shown, r"\."), lambda s: s.rlike(r"\p{IsLatin}") & s.rlike(r"[\p{L}&&[^\p{IsLatin}]]"))


def is_shortener(host: Column) -> Column:
    return host.isin(*SHORTENERS)
