"""Signals of the links in a message: all within the row, without exploding and regrouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import BRAND_DOMAINS, RISKY_TLDS, SHORTENERS
from ..functions.domains import mixes_scripts
from ..functions.text import let
from .logic import java
from .rules import SIGNAL, signal

CREDENTIAL_PATH = r"(?i)\/(login|signin|verify|secure|account|update|confirm|billing|kyc|otp)\b"


def _signals(u: Column, i: Column) -> Column:
    like, host, domain = u["like"], u["host"], u["domain"]
    tld = F.element_at(F.split(domain, r"\."), -1)
    coded = host.startswith("xn--") | host.contains(".xn--")
    mixed = mixes_scripts(u["shown"])
    at = lambda k: i * 10 + k
    q = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    how = (
        F.when(like["kind"] == "homoglyph", "is spelt with characters that read as").when(like["kind"] == "typo", "is a slip of the pen away from")
        .when(like["kind"] == "subdomain", "is a subdomain elsewhere named after").otherwise("adds a word to")
    )
    return F.array(
        F.when(like.isNotNull(), signal("lookalike_domain", 3.0, q("\"", host, "\" ", how, " ", like["brand"], " (", like["legit"], ")"), 1, at(0), like["brand"])),
        F.when(domain.isin(*SHORTENERS), signal("url_shortener", 1.1, q("\"", host, "\" hides where the link goes"), 1, at(1))),
        F.when(tld.isin(*RISKY_TLDS), signal("high_risk_tld", 1.0, q("\".", tld, "\" is often abused"), 1, at(2))),
        F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), signal("ip_address_host", 1.8, q("the link goes to the address ", host), 1, at(3))),
        F.when(like.isNull() & coded, F.when(mixed, signal("mixed_script_host", 1.6, q("\"", u["shown"], "\" mixes alphabets"), 1, at(4))).otherwise(signal("punycode_host", 0.5, q("\"", u["shown"], "\" is written in another alphabet"), 1, at(4)))),
        F.when(u["url"].rlike(java(CREDENTIAL_PATH)) & like.isNull() & ~domain.isin(*BRAND_DOMAINS), signal("credential_path", 0.6, q("\"", host, "\" links to a sign-in page"), 1, at(5))),
        F.when(F.size(F.split(host, r"\.")) >= 5, signal("deep_subdomain", 0.7, q("\"", host, "\" hides its domain under subdomains"), 1, at(6))),
        F.when(u["url"].rlike(r"(?i)^https?:\/\/[^/\s]*@"), signal("userinfo_url", 2.4, q("an @ hides that the link goes to ", host), 1, at(7))),
    )


def link_signals(links: Column) -> Column:
    """Signals of described links, each (id, detail) once, in the order of links and checks."""
    def once(every: Column) -> Column:
        same = lambda s: lambda b: (b["id"] == s["id"]) & (b["detail"] == s["detail"])
        return F.filter(every, lambda s, i: (i == 0) | ~F.exists(F.slice(every, 1, F.greatest(i, F.lit(1))), same(s)))

    return F.coalesce(let(F.array_compact(F.flatten(F.transform(links, _signals))), once), F.array().cast(f"array<{SIGNAL}>"))


def feed_key(url: Column) -> Column:
    """The form in which links are looked up in a threat feed: without trailing slashes."""
    return F.regexp_replace(url, "/+$", "")


def feed_signal(url: Column) -> Column:
    return signal("urlhaus_match", 4.0, F.concat(F.lit("the link is on a list of live malware and phishing addresses: "), url), 1, 1_000_000)
