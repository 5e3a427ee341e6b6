"""Impersonation: pages that pose as a brand, forms that post elsewhere, messages with foreign sign-in links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import BRAND_DOMAINS, BRANDS, HOSTED_AUTH
from .logic import java
from .rules import SIGNAL, signal

# Patterns and limits.
SSO_PHRASE = r"(?iu)\b(?:sign[\s-]?in|log[\s-]?in|sign[\s-]?up|continue|register|connect|authenticate)\s+(?:with|using|via)\s+(?:your\s+)?[a-z]+(?:\s+(?:id|account|credentials))?"
SIGN_IN_BEFORE = r"(?iu)(?:sign[\s-]?in|log[\s-]?in|login|signin|welcome)\s+(?:back\s+)?(?:to|into)\s+(?:your\s+)?$|^\s*(?:login|sign[\s-]?in|net\s?banking|internet\s+banking|account\s+login)"
PRETEXT = (
    r"(?iu)\b(?:verif(?:y|ication)|suspend(?:ed)?|lock(?:ed)?|deactivat(?:e|ed)|expir(?:e|ed|es|ing)|unusual\s*(?:activity|sign[\s-]?in)|unauthori[sz]ed|confirm\s*your|re-?activate|restore\s*(?:your\s*)?access|update\s*your\s*(?:details|information|payment))\b"
)
CREDENTIAL_PATH = r"(?i)\/(login|signin|sign-in|verify|secure|account|update|confirm|billing|kyc|otp)\b"
TITLE_FILLER = r"(?iu)\b(?:sign(?:ing)?[\s-]?in|log(?:ging)?[\s-]?in|signin|login|welcome(?:\s+back)?|secure\s*login|net\s?banking|internet\s+banking|online\s+banking|account\s+login|authentication|verify\s+your\s+account|continue)\b"
TITLE_EDGE = r"^[\s\-–—|:.]+|[\s\-–—|:.]+$"
GENERIC_WORDS = (
    "member", "members", "portal", "account", "accounts", "dashboard", "home", "secure", "service", "services", "online", "banking", "customer", "client", "user", "users", "page", "site", "website",
    "welcome", "area", "center", "centre", "hub", "system", "app", "application", "into", "your", "you", "the",
)
LEAD, THIN, VERY_THIN = 600, 2500, 400
BEFORE, AFTER = 40, 24

_NONE = f"array<{SIGNAL}>"


def _mentions(text: Column, alias: str) -> Column:
    return text.rlike(f"(?iu)(^|[^a-z0-9]){re.escape(alias)}([^a-z0-9]|$)")


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def claims_identity(aliases: tuple[str, ...], title: Column, lead: Column) -> Column:
    """An alias in the title, or a sign-in phrase next to the first place of an alias in the lead."""
    low = F.lower(lead)

    def adjacent(alias: str) -> Column:
        at = F.instr(low, alias)
        before = F.substring(lead, F.greatest(F.lit(1), at - BEFORE), F.least(F.lit(BEFORE), at - 1))
        after = F.substring(lead, at + len(alias), F.lit(AFTER))
        return (at > 0) & (before.rlike(java(SIGN_IN_BEFORE)) | after.rlike(java(SIGN_IN_BEFORE)))

    return _any([_mentions(title, a) for a in aliases]) | _any([adjacent(a) for a in aliases])


def claimed_words(title: Column) -> Column:
    """The words of the name that a sign-in page's title claims; null if it claims none."""
    bare = F.trim(title)
    left = F.trim(F.regexp_replace(F.regexp_replace(title, java(TITLE_FILLER), " "), TITLE_EDGE, ""))
    words = F.filter(F.split(left, r"\s+"), lambda w: w.rlike("(?i)[a-z]") & ~F.lower(w).isin(*GENERIC_WORDS))
    return F.when((left != "") & (left != bare) & F.length(left).between(3, 40) & (F.size(words) > 0), words)


def related(words: Column, domain: Column) -> Column:
    return F.exists(words, lambda w: (F.length(w) >= 4) & F.lower(domain).contains(F.lower(w)))


def without_sso(text: Column) -> Column:
    return F.regexp_replace(text, java(SSO_PHRASE), " ")


def lead_of(body: Column) -> Column:
    return without_sso(F.substring(body, 1, LEAD))


def page_signals(domain: Column, title: Column, shown_title: Column, lead: Column, body: Column, credentials: Column, form_domains: Column, flagged: Column) -> Column:
    """Signals of a page.

    ``shown_title`` and ``lead`` are the title and the start of the body without phrases such
    as "sign in with"; ``form_domains`` are the registrable domains of its form targets in order, ``flagged``
    the brands that its links already imitate. The first brand that the page poses as
    counts; without one, a form that posts to an unrelated domain may.
    """
    ok = (F.size(credentials) > 0) & (F.length(body) <= THIN)
    asks = F.when(F.array_contains(credentials, "password"), F.when(F.array_contains(credentials, "otp"), "the password and the code sent to you").otherwise("the password")).otherwise("the code sent to you")
    foreign = F.get(F.filter(form_domains, lambda d: (d != "") & (d != domain)), F.lit(0))
    claims = [
        F.when(~F.array_contains(flagged, name) & ~domain.isin(*domains) & claims_identity(aliases, shown_title, lead),
               signal("brand_impersonation", 2.6, F.concat(F.lit(f"the page poses as {name} and asks for "), asks, F.lit(" at "), domain), 2, 0, F.lit(name)))
        for name, domains, aliases in BRANDS
    ]
    posed = F.coalesce(*claims)
    offsite = F.when(foreign.isNotNull(), signal("offsite_credential_post", 1.0, F.concat(F.lit("its form posts to "), foreign), 2, 1))

    words = claimed_words(title)
    unrelated = F.coalesce(words.isNotNull() & ~related(words, domain) & ~related(words, foreign), F.lit(False))
    very_thin, several = F.length(body) <= VERY_THIN, F.size(F.array_distinct(credentials)) >= 2
    weight = F.when(unrelated, 3.0).when(very_thin & several, 2.2).when(very_thin | several, 1.6)
    harvest = F.when(
        foreign.isNotNull() & ~foreign.isin(*HOSTED_AUTH) & ~foreign.isin(*BRAND_DOMAINS) & weight.isNotNull(),
        signal("offsite_credential_harvest", weight, F.concat(F.lit("a sign-in form at "), domain, F.lit(" posts to "), foreign), 2, 0),
    )
    found = F.when(posed.isNotNull(), F.array(posed, offsite)).otherwise(F.array(harvest))
    return F.coalesce(F.when(ok, F.array_compact(found)), F.array().cast(_NONE))


def message_signals(clean: Column, links: Column, flagged: Column) -> Column:
    """A message that names a brand, has a pretext and links to a sign-in page off the brand's domains: the first such brand. ``clean``: see ``without_sso``."""

    def claim(name: str, domains: tuple[str, ...], aliases: tuple[str, ...]) -> Column:
        foreign = F.get(F.filter(links, lambda u: u["url"].rlike(java(CREDENTIAL_PATH)) & ~u["domain"].isin(*domains)), F.lit(0))
        told = F.concat(F.lit(f"it names {name} but its sign-in link goes to "), foreign["host"])
        return F.when(~F.array_contains(flagged, name) & _any([_mentions(clean, a) for a in aliases]) & foreign.isNotNull(), signal("brand_claim_mismatch", 1.6, told, 2, 0, F.lit(name)))

    first = F.coalesce(*[claim(*b) for b in BRANDS])
    found = F.when((F.size(links) > 0) & clean.rlike(java(PRETEXT)) & first.isNotNull(), F.array(first))
    return F.coalesce(found, F.array().cast(_NONE))
