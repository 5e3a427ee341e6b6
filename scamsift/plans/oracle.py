"""DuckDB SQL for the registered queries: the same chain, written as common table expressions.

What the odd characters of the fixtures fold to and how their coded hosts read is stated there
by hand. RE2 has no look-around; ``operators.logic`` rewrites the exclusions of the rules.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.constants import BRAND_DOMAINS, BRANDS, HOSTED_AUTH, RISKY_TLDS, SHORTENERS
from ..functions.domains import public_suffixes, reads_as, registrable_sql
from ..operators import impersonation as I
from ..operators import rules as R
from ..operators.logic import quote as q
from ..operators.url_signals import CREDENTIAL_PATH
from . import fixtures

NO = "false"


def suffix_rules() -> list[str]:
    """The rules that the queries go by, in the same order."""
    return list(public_suffixes())


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def fold(t: str, digits: bool = True) -> str:
    t = f"translate(coalesce({t}, ''), {q(fixtures.ODD[0])}, {q(fixtures.ODD[1])})"
    t = f"translate({t}, {q(T.LEET[0])}, {q(T.LEET[1])})" if digits else t
    return f"regexp_replace(lower({t}), '[\\x{{300}}-\\x{{36F}}]', '', 'g')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\t\\n\\x0B\\f\\r \\x{{A0}}]+', ' ', 'g'))"


def normalize(t: str, digits: bool = True) -> str:
    return squeeze(fold(t, digits))


def rule_text(t: str) -> str:
    # Twice, as neighbouring matches share a digit.
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[.,]([0-9])', '\\1\\2', 'g')"
    return normalize(t)


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), {q(T.TOKEN)})"


def urls(t: str) -> str:
    found = f"regexp_extract_all(coalesce({t}, ''), {q('(?i)' + T.URL)})"
    cut = f"list_transform(list_filter({found}, lambda u: NOT regexp_matches(u, '(?i)^[a-z0-9._%+-]+@')), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))"
    return ordered_distinct(f"list_filter({cut}, lambda u: contains(u, '.'))")


def ordered_distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def host(u: str) -> str:
    return f"regexp_replace(regexp_extract(lower({u}), '^(?:https?://)?(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www\\.', '')"


def skeleton(d: str) -> str:
    return f"regexp_replace(replace({fold(d)}, 'rn', 'm'), '[^a-z.-]', '', 'g')"


def shown(domain: str) -> str:
    return f"CASE {domain} " + " ".join(f"WHEN {q(h)} THEN {q(s)}" for h, s in fixtures.SHOWN.items()) + f" ELSE {domain} END"


def messages() -> str:
    return f"msgs AS MATERIALIZED ({fixtures.messages_sql()})"


def ruled(source: str = "msgs", form: str = NO, official: str = NO) -> list[str]:
    """CTEs ruled (t and one boolean a rule), and heur (msg_id, rule signals, score, no_ask)."""
    context = {"has_credential_form": form, "on_official_domain": official}
    every = (*R.RULES, *R.EXONERATING)
    columns = ", ".join(f"coalesce({r.body.sql('t', context)}, false) AS r{i}" for i, r in enumerate(every))
    hit = "list_filter([" + ", ".join(f"CASE WHEN r{i} THEN {{'id': {q(r.id)}, 'weight': {r.weight} :: DOUBLE, 'layer': 0, 'ord': {i}}} END" for i, r in enumerate(R.RULES)) + "], lambda s: s IS NOT NULL)"
    first = len(R.RULES)
    ex = "list_filter([" + ", ".join(f"CASE WHEN r{first + i} THEN {{'id': {q(r.id)}, 'weight': {r.weight} :: DOUBLE}} END" for i, r in enumerate(R.EXONERATING)) + "], lambda s: s IS NOT NULL)"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda s: s.weight)), 0.0)"
    return [
        f"normal AS MATERIALIZED (SELECT *, {rule_text('text')} AS t FROM {source})",
        f"ruled AS MATERIALIZED (SELECT *, {columns} FROM normal)",
        f"fired AS (SELECT *, {hit} AS rule_signals, {ex} AS mild, r{first + 1} AS no_ask FROM ruled)",
        f"heur AS MATERIALIZED (SELECT *, CASE WHEN len(list_filter(rule_signals, lambda s: s.weight >= {R.SEVERE_AT})) > 0 THEN 0.0 ELSE {total('mild')} END AS relief, {total('rule_signals')} AS blame FROM fired)",
    ]


def links(source: str = "msgs", found: str = "") -> list[str]:
    """CTE links: msg_id, pos, url, host, domain, brand, kind (look-alike)."""
    table = ", ".join(f"({i}, {q(b)}, {q(d)}, {q(reads_as(d))}, {q(reads_as(d).split('.')[0])})" for i, (b, d) in enumerate((b, d) for b, ds, _ in BRANDS for d in ds))
    kind = """CASE WHEN domain = legit OR host = legit OR ends_with(host, '.' || legit) THEN 'genuine' WHEN own = reads THEN 'homoglyph'
      WHEN list_contains(above, b.label) THEN 'subdomain' WHEN len(string_split(l.label, '-')) > 1 AND list_contains(string_split(l.label, '-'), b.label) THEN 'compound'
      WHEN l.label != b.label AND length(l.label) >= 4 AND levenshtein(l.label, b.label) <= CASE WHEN length(b.label) > 8 THEN 2 ELSE 1 END THEN 'typo' END"""
    return [
        f"brands(ord, brand, legit, reads, label) AS (VALUES {table})",
        f"each AS (SELECT msg_id, unnest({found or urls('text')}) AS url, generate_subscripts({found or urls('text')}, 1) AS pos FROM {source})",
        f"hosts AS (SELECT *, {host('url')} AS host FROM each)",
        f"domains AS (SELECT *, {registrable_sql('host')} AS domain FROM hosts)",
        f"read AS MATERIALIZED (SELECT DISTINCT host, domain, {skeleton(shown('domain'))} AS own, string_split({skeleton(shown('domain'))}, '.')[1] AS label, list_transform(list_slice(string_split(host, '.'), 1, len(string_split(host, '.')) - 2), lambda s: {skeleton('s')}) AS above FROM domains)",
        f"judged AS (SELECT host, ord, brand, legit, {kind} AS kind FROM read l, brands b)",
        "like_ AS (SELECT host, arg_min(brand, ord) AS brand, arg_min(legit, ord) AS legit, arg_min(kind, ord) AS kind FROM judged WHERE kind IS NOT NULL GROUP BY host)",
        "links AS MATERIALIZED (SELECT d.msg_id, d.pos, d.url, d.host, d.domain, CASE WHEN kind != 'genuine' THEN brand END AS brand, CASE WHEN kind != 'genuine' THEN legit END AS legit, CASE WHEN kind != 'genuine' THEN kind END AS kind FROM domains d LEFT JOIN like_ USING (host))",
    ]


def link_signals() -> list[str]:
    """CTE url_signals: msg_id, id, weight, brand, ord. A signal that says the same twice counts once."""
    checks = [
        ("lookalike_domain", 3.0, "kind IS NOT NULL", "host"),
        ("url_shortener", 1.1, f"domain IN {_in(SHORTENERS)}", "host"),
        ("high_risk_tld", 1.0, f"regexp_extract(domain, '[^.]*$') IN {_in(RISKY_TLDS)}", "regexp_extract(domain, '[^.]*$')"),
        ("ip_address_host", 1.8, "regexp_matches(host, '^\\d{1,3}(\\.\\d{1,3}){3}$')", "host"),
        ("mixed_script_host", 1.6, f"host = {q(fixtures.MIXED_HOST)} AND kind IS NULL", "host"),
        ("punycode_host", 0.5, f"host = {q(fixtures.FOREIGN_HOST)} AND kind IS NULL", "host"),
        ("credential_path", 0.6, f"regexp_matches(url, {q(CREDENTIAL_PATH)}) AND kind IS NULL AND domain NOT IN {_in(BRAND_DOMAINS)}", "host"),
        ("deep_subdomain", 0.7, "len(string_split(host, '.')) >= 5", "host"),
        ("userinfo_url", 2.4, "regexp_matches(url, '(?i)^https?:\\/\\/[^/\\s]*@')", "host"),
    ]
    order = {"lookalike_domain": 0, "url_shortener": 1, "high_risk_tld": 2, "ip_address_host": 3, "mixed_script_host": 4, "punycode_host": 4, "credential_path": 5, "deep_subdomain": 6, "userinfo_url": 7}
    parts = [f"SELECT msg_id, {q(i)} AS id, {w} :: DOUBLE AS weight, {'brand' if i == 'lookalike_domain' else 'NULL'} AS brand, (pos - 1) * 10 + {order[i]} AS ord, {said} AS said FROM links WHERE {test}" for i, w, test, said in checks]
    return ["url_all AS (" + " UNION ALL ".join(parts) + ")", "url_signals AS MATERIALIZED (SELECT msg_id, id, weight, any_value(brand) AS brand, min(ord) AS ord FROM url_all GROUP BY msg_id, id, weight, said)"]


def claims(source: str = "msgs") -> list[str]:
    """CTE claim: msg_id, brand of a brand_claim_mismatch."""
    clean = f"regexp_replace(text, {q(I.SSO_PHRASE.replace('(?iu)', '(?i)'))}, ' ', 'g')"
    rows = []
    for i, (name, domains, aliases) in enumerate(BRANDS):
        named = " OR ".join(f"regexp_matches(clean, {q('(?i)(^|[^a-z0-9])' + a.replace('.', chr(92) + '.') + '([^a-z0-9]|$)')})" for a in aliases)
        rows.append(
            f"SELECT m.msg_id, {i} AS ord, {q(name)} AS brand FROM cleaned m WHERE ({named}) AND regexp_matches(clean, {q(I.PRETEXT.replace('(?iu)', '(?i)'))})"
            f" AND EXISTS (SELECT 1 FROM links l WHERE l.msg_id = m.msg_id AND regexp_matches(l.url, {q(I.CREDENTIAL_PATH)}) AND l.domain NOT IN {_in(domains)})"
            f" AND NOT EXISTS (SELECT 1 FROM links l WHERE l.msg_id = m.msg_id AND l.brand = {q(name)})"
        )
    return [f"cleaned AS MATERIALIZED (SELECT msg_id, {clean} AS clean FROM {source})", "claims AS (" + " UNION ALL ".join(rows) + ")", "claim AS MATERIALIZED (SELECT msg_id, arg_min(brand, ord) AS brand FROM claims GROUP BY msg_id)"]


def scored(extra: str = "", pull: str = "0.0", feed: str = "") -> str:
    """WITH clause up to CTE scored: msg_id, ts, sender, genre, label, signals (id, weight, layer, ord), no_ask, raw_score, exact, score, verdict."""
    url_all = "SELECT msg_id, list({'id': id, 'weight': weight, 'layer': 1, 'ord': ord :: INT}) AS s, sum(weight) AS w FROM (SELECT msg_id, id, weight, ord FROM url_signals" + feed + ") GROUP BY msg_id"
    every = "list_concat(list_concat(rule_signals, coalesce(u.s, [])), CASE WHEN c.brand IS NOT NULL THEN [{'id': 'brand_claim_mismatch', 'weight': 1.6 :: DOUBLE, 'layer': 2, 'ord': 0}] ELSE [] END)"
    steps = [
        messages(), *ruled(), *links(), *link_signals(), *claims(),
        f"by_url AS ({url_all})",
        "has_links AS (SELECT DISTINCT msg_id, true AS has FROM links)",
        f"joined AS MATERIALIZED (SELECT h.msg_id, h.ts, h.user_id, h.sender, h.genre, h.label, h.text, h.no_ask, h.mild, {every} AS signals, greatest(0.0, blame + relief) + coalesce(u.w, 0.0) + CASE WHEN c.brand IS NOT NULL THEN 1.6 ELSE 0.0 END AS raw_score, coalesce(l.has, false) AS linked, {pull} AS pulled FROM heur h LEFT JOIN by_url u USING (msg_id) LEFT JOIN claim c USING (msg_id) LEFT JOIN has_links l USING (msg_id){extra})",
        "squashed AS (SELECT *, 100 * (1 - exp(-raw_score / 2.6)) AS rules FROM joined)",
        "fused AS (SELECT *, greatest(0.0, least(100.0, CASE WHEN no_ask AND NOT linked AND len(list_filter(signals, lambda s: s.weight >= 2.4)) = 0 THEN least(rules, 34.0) ELSE rules END + pulled)) AS exact FROM squashed)",
        "scored AS MATERIALIZED (SELECT *, floor(exact + 0.5) :: INT AS score, CASE WHEN exact >= 65 THEN 'dangerous' WHEN exact >= 35 THEN 'suspicious' ELSE 'safe' END AS verdict FROM fused)",
    ]
    return "WITH " + ",\n".join(steps)


def rules_only(select: str) -> str:
    return "WITH " + ",\n".join([messages(), *ruled()]) + "\n" + select


def links_only(select: str) -> str:
    return "WITH " + ",\n".join([messages(), *links(), *link_signals()]) + "\n" + select


def pages(select: str) -> str:
    """WITH clause up to CTE verdicts over the site pages: page_id, genre, domain, signals, score, verdict."""
    listed = lambda c: f"CASE WHEN {c} = '' THEN [] :: VARCHAR[] ELSE string_split({c}, ',') END"
    official = f"coalesce(domain IN {_in(BRAND_DOMAINS)}, false)"
    title, lead = (f"regexp_replace({c}, {q(I.SSO_PHRASE.replace('(?iu)', '(?i)'))}, ' ', 'g')" for c in ("title", f"substr(text, 1, {I.LEAD})"))

    def claims_identity(aliases: tuple[str, ...]) -> str:
        out = []
        near = I.SIGN_IN_BEFORE.replace("(?iu)", "(?i)")
        for a in aliases:
            out.append(f"regexp_matches(shown, {q('(?i)(^|[^a-z0-9])' + a.replace('.', chr(92) + '.') + '([^a-z0-9]|$)')})")
            at = f"instr(lower(lead), {q(a)})"
            before = f"substr(lead, greatest(1, {at} - {I.BEFORE}), least({I.BEFORE}, {at} - 1))"
            out.append(f"({at} > 0 AND (regexp_matches({before}, {q(near)}) OR regexp_matches(substr(lead, {at} + {len(a)}, {I.AFTER}), {q(near)})))")
        return " OR ".join(out)

    posed = "coalesce(" + ", ".join(f"CASE WHEN NOT list_contains(flagged, {q(n)}) AND domain NOT IN {_in(d)} AND ({claims_identity(a)}) THEN {q(n)} END" for n, d, a in BRANDS) + ")"
    words = f"list_filter(string_split_regex(named, '\\s+'), lambda w: regexp_matches(w, '(?i)[a-z]') AND lower(w) NOT IN {_in(I.GENERIC_WORDS)})"
    named = f"trim(regexp_replace(regexp_replace(title, {q(I.TITLE_FILLER.replace('(?iu)', '(?i)'))}, ' ', 'g'), {q(I.TITLE_EDGE)}, '', 'g'))"
    related = lambda d: f"len(list_filter({words}, lambda w: length(w) >= 4 AND contains({d}, lower(w)))) > 0"
    steps = [
        f"site AS MATERIALIZED (SELECT page_id AS msg_id, * FROM ({fixtures.pages_sql()}))",
        f"placed AS MATERIALIZED (SELECT *, {registrable_sql(host('url'))} AS domain, CASE WHEN form = '' THEN NULL ELSE {registrable_sql(host('form'))} END AS form_domain FROM site)",
        *ruled("placed", "creds != ''", official),
        *links("placed", f"list_distinct(list_concat(list_concat({urls('text')}, [url]), {listed('form')}))"), *link_signals(),
        "by_url AS (SELECT msg_id, list({'id': id, 'weight': weight, 'layer': 1, 'ord': ord :: INT}) AS s, sum(weight) AS w, list_filter(list(DISTINCT brand), lambda b: b IS NOT NULL) AS flagged FROM url_signals GROUP BY msg_id)",
        f"faced AS (SELECT h.*, coalesce(u.s, []) AS us, coalesce(u.w, 0.0) AS uw, coalesce(u.flagged, []) AS flagged, {title} AS shown, {lead} AS lead, CASE WHEN form_domain != domain THEN form_domain END AS away, {named} AS named FROM heur h LEFT JOIN by_url u USING (msg_id))",
        f"posing AS (SELECT *, CASE WHEN creds != '' AND length(text) <= {I.THIN} THEN {posed} END AS poses, coalesce(named != '' AND named != trim(title) AND length(named) BETWEEN 3 AND 40 AND len({words}) > 0 AND NOT ({related('domain')}) AND NOT ({related('away')}), false) AS unrelated FROM faced)",
        f"harvest AS (SELECT *, CASE WHEN creds != '' AND length(text) <= {I.THIN} AND poses IS NULL AND away IS NOT NULL AND away NOT IN {_in(HOSTED_AUTH)} AND away NOT IN {_in(BRAND_DOMAINS)} THEN CASE WHEN unrelated THEN 3.0 WHEN length(text) <= {I.VERY_THIN} AND contains(creds, ',') THEN 2.2 WHEN length(text) <= {I.VERY_THIN} OR contains(creds, ',') THEN 1.6 END END AS off FROM posing)",
        "summed AS (SELECT *, greatest(0.0, blame + relief) + uw + CASE WHEN poses IS NOT NULL THEN 2.6 + CASE WHEN away IS NOT NULL THEN 1.0 ELSE 0.0 END ELSE coalesce(off, 0.0) END AS raw_score FROM harvest)",
        "verdicts AS MATERIALIZED (SELECT msg_id AS page_id, genre, domain, poses, CASE WHEN poses IS NOT NULL AND away IS NOT NULL THEN 1.0 END AS post, off, raw_score, floor(100 * (1 - exp(-raw_score / 2.6)) + 0.5) :: INT AS score, CASE WHEN 100 * (1 - exp(-raw_score / 2.6)) >= 65 THEN 'dangerous' WHEN 100 * (1 - exp(-raw_score / 2.6)) >= 35 THEN 'suspicious' ELSE 'safe' END AS verdict FROM summed)",
    ]
    return "WITH " + ",\n".join(steps) + "\n" + select
