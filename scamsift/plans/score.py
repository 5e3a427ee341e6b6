"""The whole plan: messages or pages to verdicts, one row each.

Rules, links, impersonation and the model are computed within the row. Only what needs a
table moves rows: sender lists, feeds and redirects (broadcast when found small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BRAND_DOMAINS
from ..functions.domains import parse_urls
from ..functions.text import once, rule_text, urls
from ..operators import fusion, impersonation, model, policy, rules, url_signals
from ..sources.feed import first_match, redirects

PAGE = "struct<url:string,title:string,text:string,credential_fields:array<string>,form_targets:array<string>>"
OUTPUT = ("verdict", "score", "raw_score", "reasons", "exonerating", "signals", "links", "no_ask", "model", "escalate", "shortener_resolved")


def _prepared(messages: DataFrame) -> DataFrame:
    have = set(messages.columns)
    out = messages.withColumn("text", F.coalesce("text", F.lit("")))
    defaults = {"sender": F.lit(""), "source": F.lit("manual"), "extra_urls": F.array().cast("array<string>"), "page": F.lit(None).cast(PAGE)}
    return out.withColumns({c: F.coalesce(c, d) if c in have and c != "page" else d for c, d in defaults.items() if c not in have or c != "page"})


def score(
    messages: DataFrame,
    weights: model.Weights | None = None,
    feed: DataFrame | None = None,
    redirect_table: DataFrame | None = None,
    key: str = "msg_id",
    unicode: bool = True,
    suffixes: tuple[str, ...] | None = None,
    genuine_first: bool = False,
    confusables: dict[str, str] | None = None,
) -> DataFrame:
    """``messages`` (key, text and, if there, sender, source, extra_urls, page) with the columns of ``OUTPUT``.

    Keys are taken to be distinct. Null texts are empty and safe. ``unicode=False`` leaves
    out decomposition and look-alikes in texts known to be ASCII. Without ``suffixes`` and
    ``confusables`` the whole public lists that come with Spark count.
    """
    rows = _prepared(messages)
    rows = once(rows, __found=F.array_distinct(F.concat(urls(F.col("text")), F.filter("extra_urls", lambda u: u.isNotNull()))))
    if redirect_table is not None:
        rows = rows.join(redirects(rows, redirect_table, key, "__found"), key, "left").withColumn("shortener_resolved", F.col("resolved").isNotNull())
        rows = rows.withColumn("__found", F.array_distinct(F.concat("__found", F.coalesce("resolved", F.array().cast("array<string>"))))).drop("resolved")
    else:
        rows = rows.withColumn("shortener_resolved", F.lit(False))
    is_page = F.coalesce(F.col("page.url") != "", F.lit(False))
    wanted = F.concat(F.col("__found"), F.array(F.when(is_page, F.col("page.url"))), F.when(is_page, F.coalesce("page.form_targets", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    rows = once(rows.withColumn("__page", is_page).withColumn("__parsed", parse_urls(wanted, suffixes, genuine_first, confusables)), __t=rule_text(F.col("text"), unicode, confusables))
    rows = once(rows, links=F.array_distinct(F.filter("__parsed", lambda u: F.array_contains(F.col("__found"), u["url"]))))
    rows = once(rows, __url=url_signals.link_signals(F.col("links")))
    domain_of = lambda url: F.get(F.filter("__parsed", lambda u: u["url"] == url), F.lit(0))["domain"]
    rows = once(rows, __domain=F.when(F.col("__page"), domain_of(F.col("page.url"))))
    rows = once(rows, __forms=F.when(F.col("__page"), F.transform("page.form_targets", lambda u: F.coalesce(domain_of(u), F.lit("")))))
    if feed is not None:
        hits = first_match(rows.select(key, "__found"), feed, key, "__found")
        rows = rows.join(hits, key, "left").withColumn("__url", F.when(F.col("feed_url").isNotNull(), F.concat("__url", F.array(url_signals.feed_signal(F.col("feed_url"))))).otherwise(F.col("__url"))).drop("feed_url")

    credentials = F.coalesce("page.credential_fields", F.array().cast("array<string>"))
    rows = rules.evaluate(rows, "__t", F.col("__page") & (F.size(credentials) > 0), F.coalesce(F.col("__domain").isin(*BRAND_DOMAINS), F.lit(False)), prefix="__rule_")
    rows = once(rows, __flagged=F.array_distinct(F.transform(F.filter("__url", lambda s: s["brand"].isNotNull()), lambda s: s["brand"])))
    flagged = F.col("__flagged")
    if "page" in messages.columns:
        title, body = F.coalesce("page.title", F.lit("")), F.coalesce("page.text", "text")
        rows = once(rows, __clean=impersonation.without_sso(F.col("text")), __title=impersonation.without_sso(title), __lead=impersonation.lead_of(body))
        of_page = impersonation.page_signals(F.col("__domain"), title, F.col("__title"), F.col("__lead"), body, credentials, F.coalesce("__forms", F.array().cast("array<string>")), flagged)
        of_page = F.when(F.col("__domain").isNotNull(), of_page).otherwise(F.array().cast(f"array<{rules.SIGNAL}>"))
        found = F.when(F.col("__page"), of_page).otherwise(impersonation.message_signals(F.col("__clean"), F.col("links"), flagged))
    else:
        rows = once(rows, __clean=impersonation.without_sso(F.col("text")))
        found = impersonation.message_signals(F.col("__clean"), F.col("links"), flagged)
    rows = once(rows, __imp=found)
    rows = once(rows, signals=F.concat("__rule_signals", "__url", "__imp"))
    rows = rows.withColumn("raw_score", F.col("__rule_score") + rules.total(F.col("__url")) + rules.total(F.col("__imp")))

    if weights is not None:
        rows = rows.withColumn("model", model.judged(F.col("text"), weights, unicode))
        pulled = fusion.pull(F.col("model.probability"), F.col("model.available"), F.col("__page"))
    else:
        rows, pulled = rows.withColumn("model", F.lit(None).cast(model.MODEL)), F.lit(0.0)
    exact = fusion.fuse(F.col("raw_score"), F.col("signals"), F.col("no_ask"), F.size("__found") > 0, pulled)
    rows = once(rows, exact_score=exact).withColumn("verdict", fusion.verdict(F.col("exact_score"))).withColumn("score", fusion.rounded(F.col("exact_score")))
    rows = once(rows, reasons=fusion.ordered(F.col("signals"))).withColumn("exonerating", F.col("__rule_exonerating"))
    rows = rows.withColumn("escalate", fusion.should_escalate(F.col("score"), F.col("verdict"), F.col("reasons")))
    return rows.drop("__found", "__page", "__parsed", "__t", "__url", "__domain", "__forms", "__flagged", "__clean", "__title", "__lead", "__rule_signals", "__rule_exonerating", "__rule_score", "__imp")


def analyze(
    messages: DataFrame,
    settings: policy.Settings,
    weights: model.Weights | None = None,
    feed: DataFrame | None = None,
    redirect_table: DataFrame | None = None,
    opinions: DataFrame | None = None,
    key: str = "msg_id",
    **options,
) -> DataFrame:
    """The whole analysis as the settings ask for it: key, gate, verdict, score, reasons, tier and shown.

    Senders on the settings' lists are skipped or blocked. The model, the feed and the
    redirects take part if they are given and switched on; so do second opinions, for
    messages that the local layers are unsure of. ``shown`` says that the verdict reaches
    the least severity that the settings show.
    """
    spark = messages.sparkSession
    listed = lambda names: spark.createDataFrame([(n,) for n in names], "sender string")
    rows = messages if "sender" in messages.columns else messages.withColumn("sender", F.lit(""))
    gated = policy.gate(rows, listed(settings.allowlist), listed(settings.blocklist))
    found = score(
        gated.where("gate = 'score'"), weights if settings.use_model else None, feed if settings.use_feed else None, redirect_table if settings.resolve_shorteners else None, key,
        genuine_first=settings.genuine_first, **options,
    )
    if opinions is not None and settings.second_opinion:
        unsure = found.where("escalate").select(key)
        found = fusion.merge_opinions(found, opinions.join(unsure, key, "left_semi"), key)
    else:
        found = found.withColumn("tier", F.lit("local"))
    found = found.select(key, "gate", "verdict", "score", "reasons", "tier")
    shape = found.schema["reasons"].dataType
    rest = gated.where("gate != 'score'").select(key, "gate", F.when(F.col("gate") == "block", "dangerous").alias("verdict"), F.when(F.col("gate") == "block", 100).cast("int").alias("score"), F.array().cast(shape).alias("reasons"), F.lit("local").alias("tier"))
    shown = F.coalesce(policy.rank(F.col("verdict")) >= policy.RANKS[settings.min_severity], F.lit(False))
    return found.unionByName(rest).withColumn("shown", shown)


def score_pages(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Verdicts for pages collected by ``sources.pages.collected`` (a struct column ``page``)."""
    p = F.col("page")
    rows = pages.select(
        F.col(key), p["text"].alias("text"), F.lit("page").alias("source"), policy.adopted_sender(F.lit(""), p["emails"]).alias("sender"), p["extra_urls"].alias("extra_urls"),
        F.struct(p["url"].alias("url"), p["title"].alias("title"), p["text"].alias("text"), p["credential_fields"].alias("credential_fields"), p["form_targets"].alias("form_targets")).alias("page"),
    )
    return score(rows, key=key, **options)


def scan(messages: DataFrame, allowed: DataFrame, blocked: DataFrame, key: str = "msg_id", **options) -> DataFrame:
    """All messages through the sender lists: allowed ones are skipped, blocked ones dangerous at 100, the rest scored."""
    gated = policy.gate(messages, allowed, blocked)
    scored = score(gated.where("gate = 'score'"), key=key, **options).select(key, "gate", "verdict", "score", "reasons")
    shape = scored.schema["reasons"].dataType
    rest = gated.where("gate != 'score'")
    fixed = rest.select(key, "gate", F.when(F.col("gate") == "block", "dangerous").alias("verdict"), F.when(F.col("gate") == "block", 100).cast("int").alias("score"), F.array().cast(shape).alias("reasons"))
    return scored.unionByName(fixed)
