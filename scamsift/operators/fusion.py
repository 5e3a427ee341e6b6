"""Fusion of rule score and model into one verdict, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .rules import total

# Thresholds of the fused score.
DANGEROUS_AT, SUSPICIOUS_AT = 65, 35
ESCALATE_FROM, ESCALATE_TO = 25, 80
MAX_PULL, MAX_PULL_PAGE = 50.0, 22.0
CONCLUSIVE_AT, MIN_KNOWN_TERMS, CURVE = 2.4, 3, 2.6
NO_ASK_CAP = SUSPICIOUS_AT - 1
REASON_KEY = 60
# Characters of a message that a second opinion reads, and reasons that it gives.
OPINION_CHARS, OPINION_REASONS = 12_000, 3


def squash(raw: Column) -> Column:
    return 100 * (1 - F.exp(-raw / CURVE))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def pull(probability: Column, available: Column, is_page: Column) -> Column:
    return F.when(F.coalesce(available, F.lit(False)), (probability - 0.5) * 2 * F.when(is_page, MAX_PULL_PAGE).otherwise(MAX_PULL)).otherwise(0.0)


def verdict(score: Column) -> Column:
    return F.when(score >= DANGEROUS_AT, "dangerous").when(score >= SUSPICIOUS_AT, "suspicious").otherwise("safe")


def rounded(score: Column) -> Column:
    return F.floor(score + 0.5).cast("int")


def fuse(raw: Column, signals: Column, no_ask: Column, has_links: Column, pulled: Column) -> Column:
    """The fused score. A text that asks for nothing, has no link and no conclusive signal stays below suspicion by rules alone."""
    rules = squash(raw)
    capped = no_ask & ~has_links & ~F.exists(signals, lambda s: s["weight"] >= CONCLUSIVE_AT)
    return clamp(F.when(capped, F.least(rules, F.lit(float(NO_ASK_CAP)))).otherwise(rules) + pulled)


def ordered(signals: Column) -> Column:
    """Signals by weight, heaviest first; ties by layer and then by rule."""
    keyed = F.transform(signals, lambda s: F.struct((-s["weight"]).alias("k"), s["layer"].alias("l"), s["ord"].alias("o"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def should_escalate(score: Column, verdict_: Column, reasons: Column) -> Column:
    return score.between(ESCALATE_FROM, ESCALATE_TO) | ((verdict_ != "safe") & (F.size(reasons) == 0))


def opinion_requests(verdicts: DataFrame, key: str = "msg_id", text: str = "text") -> DataFrame:
    """What a second opinion is asked: key, the start of the text, the local score and the details of the local signals, for unsure messages."""
    return verdicts.where("escalate").select(key, F.substring(F.col(text), 1, OPINION_CHARS).alias("text"), "score", F.transform("reasons", lambda r: r["detail"]).alias("signals"))


def merge_opinions(verdicts: DataFrame, opinions: DataFrame, key: str = "msg_id") -> DataFrame:
    """Verdicts with second opinions (key, score, explanation, reasons, advice, failed, sent) where there are any.

    A second opinion's score wins, held to 0 to 100 and 0 if it is no number, but a dangerous
    verdict with reasons stays dangerous. Its first three reasons come first; of reasons that
    begin alike the first stays. A failed opinion leaves the verdict and says whether the
    message was sent.
    """
    o = opinions.select(F.col(key), F.lit(True).alias("o_there"), *[F.col(c).alias(f"o_{c}") for c in ("score", "explanation", "reasons", "advice", "failed", "sent")])
    joined = verdicts.join(o, key, "left")
    failed = F.coalesce("o_failed", F.lit(False))
    there = F.coalesce("o_there", F.lit(False)) & ~failed
    theirs = rounded(clamp(F.coalesce(F.nanvl(F.col("o_score").cast("double"), F.lit(0.0)), F.lit(0.0))))
    score = F.when((F.size("reasons") > 0) & (F.col("score") >= DANGEROUS_AT), F.greatest(theirs, F.lit(DANGEROUS_AT))).otherwise(theirs)
    shape = joined.schema["reasons"].dataType.elementType
    new = F.transform(F.slice(F.coalesce("o_reasons", F.array().cast("array<string>")), 1, OPINION_REASONS), lambda d: F.struct(*[(F.lit("second_opinion") if f.name == "id" else d if f.name == "detail" else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]))
    start = lambda r: F.lower(F.substring(r["detail"], 1, REASON_KEY))
    alike = lambda r: lambda b: start(b) == start(r)
    merged = let(F.concat(new, F.col("reasons")), lambda every: F.filter(every, lambda r, i: (i == 0) | ~F.exists(F.slice(every, 1, F.greatest(i, F.lit(1))), alike(r))))
    out = joined.withColumn("score", F.when(there, score).otherwise(F.col("score"))).withColumn("reasons", F.when(there, merged).otherwise(F.col("reasons")))
    out = out.withColumn("verdict", F.when(there, verdict(F.col("score"))).otherwise(F.col("verdict")))
    out = out.withColumn("tier", F.when(there, "second-opinion").when(failed, "second-opinion-failed").otherwise("local")).withColumn("reached", F.when(failed, F.coalesce("o_sent", F.lit(False))))
    return out.withColumn("explanation", F.when(there, F.coalesce("o_explanation", F.lit("")))).withColumn("advice", F.when(there, F.coalesce("o_advice", F.lit("")))).drop(*[c for c in o.columns if c != key])


def describe_tier(tier: Column, reached: Column, shortener_resolved: Column) -> Column:
    """One sentence on where a message was checked."""
    followed = F.when(F.coalesce(shortener_resolved, F.lit(False)), " A shortened link was followed to where it leads.").otherwise("")
    where = (
        F.when(tier == "second-opinion", "Checked locally and confirmed by a second opinion.")
        .when((tier == "second-opinion-failed") & F.coalesce(reached, F.lit(False)), "Checked locally; the message was sent out but no verdict came back.")
        .when(tier == "second-opinion-failed", "Checked locally; the second opinion couldn't be reached.")
        .otherwise("Checked locally.")
    )
    return F.concat(where, followed)


__all__ = ["squash", "clamp", "pull", "verdict", "rounded", "fuse", "ordered", "should_escalate", "merge_opinions", "describe_tier", "total"]
