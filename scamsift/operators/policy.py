"""Sender lists, history, counters and display limits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import truncate
from ..sources.feed import sized

# Limits of what is kept and shown.
HISTORY_ROWS, HISTORY_SHOWN, SHOWN_CHARS, PAGE_CHARS = 500, 100, 52, 1000
REASONS_INLINE, REASONS_POPUP, EMAILS_SHOWN = 4, 5, 6
RANKS = {"safe": 0, "suspicious": 1, "dangerous": 2}
COLOURS = {"dangerous": "red", "suspicious": "amber", "safe": "none"}


@dataclass(frozen=True)
class Settings:
    """Options of a scoring run, with their defaults."""

    auto_scan: bool = True
    min_severity: str = "suspicious"
    use_model: bool = True
    use_feed: bool = False
    resolve_shorteners: bool = False
    second_opinion: bool = False
    keep_history: bool = True
    allowlist: tuple[str, ...] = field(default=())
    blocklist: tuple[str, ...] = field(default=())
    genuine_first: bool = False

    def merged(self, stored: dict) -> Settings:
        """These settings with stored ones over them; unknown names are passed over."""
        return replace(self, **{k: v for k, v in stored.items() if k in self.__dataclass_fields__})


def sender_key(sender: Column) -> Column:
    return F.lower(F.trim(F.coalesce(sender, F.lit(""))))


def sender_list(senders: DataFrame, column: str = "sender") -> DataFrame:
    return senders.select(sender_key(F.col(column)).alias("sender")).where("sender != ''").distinct()


def add_senders(listed: DataFrame, more: DataFrame) -> DataFrame:
    return sender_list(listed.select("sender").union(more.select("sender")))


def remove_senders(listed: DataFrame, gone: DataFrame) -> DataFrame:
    return sender_list(listed).join(sender_list(gone), "sender", "left_anti")


def gate(messages: DataFrame, allowed: DataFrame, blocked: DataFrame) -> DataFrame:
    """``messages`` with gate: ``allow`` (skipped, checked first), ``block`` (dangerous, 100) or ``score``."""
    rows = messages.withColumn("__s", sender_key(F.col("sender")))
    a = sized(sender_list(allowed)).select(F.col("sender").alias("__s"), F.lit(True).alias("__a"))
    b = sized(sender_list(blocked)).select(F.col("sender").alias("__s"), F.lit(True).alias("__b"))
    rows = rows.join(a, "__s", "left").join(b, "__s", "left")
    return rows.withColumn("gate", F.when(F.col("__a"), "allow").when(F.col("__b"), "block").otherwise("score")).drop("__s", "__a", "__b")


def rank(verdict: Column) -> Column:
    out = F.lit(0)
    for name, r in RANKS.items():
        out = F.when(verdict == name, r).otherwise(out)
    return out


def at_least(rows: DataFrame, severity: str) -> DataFrame:
    return rows.where(rank(F.col("verdict")) >= RANKS[severity])


def history(scans: DataFrame, time: str = "timestamp", order: str = "msg_id", keep: int = HISTORY_ROWS, old: DataFrame | None = None) -> DataFrame:
    """The history that these scans leave: one entry per (text, sender) at the place of its first scan with what its
    last scan said; only the last ``keep`` places stay. Columns of ``scans``, ``first`` (when and in which order the
    entry came first) and ``position`` (0: oldest kept). ``old`` is a history to go on from.

    First and last scans come from one aggregate; only ``keep`` rows reach the final numbering.
    """
    rows = scans.withColumns({"text": F.when(F.coalesce("source", F.lit("")) == "page", F.substring("text", 1, PAGE_CHARS)).otherwise(F.col("text")), "sender": F.coalesce("sender", F.lit(""))})
    at = F.struct(F.col(time).alias("t"), F.col(order).alias("o"))
    others = [c for c in rows.columns if c not in ("text", "sender", "first", "position")]
    rows = rows.select("text", "sender", *others, at.alias("first"))
    if old is not None:
        rows = rows.unionByName(old.select(*[c for c in rows.columns if c in old.columns]), allowMissingColumns=True)
    merged = rows.groupBy("text", "sender").agg(F.min("first").alias("first"), F.max_by(F.struct(*others), at).alias("last"))
    newest = merged.orderBy(F.desc("first"), "text", "sender").limit(keep)
    position = (F.row_number().over(W.orderBy("first", F.desc("text"), F.desc("sender"))) - 1).alias("position")
    return newest.select("text", "sender", "last.*", "first", position)


def history_view(entries: DataFrame) -> DataFrame:
    """The newest entries first, with shortened texts."""
    newest = entries.orderBy(F.desc("position")).limit(HISTORY_SHOWN)
    return newest.withColumn("text", truncate(F.col("text"), SHOWN_CHARS))


def counters(verdicts: DataFrame) -> DataFrame:
    """One row: scanned, flagged, second_opinions (attempts, failed ones too). Blocked senders don't count."""
    own = verdicts.where("gate = 'score'") if "gate" in verdicts.columns else verdicts
    asked = F.count_if(F.col("tier") != "local") if "tier" in verdicts.columns else F.lit(0)
    return own.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("verdict") != "safe").alias("flagged"), asked.cast("long").alias("second_opinions"))


def badges(verdicts: DataFrame, tab: str) -> DataFrame:
    """Per tab: how many messages were flagged, by severity, and the colour of the worst."""
    counts = verdicts.groupBy(tab).agg(F.count_if(F.col("verdict") == "dangerous").alias("dangerous"), F.count_if(F.col("verdict") == "suspicious").alias("suspicious"))
    colour = F.when(F.col("dangerous") > 0, COLOURS["dangerous"]).when(F.col("suspicious") > 0, COLOURS["suspicious"]).otherwise(COLOURS["safe"])
    return counts.withColumns({"flagged": F.col("dangerous") + F.col("suspicious"), "colour": colour})


def shown_reasons(reasons: Column, n: int = REASONS_INLINE) -> Column:
    return F.slice(reasons, 1, n)


def adopted_sender(sender: Column, emails: Column) -> Column:
    """The typed sender, else the page's first address, else nothing."""
    return F.coalesce(F.when(F.trim(sender) != "", sender), F.get(emails, F.lit(0)), F.lit(""))
