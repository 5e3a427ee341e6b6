"""Evaluation over labelled rows (label 1: scam) with verdict, score and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import SUSPICIOUS_AT, squash

# Limits that rates must keep, in percent.
GATES = {"fp_rate": 1.5, "dangerous_rate": 0.6, "miss_rate": 3.0, "indic_miss_rate": 5.0, "indic_fp_rate": 5.0}
HELD_OUT_GATES = {"fp_rate": 6.0, "dangerous_rate": 0.0, "pages_flagged_rate": 0.0, "miss_rate": 65.0}

FLAGGED = "verdict != 'safe'"


def script(text: Column) -> Column:
    return F.when(text.rlike("[\\u0900-\\u097F]"), "devanagari").otherwise("latin")


def _rate(hit: Column, of: Column) -> Column:
    return F.coalesce(100.0 * F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """Percent of legitimate rows flagged (fp_rate) and called dangerous, and of scams missed, per group if asked."""
    flagged, legit, scam = F.expr(FLAGGED), F.col("label") == 0, F.col("label") == 1
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _rate(flagged, legit).alias("fp_rate"), _rate(F.col("verdict") == "dangerous", legit).alias("dangerous_rate"), _rate(~flagged, scam).alias("miss_rate")
    )


def flagged_pages(rows: DataFrame) -> DataFrame:
    """One row: percent of harmless pages that are flagged (pages_flagged_rate)."""
    return rows.agg(_rate(F.expr(FLAGGED), F.lit(True)).alias("pages_flagged_rate"))


def gates(measured: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per gate: name, rate, limit, passed."""
    named = {k: v for k, v in (limits or GATES).items() if k in measured.columns}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("rate"), F.lit(float(v)).alias("limit")) for k, v in named.items()]))
    return measured.select(each.alias("g")).select("g.*").withColumn("passed", F.col("rate") <= F.col("limit"))


def worst(rows: DataFrame, key: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """False alarms with the highest scores, and misses with the lowest: reports of ``n`` rows."""
    alarms = rows.where(f"label = 0 and {FLAGGED}").orderBy(F.desc("score"), key).limit(n)
    return alarms, rows.where("label = 1 and verdict = 'safe'").orderBy("score", key).limit(n)


def by_genre(rows: DataFrame) -> DataFrame:
    """Per genre: total, flagged, dangerous; most flagged first."""
    counts = rows.groupBy("genre").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(FLAGGED)).alias("flagged"), F.count_if(F.col("verdict") == "dangerous").alias("dangerous"))
    return counts.orderBy(F.desc("flagged"), "genre")


def solo_fires(rows: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    """Per rule: rows in which it fired, and in which it alone fired and sufficed; with ceilings (rule_id, ceiling), whether it keeps its own."""
    alone = (F.size("signals") == 1) & (squash(F.get("signals", F.lit(0))["weight"]) >= SUSPICIOUS_AT)
    each = rows.select(alone.alias("alone"), F.explode("signals.id").alias("rule_id"))
    counts = each.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fires"), F.count_if("alone").alias("solo"))
    if ceilings is None:
        return counts
    joined = counts.join(ceilings, "rule_id", "left").withColumn("ceiling", F.coalesce("ceiling", F.lit(0)))
    return joined.withColumn("passed", F.col("solo") <= F.col("ceiling"))


def signals_histogram(rows: DataFrame) -> DataFrame:
    """Rows by number of signals and label."""
    return rows.groupBy(F.size("signals").alias("n_signals")).pivot("label", [0, 1]).count().fillna(0)


def confusion(rows: DataFrame, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy of a 0/1 prediction."""
    p, y = predicted == 1, F.col("label") == 1
    counts = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    out = rows.agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.count(F.lit(1)).alias("n"))
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))


def cross_validate(rows: DataFrame, folds: int = 5, **options) -> list[float]:
    """Accuracy in each of ``folds`` folds of the model of ``operators.model``; rows go to folds by a hash of their text."""
    from . import model

    dealt = rows.withColumn("__f", F.pmod(F.xxhash64("text"), F.lit(folds)))
    out = []
    for k in range(folds):
        weights = model.fit(dealt.where(F.col("__f") != k), **options)
        held = dealt.where(F.col("__f") == k)
        scored = held.withColumn("model", model.judged(F.col("text"), weights))
        out.append(confusion(scored, (F.col("model.probability") >= 0.5).cast("int")).first()["accuracy"])
    return out
