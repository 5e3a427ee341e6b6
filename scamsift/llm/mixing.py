"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by (source, language, topic) cell. The cells are raked: in turn
for each margin they are scaled so that the margin has its target shares, until all three
agree. A document's calibrated probability is its cell's factor times a budget, and it is
taken if a uniform number made from its id lies below. Only DataFrame functions run.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, joined, small

MARGINS = ("source", "lang", "topic")
#: Powers that flatten the corpus's own shares into target shares.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Up to this many pairs of language and topic, their factors are multiplied on the driver; beyond, they stay distributed.
SHORT_MARGINS = 10_000
NONE = "(none)"


# Topics in order, each with the marks that tell it.
TOPICS = {
    "license": ("icensed under", "MIT License"),
    "code": ("();", "return "),
    "config": ("password", "api_key"),
    "markup": ("</", "href="),
    "table": (" | ", "\t"),
    "contact": ("@",),
    "web": ("://", "www."),
    "noise": ("$$$", "!!"),
    "money": ("$", "€"),
    "list": ("\n- ", "\n* "),
    "dialogue": ("“", "\" "),
}
OTHER = "prose"


def topic(text: Column) -> Column:
    """The topic with the most of its marks in the text, the first of several in the order of ``TOPICS``; prose where there is no mark."""
    body = F.coalesce(text, F.lit(""))
    # One array of structs, so that each mark is looked for once: most marks first, then the order; prose beats topics without a mark.
    seen = [F.struct(sum((body.contains(m).cast("int") for m in marks), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, marks) in enumerate(TOPICS.items())]
    return F.array_max(F.array(*seen, F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit(OTHER).alias("name"))))["name"]


def tokens(text: Column) -> Column:
    """Words of a text, at least 1, so that every document has a weight."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def uniform(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of an md5 of the seed and the key; without a key, of the text's own md5."""
    own = F.concat(F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), own)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its token share to a power, scaled to 1. Columns: the margin, share."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("p"))
    total = sums.agg(F.sum("p")).first()[0]
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("share"))


def _lookup(factors: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), key), F.lit(0.0))


class NotConverged(UserWarning):
    """Raking ended before the margins agreed."""


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 200, tolerance: float = 1e-11, short: int = SHORT_MARGINS) -> DataFrame:
    """``cells`` (source, lang, topic, n) with weight: raked counts that add up to 1.

    A margin's value without a target keeps no weight; target shares of values without any
    cell can't be reached and are shared out by the other values. Ends when a sweep moves
    no factor by more than ``tolerance`` of itself, or after ``sweeps`` sweeps, with a warning
    ``NotConverged`` (margins can contradict each other where cells are empty; the last
    margin then holds exactly).

    With up to ``short`` pairs of language and topic their factors are multiplied on the
    driver; with more, all factors stay in tables. The steps and results are the same.
    """
    pairs = cells.select("lang", "topic").distinct()
    return _rake_short(cells, pairs, targets, sweeps, tolerance) if small(pairs, short) else _rake_long(cells, targets, sweeps, tolerance)


def _warn(moved: float, sweeps: int) -> None:
    warnings.warn(f"margins still moved by {moved:.2g} of themselves after {sweeps} sweeps", NotConverged, stacklevel=4)


def _rake_long(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """Any number of values in all margins: a sweep is one sum and one join a margin, written once."""
    want = {}
    for m in MARGINS:
        present = cut(targets[m].select(m, "share").join(cells.select(m).distinct(), m).where("share > 0"))
        total = present.agg(F.sum("share")).first()[0] or 1.0
        want[m] = cut(present.select(m, (F.col("share") / F.lit(total)).alias("share")))
    now = cells.select(*MARGINS, "n", F.col("n").cast("double").alias("weight"))
    moved = 0.0
    for sweep in range(sweeps):
        moved = 0.0
        for m in MARGINS:
            held = now.groupBy(m).agg(F.sum("weight").alias("held"))
            factor = cut(want[m].join(held, m).where("held > 0").select(m, (F.col("share") / F.col("held")).alias("f")))
            now = joined(now, factor, m).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
            if sweep or m != MARGINS[0]:
                moved = max(moved, factor.agg(F.max(F.abs(F.col("f") - 1))).first()[0] or 0.0)
        now = cut(now)
        if sweep and moved <= tolerance:
            return now.select(*MARGINS, "n", "weight")
    _warn(moved, sweeps)
    return now.select(*MARGINS, "n", "weight")


def _rake_short(cells: DataFrame, pairs: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """Few languages and topics: one row a source holds its cells, so its factor is found within the row.

    A sweep is one distributed sum over sources per (language, topic); the factors of
    languages and topics are the only numbers that the driver holds.
    """
    want = {}
    for m in ("lang", "topic"):
        present = targets[m].join(pairs.select(m).distinct(), m).select(m, "share").collect()
        total = sum(r["share"] for r in present) or 1.0
        want[m] = {r[m]: r["share"] / total for r in present}
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "n")).alias("cells"))
    rows = cut(rows.join(targets["source"].select("source", "share"), "source").where("share > 0"))
    total = rows.agg(F.sum("share")).first()[0] or 1.0
    rows = rows.withColumn("share", F.col("share") / F.lit(total))
    factor = {m: dict.fromkeys(want[m], 1.0) for m in want}

    def fitted(known: dict[str, dict[str, float]]) -> DataFrame:
        held = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * _lookup(known["lang"], c["lang"]) * _lookup(known["topic"], c["topic"]))
        return rows.select("source", F.when(held > 0, F.col("share") / held).otherwise(0.0).alias("f"), F.explode("cells").alias("c"))

    before, moved = factor, 0.0
    for _ in range(sweeps if want["lang"] and want["topic"] else 0):
        before = {m: dict(factor[m]) for m in factor}
        sums = fitted(before).groupBy("c.lang", "c.topic").agg(F.sum(F.col("f") * F.col("c.n")).alias("s")).collect()
        for m in ("lang", "topic"):
            held = dict.fromkeys(factor[m], 0.0)
            for r in sums:
                if r[m] in held:
                    held[r[m]] += r["s"] * factor["lang"].get(r["lang"], 0.0) * factor["topic"].get(r["topic"], 0.0)
            factor[m] = {k: f * want[m][k] / held[k] if held[k] > 0 else 0.0 for k, f in factor[m].items()}
        moved = max((abs(f - before[m][k]) / f for m in factor for k, f in factor[m].items() if f), default=0.0)
        if moved <= tolerance:
            break
    else:
        if want["lang"] and want["topic"]:
            _warn(moved, sweeps)
    weight = F.col("f") * F.col("c.n") * _lookup(factor["lang"], F.col("c.lang")) * _lookup(factor["topic"], F.col("c.topic"))
    raked = fitted(before).select("source", "c.lang", "c.topic", "c.n", weight.alias("weight")) if want["lang"] and want["topic"] else rows.select("source", F.explode("cells").alias("c")).select("source", "c.lang", "c.topic", "c.n", F.lit(0.0).alias("weight"))
    return raked


def filled(cells: DataFrame, budget: float, want: float) -> float:
    """The budget at which cells (``n``, ``factor``) yield ``want`` tokens with probabilities capped at 1.

    The expected yield is concave in the budget and made of straight pieces, so Newton's steps
    from below never pass the answer and end on its piece; a step is one sum over the cells.
    Where all tokens of cells with a factor don't suffice, every such cell is taken whole.
    """
    while True:
        p = F.col("factor") * F.lit(budget)
        whole, open_ = cells.agg(F.sum(F.when(p >= 1, F.col("n")).otherwise(0)), F.sum(F.when(p < 1, F.col("n") * F.col("factor")).otherwise(0.0))).first()
        if not open_:
            return budget
        step = (want - whole) / open_
        if step <= budget * (1 + 1e-12):
            return budget
        budget = step


def probabilities(cells: DataFrame, share: float | None = None, least: float = 0.0) -> DataFrame:
    """Raked cells with factor (raked share over own share) and prob.

    ``share`` is the part of all tokens to take; probabilities are capped at 1 and what capped
    cells can't give is spread over the others in proportion to their factors. None takes the
    largest part that needs no capping, so that the sample's expected margins are exact; but
    then the rarest cell sets the size of the whole sample, so that a part below ``least`` is
    raised to ``least``.
    """
    every, top = cells.agg(F.sum("n"), F.max(F.col("weight") / F.col("n"))).first()
    every, top = float(every or 0), top or 1.0
    out = cells.withColumn("factor", F.col("weight") / F.col("n") * F.lit(every))
    budget = 1 / (top * every) if every else 1.0
    if share is None and every and budget < least:
        share = least
    if share is not None and every:
        budget = filled(out, float(share), min(1.0, float(share)) * every)
    return out.withColumn("prob", F.least(F.lit(1.0), F.col("factor") * F.lit(budget))).select(*MARGINS, "n", "factor", "prob")


def describe(docs: DataFrame, text: str = "text") -> list[Column]:
    """The three margins and the tokens of a document, named ``__source``, ``__lang``, ``__topic``, ``__n``; a null source or language is a value of its own."""
    return _described(text, [f"__{m}" for m in MARGINS], "__n")


def _described(text: str, margins: list[str], n: str) -> list[Column]:
    values = [*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)) for c in ("source", "lang")), topic(F.col(f"`{text}`"))]
    return [*(v.alias(m) for v, m in zip(values, margins, strict=True)), tokens(F.col(f"`{text}`")).alias(n)]


def calibrated_cells(described: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, share: float | None = None, least: float = 0.0, short: int = SHORT_MARGINS) -> DataFrame:
    cells = cut(described.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__n").alias("n")))
    targets = targets or {m: tempered(cells, m, p) for m, p in (powers or POWERS).items()}
    return cut(probabilities(cut(rake(cells, targets, short=short)), share, least))


def mix(docs: DataFrame, seed: str = "mix", share: float | None = None, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """Rows ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``factor``, ``prob``, ``sampled`` for all of ``docs``.

    Rows with the same id and text are drawn alike; documents without an id are drawn by
    their texts. Null sources and languages count as ``(none)``, null and empty texts as
    prose of one token. Other columns take no part. An empty table gives no rows.
    """
    rows = cut(docs.select(F.col(f"`{key}`").alias("doc_id"), *describe(docs, text), uniform(F.col(f"`{key}`"), F.col(f"`{text}`"), seed).alias("__u")))
    cells = calibrated_cells(rows, powers, targets, share, least)
    taken = _with_prob(rows, cells, [f"__{m}" for m in MARGINS], "factor", "prob")
    return taken.select("doc_id", *[F.col(f"__{m}").alias(m) for m in MARGINS], F.col("__n").alias("n_tokens"), "factor", "prob", (F.col("__u") < F.col("prob")).alias("sampled"))


def _with_prob(rows: DataFrame, cells: DataFrame, margins: list[str], *names: str) -> DataFrame:
    """Rows with the factor and probability of their cells, joined by their margins spelt as one key."""
    (cell,) = free(rows, "__cell")
    spelt = lambda columns: F.concat_ws("\0", *[x for c in columns for x in (F.length(c).cast("string"), c)])
    side = cells.select(spelt([F.col(m) for m in MARGINS]).alias(cell), *[F.col(c).alias(a) for c, a in zip(("factor", "prob"), names, strict=True)])
    return joined(rows.withColumn(cell, spelt([F.col(m) for m in margins])), side, cell).drop(cell)


def sample(docs: DataFrame, seed: str = "mix", share: float | None = None, powers: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with the columns of ``docs``, whatever their names.

    Nulls, repeated rows and empty tables are treated as in ``mix``. A table without a column
    source or lang can't be mixed.
    """
    cells = calibrated_cells(docs.select(*describe(docs, text)), powers, None, share, least)
    *margins, n, factor, prob = free(docs, *[f"__{m}" for m in MARGINS], "__n", "__factor", "__prob")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_described(text, margins, n)[:-1])
    taken = _with_prob(rows, cells, margins, factor, prob).where(uniform(F.col(f"`{key}`"), F.col(f"`{text}`"), seed) < F.col(prob))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(sweeps: int = 60, seed: str = "mix") -> str:
    """``mix`` with its defaults as DuckDB SQL over ``documents``, raking unrolled to a fixed number of sweeps."""
    body = "coalesce(text, '')"
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    marks = [(name, " + ".join(f"contains(body, {q(m)}) :: INT" for m in own)) for name, own in TOPICS.items()]
    most = f"greatest({', '.join(f'm_{name}' for name in TOPICS)})"
    named = f"CASE WHEN {most} = 0 THEN '{OTHER}' " + " ".join(f"WHEN m_{name} = {most} THEN '{name}'" for name in TOPICS) + " END"
    steps = []
    for m, p in POWERS.items():
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(n) :: DOUBLE, {p}) / sum(pow(sum(n) :: DOUBLE, {p})) OVER () AS share FROM cells GROUP BY {m})")
    steps.append("r0 AS MATERIALIZED (SELECT source, lang, topic, n, n :: DOUBLE AS w FROM cells)")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.n, r.w * t.share / sum(r.w) OVER (PARTITION BY r.{m}) AS w FROM r{k} r JOIN t_{m} t ON r.{m} = t.{m})")
            k += 1
    return f"""
    WITH lows AS (SELECT doc_id, text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {body} AS body FROM documents),
    marked AS (SELECT *, {', '.join(f'{own} AS m_{name}' for name, own in marks)} FROM lows),
    rows AS MATERIALIZED (SELECT doc_id, source, lang, {named} AS topic, greatest(1, len(regexp_extract_all({body}, '[^\\x20\\x09-\\x0D]+'))) :: BIGINT AS n,
      ('0x' || substr(md5('{seed}:' || coalesce(doc_id :: VARCHAR, ':' || md5({body}))), 1, 13)) :: BIGINT / 4503599627370496.0 :: DOUBLE AS u FROM marked),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(n) :: BIGINT AS n FROM rows GROUP BY ALL),
    {', '.join(steps)},
    tops AS (SELECT sum(n) :: DOUBLE AS every, max(w / n) AS top FROM r{k}),
    probs AS (SELECT source, lang, topic, w / n * every AS factor, least(1.0, w / n * every * (1 / (top * every))) AS prob FROM r{k}, tops)
    SELECT doc_id, rows.source, rows.lang, rows.topic, rows.n AS n_tokens, round(factor, 6) AS factor, round(prob, 6) AS prob,
      u < prob AS sampled
    FROM rows JOIN probs USING (source, lang, topic)"""
