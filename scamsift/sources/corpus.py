"""A labelled corpus from mail folders and from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import EMAIL

MIN_CHARS, MAX_CHARS = 40, 1200


def clean_mail(text: Column) -> Column:
    """Mail text without markup, quoted lines and addresses, on one line, cut at 1200 characters."""
    t = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]{1,2000}>", " ")
    for _ in range(2):  # entities are often escaped twice
        for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"(?m)^>.*$", " ")
    t = F.regexp_replace(t, EMAIL, "<email>")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, MAX_CHARS)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages (path, subject, body) of mbox files, which are cut at their ``From `` lines while they are read, also large ones by several tasks."""
    files = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    each = files.select("path", F.regexp_replace("value", r"^[^\n]*\n?", "").alias("m")).where(F.trim("m") != "")
    head, body = F.split("m", r"\r?\n\r?\n", 2)[0], F.coalesce(F.get(F.split("m", r"\r?\n\r?\n", 2), F.lit(1)), F.lit(""))
    return each.select("path", F.regexp_extract(head, r"(?im)^Subject:[ \t]*([^\r\n]*)", 1).alias("subject"), body.alias("body"))


def harvest(messages: DataFrame, label: int, quota: int, seed: int = 42) -> DataFrame:
    """Distinct cleaned messages (text, label), at most ``quota``, in a seeded order. The quota is the feature."""
    text = clean_mail(F.concat_ws(" ", "subject", "body"))
    rows = messages.select(text.alias("text")).where(F.length("text") >= MIN_CHARS).withColumn("sha1", F.sha1("text")).dropDuplicates(["sha1"])
    return rows.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), "sha1"))).limit(quota).select("text", F.lit(label).alias("label"))


def from_templates(spark: SparkSession, templates: list[tuple[str, int]], values: dict[str, list[str]], n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct rows at most (text, label) of templates with ``{name}`` fields, drawn by a hash of the row number."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(y).alias("y")) for t, y in templates])
    pick = lambda xs, salt: F.get(xs, F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.size(xs)).cast("int"))
    rows = spark.range(3 * n).select("id", pick(table, "template").alias("r"))
    text = F.col("r.t")
    for name, options in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), pick(F.array(*map(F.lit, options)), name))
    first = rows.select("id", text.alias("text"), F.col("r.y").alias("label")).withColumn("k", F.row_number().over(W.partitionBy("text").orderBy("id"))).where("k = 1")
    return first.orderBy("id").limit(n).select("text", "label")
