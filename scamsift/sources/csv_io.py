"""CSV for people: guarded cells on the way out, comment blocks on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .feed import sized

# Export columns in order.
HISTORY_COLUMNS = ("timestamp", "verdict", "score", "sender", "source", "tier", "text", "explanation")
MARK = "﻿"


def guard(text: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def cell(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    flat = F.array_join(column.cast("array<string>"), " | ") if isinstance(df.schema[name].dataType, T.ArrayType) else column.cast("string")
    return guard(F.coalesce(flat, F.lit("")))


def lines(df: DataFrame, columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Every row as one CSV record (column ``value``): all cells quoted, quotes doubled, arrays joined by `` | ``."""
    quoted = [F.concat(F.lit('"'), F.replace(cell(df, c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns or df.columns]
    return df.select(F.concat_ws(",", *quoted).alias("value"))


def header(columns: list[str] | tuple[str, ...]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in columns)


def write_csv(df: DataFrame, path: str, columns: list[str] | tuple[str, ...] | None = None) -> None:
    """A folder of CSV files with CRLF line ends, each with a byte order mark and a header; files are written where the data is."""
    names = list(columns or df.columns)
    out = df.select(*[cell(df, c).alias(f"{MARK}{c}" if i == 0 else c) for i, c in enumerate(names)])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180 records with line ends in cells, by a streaming parser; each file has a header.

    A block of ``#`` lines before the header is passed over, later ones are data. Cells
    beyond the schema are dropped, missing ones are null.
    """
    fields = T.StructType.fromDDL(schema).fields
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))])
    read = spark.read.schema(texts).options(multiLine=True, quote='"', escape='"', header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxColumns=20480)
    rows = read.csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # A file is read by one task in order, so its header is the first row that is no comment.
    first = F.ltrim(F.regexp_replace(F.coalesce("c0", F.lit("")), f"^{MARK}", ""))
    heads = rows.where(~first.startswith("#") & ((first != "") | F.lit(len(fields) > 1) & F.col(f"c{len(fields) - 1}").isNotNull())).groupBy("file").agg(F.min("at").alias("head"))
    data = rows.join(sized(heads), "file").where("at > head")
    return data.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def labelled(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "text string, label int")


def held_out(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "genre string, text string")
