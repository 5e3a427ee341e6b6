"""TF-IDF with logistic regression: training, weights as a table, scoring within the row."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import fold, ngrams, tokens
from .fusion import MIN_KNOWN_TERMS

TOP_TERMS = 5


@dataclass(frozen=True)
class Weights:
    """``terms``: term, idx, idf, coef; at most ``max_features`` rows, so it may be broadcast."""

    terms: DataFrame
    intercept: float
    ngram_max: int = 2


def terms_of(text: Column, ngram_max: int = 2, folded: bool = True, unicode: bool = True) -> Column:
    """Terms of a text. At inference the text is folded with its digits kept; in training it is only lower-cased."""
    return ngrams(tokens(fold(text, digits=False, unicode=unicode) if folded else text), ngram_max)


def vocabulary(docs: DataFrame, text: str = "text", min_df: int = 3, max_features: int = 6000, ngram_max: int = 2) -> DataFrame:
    """Terms in at least ``min_df`` rows, the most frequent ones (ties by term), with idf. Columns: term, idx, df, tf, idf."""
    n = docs.count()
    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col(text).alias("t"))
    each = rows.select("d", F.explode(terms_of(F.col("t"), ngram_max, folded=False)).alias("term"))
    counts = each.groupBy("d", "term").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("tf"))
    kept = counts.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)
    idx = (F.row_number().over(W.orderBy("term")) - 1).cast("int")  # at most max_features rows
    return kept.select("term", idx.alias("idx"), "df", "tf", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


def fit(docs: DataFrame, text: str = "text", label: str = "label", min_df: int = 3, max_features: int = 6000, ngram_max: int = 2, max_iter: int = 1000) -> Weights:
    """Balanced L2 logistic regression on L2-normed TF-IDF. Rows with a null text or label are left out."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label")).dropna()
    vocab = vocabulary(rows, "text", min_df, max_features, ngram_max).orderBy("idx").collect()  # at most max_features rows
    spark = docs.sparkSession
    if not vocab:
        return Weights(spark.createDataFrame([], "term string, idx int, idf double, coef double"), 0.0, ngram_max)
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], inputCol="terms", outputCol="tf")
    counted = counter.transform(rows.withColumn("terms", terms_of(F.col("text"), ngram_max, folded=False)))
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="tf", outputCol="tfidf").transform(counted)
    normed = Normalizer(inputCol="tfidf", outputCol="features").transform(scaled)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    weight = F.lit(1.0)
    for value, count in sizes.items():
        weight = F.when(F.col("label") == value, n / (len(sizes) * count)).otherwise(weight)
    model = LogisticRegression(maxIter=max_iter, regParam=1 / n, elasticNetParam=0.0, standardization=False, weightCol="w").fit(normed.withColumn("w", weight))
    table = [(r["term"], r["idx"], float(r["idf"]), float(c)) for r, c in zip(vocab, model.coefficients.toArray(), strict=True)]
    return Weights(spark.createDataFrame(table, "term string, idx int, idf double, coef double"), float(model.intercept), ngram_max)


MODEL = "struct<probability:double,known_terms:int,matched_terms:array<struct<term:string,weight:double>>,available:boolean>"


class Scorer:
    """Scores lists of terms; ``table`` has idf and coefficient of each known term."""

    def __init__(self, table: dict[str, tuple[float, float]], intercept: float):
        self.table, self.intercept = table, intercept

    def one(self, terms: Iterable[str]) -> dict:
        found = Counter(t for t in terms if t in self.table)
        parts = [(n * self.table[t][0], self.table[t][1], t) for t, n in found.items()]
        norm = math.sqrt(sum(v * v for v, _, _ in parts))
        z = self.intercept + (sum(v * c for v, c, _ in parts) / norm if norm else 0.0)
        up = sorted((-v * c, t) for v, c, t in parts if c > 0)[:TOP_TERMS]
        matched = [{"term": t, "weight": -k / norm} for k, t in up]
        return {"probability": 1 / (1 + math.exp(-z)) if z > -700 else 0.0, "known_terms": len(parts), "matched_terms": matched, "available": len(parts) >= MIN_KNOWN_TERMS}

    def __call__(self, lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([self.one(x) for x in lists], columns=["probability", "known_terms", "matched_terms", "available"])


def judged(text: Column, weights: Weights, unicode: bool = True) -> Column:
    """The model's view of a text: a struct (probability, known_terms, matched_terms, available).

    Known terms weigh count times idf over the norm of the text's vector. The five terms
    that raise the score most are listed. With fewer than three known terms the model
    abstains. The weights, at most ``max_features`` rows, go along with the plan: a text is
    scored within its row, in Arrow batches, without a shuffle.
    """
    scorer = Scorer({r["term"]: (r["idf"], r["coef"]) for r in weights.terms.select("term", "idf", "coef").collect()}, weights.intercept)
    return F.pandas_udf(lambda lists: scorer(lists), MODEL)(terms_of(text, weights.ngram_max, unicode=unicode))


def score(docs: DataFrame, weights: Weights, key: str = "msg_id", text: str = "text", unicode: bool = True) -> DataFrame:
    """``key`` and model (see ``judged``) for every row."""
    return docs.select(key, judged(F.col(text), weights, unicode).alias("model"))


def save(weights: Weights, path: str) -> None:
    """Weights to six decimals, without dropping any (their norm would change)."""
    w = weights.terms.select("term", "idx", F.round("idf", 6).alias("idf"), F.round("coef", 6).alias("coef"))
    w.withColumns({"intercept": F.lit(round(weights.intercept, 6)), "ngram_max": F.lit(weights.ngram_max)}).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Weights:
    rows = spark.read.parquet(path)
    first = rows.select("intercept", "ngram_max").first()
    return Weights(rows.drop("intercept", "ngram_max"), *(first if first else (0.0, 2)))


def describe(weights: Weights, **more) -> dict:
    """Metadata of a model: sizes and whatever the caller adds (training time, accuracy)."""
    return {"vocab_size": weights.terms.count(), "ngram_max": weights.ngram_max, "intercept": weights.intercept} | more


__all__ = ["Weights", "vocabulary", "fit", "score", "save", "load", "describe", "terms_of", "judged"]
