"""BM25 over texts.

Defined cases. Texts without terms count in the number of texts and in the mean length; a mean length of 0 counts as 1.
A question without terms matches nothing. Scores are rounded to 6 places and ordered by score, then key; nothing is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.session import written

K1, B = 1.5, 0.75


def term_stats(texts: DataFrame) -> DataFrame:
    """term, df, tf: texts that hold the term and its places in all."""
    words = texts.select(T.tokens(F.col("text")).alias("words"))
    per_text = words.select(F.posexplode("words").alias("at", "term"), "words").select("term", (F.array_position("words", F.col("term")) == F.col("at") + 1).alias("first"))
    return per_text.groupBy("term").agg(F.count_if("first").alias("df"), F.count(F.lit(1)).alias("tf"))


def bm25(texts: DataFrame, question: str, order: list[str]) -> DataFrame:
    """The columns of texts and score, for every text with a score above 0.

    One pass over the texts: statistics of all of them are observed while the few that hold a term are written.
    """
    spark = texts.sparkSession
    terms = spark.range(1).select(T.terms(T.tokens(F.lit(question))).alias("t")).first()["t"]
    counts = [F.size("_words") - F.size(F.array_remove("_words", t)) for t in terms]
    held = texts.withColumn("_words", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))).select(*texts.columns, F.size("_words").alias("_dl"), F.array(*counts).cast("array<int>").alias("_tf"))
    seen = Observation()
    facts = [F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("mean"), *(F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms)))]
    matched = written(held.observe(seen, *facts).where(F.exists("_tf", lambda n: n > 0)), "matched-texts")
    n, length = seen.get.get("n", 0), seen.get.get("mean") or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, idf = F.col("_tf")[i], math.log((n - seen.get.get(f"df{i}", 0) + 0.5) / (seen.get.get(f"df{i}", 0) + 0.5) + 1)
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / length))
    return matched.withColumn("_raw", score).where("_raw > 0").orderBy(F.desc("_raw"), *order).select(*texts.columns, F.round("_raw", 6).alias("score"))


def describe(texts: DataFrame) -> DataFrame:
    """n_texts, n_tokens, n_terms, mean_length of the index over texts, in one row."""
    words = texts.select(T.tokens(F.col("text")).alias("words"))
    whole = words.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("words")).alias("n_tokens"), F.round(F.avg(F.when(F.col("words").isNotNull(), F.size("words"))), 6).alias("mean_length"))
    terms = words.select(F.explode("words").alias("term")).distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    return whole.withColumn("n_terms", terms.scalar())
