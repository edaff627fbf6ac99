"""Sentence shapes that recur across sources.

One hash aggregation by shape. Distinct sources are counted over (shape, source) rows, so a shape that fills a third of
the corpus is pre-aggregated before the shuffle; the claims of a shape are only collected for shapes that are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T

LEAST_SOURCES = 3


def recurring(claims: DataFrame, least: int = LEAST_SOURCES) -> DataFrame:
    """shape, n_sources, n_claims of shapes in ``least`` or more distinct sources, from claims (claim_id, source, text)."""
    shaped = claims.select("source", T.shape(F.col("text")).alias("shape")).where("shape <> '' AND source IS NOT NULL")
    per_source = shaped.groupBy("shape", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("shape").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_claims")).where(F.col("n_sources") >= least)


def heuristics(claims: DataFrame, least: int = LEAST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Mined claims (id, text, shape, n_sources) and their edges (from_id, to_id, relation DERIVED_FROM), one per supporting claim."""
    found = recurring(claims, least)
    quoted = F.concat(F.lit("'"), F.replace(F.col("shape"), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    text = F.concat(F.lit("The sentence shape "), quoted, F.lit(" occurs in "), F.col("n_sources").cast("string"), F.lit(" distinct sources."))
    mined = found.withColumn("text", text).select(T.content_id("clm-", F.concat(F.lit('{"text":'), T.json_string(F.col("text")), F.lit("}"))).alias("id"), "text", "shape", "n_sources")
    support = claims.select(F.col("claim_id").alias("to_id"), T.shape(F.col("text")).alias("shape"))
    return mined, support.join(mined.select(F.col("id").alias("from_id"), "shape"), "shape").select("from_id", "to_id", F.lit("DERIVED_FROM").alias("relation"))
