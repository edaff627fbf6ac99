"""Segment and search queries over documents: uri is doc_id, content is text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import search, segment
from veristrata.session import spread, table

#: Fixed value: the question bm25_search asks.
QUESTION = "which evidence supports the audit of the claim"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Segments and propositions of every document that has segments."""
    return segments(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(T.is_proposition(F.col("text"))).alias("n_propositions"))


def _propositions(spark: SparkSession, d: str) -> DataFrame:
    return segment.propositions(segments(spark, d))


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.term_stats(_propositions(spark, d))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Every proposition that matches QUESTION, with its place and score, best first."""
    return search.bm25(_propositions(spark, d), QUESTION, ["doc_id", "ordinal"])


QUERIES = {f.__name__: f for f in (segments, segment_counts, bm25_term_stats, bm25_search)}
ORACLES: dict[str, str] = {}
