"""Questions answered with cited spans, or with a record of what was searched for in vain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import audit, search
from veristrata.operators.records import records


def ask(question: str, claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, sources: DataFrame, limit: int = 5) -> DataFrame:
    """claim_id, score, text, citation, verified of the best claims, best first.

    The best claims are few, so spans are resolved and verified for them only. A claim without evidence has no citation.
    """
    own = records(claims, "text").withColumnRenamed("id", "claim_id")
    best = search.bm25(own, question, ["claim_id"]).limit(limit)
    links = claim_evidence.join(F.broadcast(best.select("claim_id")), "claim_id", "left_semi")  # at most limit ids
    uris = records(sources, "uri").withColumnRenamed("id", "source_id")
    spans = audit.spans(links, evidence, sources).join(uris, "source_id")
    cited = spans.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s[%d:%d]", "uri", "start_offset", "end_offset"))), " ").alias("citation"), F.bool_and("ok").alias("verified"))
    return best.join(cited, "claim_id", "left").select("claim_id", "score", "text", "citation", F.coalesce("verified", F.lit(False)).alias("verified")).orderBy(F.desc("score"), "claim_id")


def absence(question: str, created_at: str, claims: DataFrame) -> DataFrame:
    """An investigation (id, question, searched, created_at) where no claim shares a term with the question; no row otherwise.

    The time isn't part of the id: asking again in vain is the same investigation.
    """
    spark = claims.sparkSession
    asked = F.array_sort(F.array_distinct(T.tokens(F.lit(question))))
    hits = claims.where(F.arrays_overlap(T.tokens(F.col("text")), asked)).limit(1).agg(F.count(F.lit(1))).scalar()
    json = F.concat(F.lit('{"question":'), T.json_string(F.lit(question)), F.lit(',"searched":'), T.json_array(asked), F.lit("}"))
    return spark.range(1).where(hits == 0).select(T.content_id("inv-", json).alias("id"), F.lit(question).alias("question"), asked.alias("searched"), F.lit(created_at).alias("created_at"))


def boundary(claims: DataFrame, sources: DataFrame, investigations: DataFrame) -> DataFrame:
    """One row: n_claims, n_sources, n_absences: what the answers can be drawn from."""
    count = lambda df: records(df).agg(F.count(F.lit(1))).scalar()
    return claims.sparkSession.range(1).select(count(claims).alias("n_claims"), count(sources).alias("n_sources"), count(investigations).alias("n_absences"))


def unknown_citations(cited: DataFrame, known: DataFrame) -> DataFrame:
    """claim_id of citations that name no known record."""
    return cited.select("claim_id").distinct().join(known.select(F.col("id").alias("claim_id")), "claim_id", "left_anti")
