"""Compiled corpora and answered questions. Documents are the corpus: uri is doc_id, type is source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import ask as asking
from veristrata.operators.compile import Compiled, compile_corpus
from veristrata.plans.text_queries import QUESTION
from veristrata.plans.verdict_queries import _NORM, _SCORE
from veristrata.session import spread, table

#: Fixed value: a question that nothing answers.
UNANSWERED = "quux zyzzyva"


def _compiled(spark: SparkSession, d: str) -> Compiled:
    return compile_corpus(spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.col("text").alias("content"), F.col("source").alias("source_type"))))


def compiled_claims(spark, d):
    return _compiled(spark, d).claims.select("id", "source_uri", "ordinal")


def compiled_evidence(spark, d):
    return _compiled(spark, d).evidence.select("id", "source_id", "start_offset", "end_offset")


def dropped_segments(spark, d):
    return _compiled(spark, d).dropped()


def mined_claims(spark, d):
    return _compiled(spark, d).mined


def unmined_claims(spark, d):
    """Extracted claims that support no mined one."""
    done = _compiled(spark, d)
    return done.claims.select("id").join(done.edges.select(F.col("to_id").alias("id")), "id", "left_anti")


def derived_support(spark, d):
    """id, n_support of every mined claim."""
    done = _compiled(spark, d)
    counts = done.edges.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n_support"))
    return done.mined.select("id").join(counts, "id", "left").select("id", F.coalesce("n_support", F.lit(0)).alias("n_support"))


def _four(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("claims", "claim_evidence", "evidence", "sources")]


def ask(spark, d):
    return asking.ask(QUESTION, *_four(spark, d)).select("claim_id", "score", "citation", "verified")


def absence(spark, d):
    return asking.absence(UNANSWERED, "1970-01-01T00:00:00Z", table(spark, d, "claims"))


def boundary(spark, d):
    return asking.boundary(*(table(spark, d, t) for t in ("claims", "sources", "investigations")))


def unknown_citations(spark, d):
    """Subjects of evaluations that are no claims."""
    return asking.unknown_citations(table(spark, d, "evaluations").where("subject_id IS NOT NULL").select(F.col("subject_id").alias("claim_id")), table(spark, d, "claims"))


QUERIES = {f.__name__: f for f in (compiled_claims, compiled_evidence, dropped_segments, mined_claims, unmined_claims, derived_support, ask, absence, boundary, unknown_citations)}

ORACLES = {
    "ask": _NORM + f""", best AS ({_SCORE} ORDER BY 2 DESC, 1 LIMIT 5),
cited AS (SELECT claim_id, string_agg(uri || '[' || start_offset || ':' || end_offset || ']', ' ' ORDER BY uri || '[' || start_offset || ':' || end_offset || ']') AS citation, bool_and(coalesce(span = spans.text, false)) AS verified
  FROM spans JOIN s ON s.id = spans.source_id GROUP BY claim_id)
SELECT claim_id, score, citation, coalesce(verified, false) AS verified FROM best LEFT JOIN cited USING (claim_id)""",
    "absence": """SELECT 'inv-' || sha256('veristrata/v1' || chr(0) || '{"question":"quux zyzzyva","searched":["quux","zyzzyva"]}') AS id, 'quux zyzzyva' AS question, ['quux', 'zyzzyva'] AS searched, '1970-01-01T00:00:00Z' AS created_at
WHERE NOT EXISTS (SELECT 1 FROM claims WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['quux', 'zyzzyva']))""",
    "boundary": "SELECT (SELECT count(DISTINCT id) FROM claims) AS n_claims, (SELECT count(DISTINCT id) FROM sources) AS n_sources, (SELECT count(DISTINCT id) FROM investigations) AS n_absences",
    "unknown_citations": "SELECT DISTINCT subject_id AS claim_id FROM evaluations WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM claims WHERE id IS NOT NULL)",
}
