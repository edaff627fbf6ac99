"""Queries and SQL of the orphan-reference operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import orphans
from veristrata.session import table


def _pairs(spark: SparkSession, d: str):
    return orphans.store_references(*(table(spark, d, t) for t in ("sources", "evidence", "claims", "peer_groups", "evaluations")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (orphans.found(refs, targets) for _, _, refs, targets in _pairs(spark, d)))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("tab", "field", "reason", "period").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ref_id").alias("n_ids"))


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """The counts' own report: keys referred to now that no record holds now."""
    out = []
    for tab, field, refs, targets in _pairs(spark, d):
        now = orphans.current_orphans(orphans.merge_counts(orphans.deltas(refs, targets)))
        out.append(now.select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col("key").alias("ref_id"), "refs"))
    return reduce(DataFrame.unionByName, out)


_TRIM = r"regexp_replace({}, '^[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_FORM = f"nullif(lower({_TRIM}), '')"

_BASE = f"""
WITH ref_rows AS (
  SELECT 'evidence' AS tab, 'source_id' AS field, id AS row_id, {_FORM.format('source_id')} AS key, recorded_at FROM evidence
  UNION ALL SELECT 'evaluations', 'subject_id', id, {_FORM.format('subject_id')}, recorded_at FROM evaluations
  UNION ALL SELECT 'evaluations', 'attested_by', id, {_FORM.format('piece')}, recorded_at
    FROM (SELECT id, recorded_at, unnest(string_split(attested_by, ',')) AS piece FROM evaluations)
), refs AS (
  SELECT tab, field, row_id, key, min(recorded_at) AS t FROM ref_rows WHERE key IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL
), records AS (
  SELECT 'source_id' AS field, {_FORM.format('id')} AS key, min(recorded_at) AS arrival, min(removed_at) AS removed FROM sources GROUP BY ALL
  UNION ALL SELECT 'subject_id', {_FORM.format('id')}, min(recorded_at), min(removed_at) FROM claims GROUP BY ALL
  UNION ALL SELECT 'attested_by', {_FORM.format('id')}, min(recorded_at), min(removed_at) FROM peer_groups GROUP BY ALL
), found AS (
  SELECT refs.tab, refs.field, refs.row_id, refs.key AS ref_id,
    CASE WHEN records.key IS NULL THEN 'missing' WHEN arrival > t THEN 'late' WHEN removed <= t THEN 'deleted' END AS reason,
    strftime(t, '%Y-%m') AS period
  FROM refs LEFT JOIN records USING (field, key)
)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_current": p3_current}
ORACLES = {
    "p3_found": _BASE + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p3_report": _BASE + "SELECT tab, field, reason, period, count(*) AS n_rows, count(DISTINCT ref_id) AS n_ids FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_current": _BASE + """
SELECT refs.tab, refs.field, refs.key AS ref_id, count(*) AS refs FROM refs LEFT JOIN records USING (field, key)
WHERE records.key IS NULL OR removed IS NOT NULL GROUP BY ALL""",
}
