"""Audit and dependency queries over the store's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import audit, graph
from veristrata.operators.records import records
from veristrata.session import table

_STORE = """
WITH s AS (SELECT DISTINCT id, uri, source_type, checksum, content FROM sources WHERE id IS NOT NULL),
e AS (SELECT DISTINCT id, source_id, start_offset, end_offset, text FROM evidence WHERE id IS NOT NULL),
c AS (SELECT DISTINCT id, text, state, investigation_id FROM claims WHERE id IS NOT NULL),
ce AS (SELECT DISTINCT claim_id, evidence_id FROM claim_evidence),
v AS (SELECT DISTINCT id, subject_id, relation, attested_by, contradicted_by FROM evaluations WHERE id IS NOT NULL),
named AS (SELECT DISTINCT id, relation, subject_id, kind, trim(g) AS group_id FROM (
  SELECT id, relation, subject_id, 'attested' AS kind, unnest(string_split(attested_by, ',')) AS g FROM v
  UNION ALL SELECT id, relation, subject_id, 'contradicted', unnest(string_split(contradicted_by, ',')) FROM v) WHERE trim(g) <> ''),
g AS (SELECT DISTINCT id, members FROM peer_groups WHERE id IS NOT NULL),
m AS (SELECT DISTINCT id AS group_id, unnest(CASE WHEN members LIKE '[%' THEN CAST(members AS VARCHAR[]) END) AS member FROM g),
spans AS (SELECT ce.claim_id, ce.evidence_id, e.source_id, start_offset, end_offset, substr(content, start_offset + 1, end_offset - start_offset) AS span, e.text
  FROM ce JOIN e ON e.id = ce.evidence_id JOIN s ON s.id = e.source_id),
deps AS (SELECT DISTINCT member AS support, subject_id AS dependent FROM named JOIN m USING (group_id) WHERE kind = 'attested' AND relation = 'attested' AND subject_id IS NOT NULL)
"""
_FREE = "('unexamined', 'assumed', 'derived', 'unresolved')"
_ENDED, _LIVE = "('retracted', 'invalidated', 'superseded')", "('supported', 'derived', 'validated')"


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def source_checksums(spark, d):
    return audit.checksums(*_t(spark, d, "sources"))


def audit_source_checksums(spark, d):
    return source_checksums(spark, d).where("NOT ok").select("id", "checksum")


def span_verification(spark, d):
    return audit.spans(*_t(spark, d, "claim_evidence", "evidence", "sources")).select("claim_id", "evidence_id", "source_id", "ok")


def evidence_for(spark, d):
    """claim_id, evidence_id, source_id, start_offset, end_offset of every claim's evidence."""
    links, evidence = _t(spark, d, "claim_evidence", "evidence")
    held = records(evidence, "source_id", "start_offset", "end_offset").withColumnRenamed("id", "evidence_id")
    return links.select("claim_id", "evidence_id").distinct().join(held, "evidence_id").select("claim_id", "evidence_id", "source_id", "start_offset", "end_offset")


def citations(spark, d):
    """claim_id, citation (uri[start:end]) of every verified span."""
    uris = records(table(spark, d, "sources"), "uri").withColumnRenamed("id", "source_id")
    found = audit.spans(*_t(spark, d, "claim_evidence", "evidence", "sources")).where("ok").join(uris, "source_id")
    return found.select("claim_id", F.format_string("%s[%d:%d]", "uri", "start_offset", "end_offset").alias("citation"))


def first_sources(spark, d):
    """claim_id, source_id: the source of each claim's first evidence by id."""
    return evidence_for(spark, d).groupBy("claim_id").agg(F.min_by("source_id", "evidence_id").alias("source_id"))


def audit_span_mismatches(spark, d):
    return span_verification(spark, d).where("NOT ok").select("claim_id", "evidence_id")


def audit_claim_texts(spark, d):
    return audit.text_mismatches(*_t(spark, d, "claims", "claim_evidence", "evidence", "sources"))


def audit_dangling_edges(spark, d):
    return audit.dangling_edges(*_t(spark, d, "claim_evidence", "evidence", "sources"))


def audit_orphans(spark, d):
    return audit.orphans(*_t(spark, d, "claims", "claim_evidence"))


def audit_unresolved_absence(spark, d):
    return audit.unresolved_absence(*_t(spark, d, "claims", "claim_evidence"))


def audit_unresolved_without_investigation(spark, d):
    return audit.unresolved_without_investigation(*_t(spark, d, "claims", "investigations"))


def audit_state_without_evaluation(spark, d):
    return audit.state_without_evaluation(*_t(spark, d, "claims", "evaluations"))


def audit_missing_groups(spark, d):
    return audit.missing_groups(*_t(spark, d, "evaluations", "peer_groups"))


def audit_empty_groups(spark, d):
    return audit.empty_groups(*_t(spark, d, "evaluations", "peer_groups"))


def audit_missing_members(spark, d):
    return audit.missing_members(*_t(spark, d, "evaluations", "peer_groups", "claims"))


def dependencies(spark, d):
    return graph.dependencies(*_t(spark, d, "evaluations", "peer_groups"))


def dependents(spark, d):
    return graph.dependents(dependencies(spark, d))


def audit_stale_dependents(spark, d):
    return audit.stale_dependents(table(spark, d, "claims"), dependencies(spark, d))


def dangling_support(spark, d):
    return graph.dangling(table(spark, d, "claims"), dependencies(spark, d), audit.ENDED, audit.LIVE)


def revision_closure(spark, d):
    return graph.revision(table(spark, d, "claims"), dependencies(spark, d))


CHECKS = (
    audit_source_checksums, audit_span_mismatches, audit_claim_texts, audit_dangling_edges, audit_orphans, audit_unresolved_without_investigation,
    audit_state_without_evaluation, audit_missing_groups, audit_empty_groups, audit_missing_members, audit_stale_dependents,
)


def audit_summary(spark, d):
    return audit.summary({f.__name__.removeprefix("audit_"): f(spark, d) for f in CHECKS})


QUERIES = {f.__name__: f for f in (source_checksums, span_verification, evidence_for, citations, first_sources, audit_unresolved_absence, *CHECKS, dependencies, dependents, dangling_support, revision_closure, audit_summary)}

_BODY = {
    "source_checksums": "SELECT id, checksum, sha256(content) AS computed, coalesce(sha256(content) = checksum, false) AS ok FROM s",
    "span_verification": "SELECT claim_id, evidence_id, source_id, coalesce(span = text, false) AS ok FROM spans",
    "evidence_for": "SELECT claim_id, evidence_id, source_id, start_offset, end_offset FROM ce JOIN e ON e.id = ce.evidence_id",
    "citations": "SELECT claim_id, uri || '[' || start_offset || ':' || end_offset || ']' AS citation FROM spans JOIN s ON s.id = spans.source_id WHERE span = spans.text",
    "first_sources": "SELECT claim_id, arg_min(source_id, evidence_id) AS source_id FROM ce JOIN e ON e.id = ce.evidence_id GROUP BY claim_id",
    "audit_unresolved_absence": "SELECT id AS claim_id FROM c WHERE state = 'unresolved' AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.claim_id = c.id)",
    "audit_source_checksums": "SELECT id, checksum FROM s WHERE NOT coalesce(sha256(content) = checksum, false)",
    "audit_span_mismatches": "SELECT claim_id, evidence_id FROM spans WHERE NOT coalesce(span = text, false)",
    "audit_claim_texts": "SELECT claim_id, CAST(n AS INT) AS n_spans FROM (SELECT claim_id, count(*) AS n, string_agg(span, '' ORDER BY start_offset, end_offset, span) AS j FROM spans GROUP BY claim_id) JOIN c ON c.id = claim_id WHERE j IS DISTINCT FROM c.text",
    "audit_dangling_edges": "SELECT claim_id, evidence_id FROM ce JOIN e ON e.id = ce.evidence_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = e.source_id)",
    "audit_orphans": f"SELECT id AS claim_id, state FROM c WHERE state NOT IN {_FREE} AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.claim_id = c.id)",
    "audit_unresolved_without_investigation": "SELECT c.id AS claim_id, investigation_id FROM c WHERE state = 'unresolved' AND NOT EXISTS (SELECT 1 FROM investigations i WHERE i.id = c.investigation_id)",
    "audit_state_without_evaluation": f"SELECT id AS claim_id, state FROM c WHERE state NOT IN {_FREE} AND NOT EXISTS (SELECT 1 FROM v WHERE v.subject_id = c.id)",
    "audit_missing_groups": "SELECT id AS evaluation_id, kind, group_id FROM named WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = group_id)",
    "audit_empty_groups": "SELECT named.id AS evaluation_id, kind, group_id FROM named JOIN g ON g.id = group_id WHERE relation IN ('attested', 'contradicted') AND (members IS NULL OR trim(members) IN ('[]', 'null', ''))",
    "audit_missing_members": "SELECT DISTINCT named.id AS evaluation_id, member AS missing_claim FROM named JOIN m USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = member)",
    "audit_stale_dependents": f"SELECT id AS claim_id, state FROM c WHERE state IN {_LIVE} AND id IN (SELECT id FROM reached)",
    "dependencies": "SELECT support, dependent FROM deps",
    "dependents": "SELECT support, count(*) AS n_dependents FROM deps GROUP BY support",
    "dangling_support": f"SELECT support, dependent FROM deps JOIN c a ON a.id = support JOIN c b ON b.id = dependent WHERE a.state IN {_ENDED} AND b.state IN {_LIVE}",
}
_REACHED = f", reached AS (SELECT id FROM c WHERE state IN {_ENDED} UNION SELECT dependent FROM reached JOIN deps ON deps.support = reached.id)"
_RECURSIVE = _STORE.replace("WITH s", "WITH RECURSIVE s")


def _with(name: str) -> str:
    return _RECURSIVE + _REACHED + _BODY[name] if "reached" in _BODY[name] else _STORE + _BODY[name]


ORACLES = {name: _with(name) for name in _BODY}
_COUNTED = [f"SELECT '{f.__name__.removeprefix('audit_')}' AS check_name, count(*) AS n_found FROM ({_BODY[f.__name__]})" for f in CHECKS]
ORACLES["audit_summary"] = _RECURSIVE + _REACHED + ", n AS (" + " UNION ALL ".join(_COUNTED) + ") SELECT * FROM n UNION ALL SELECT 'clean', CAST(max(n_found) = 0 AS BIGINT) FROM n"
ORACLES["revision_closure"] = _RECURSIVE + f""", fallen AS (
  SELECT id, 0 AS level FROM c WHERE state IN {_ENDED}
  UNION
  SELECT dependent, level + 1 FROM fallen JOIN deps ON deps.support = fallen.id JOIN c ON c.id = fallen.id
  WHERE level < 40 AND (level = 0 OR c.state NOT IN {_ENDED})
), first AS (SELECT id, min(level) AS level FROM fallen GROUP BY id)
SELECT first.id AS claim_id, level, CASE WHEN state IN ('retracted', 'superseded') THEN 'refused' WHEN state = 'invalidated' THEN 'already' ELSE 'moved' END AS outcome
FROM first JOIN c ON c.id = first.id WHERE level > 0"""
