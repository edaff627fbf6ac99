"""Normal forms, relations between claims and reports on recorded verdicts, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import mining, reports, search, verdicts
from veristrata.operators.records import records
from veristrata.plans.audit_queries import _STORE
from veristrata.plans.text_queries import QUESTION
from veristrata.session import table


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.normalised(table(spark, d, "claims"))


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.scopes(table(spark, d, "claim_evidence"), table(spark, d, "evidence"))


def tokens_per_claim(spark, d):
    return _norm(spark, d).select("claim_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def stems(spark, d):
    """stem, n: places of every stem in all claims."""
    return _norm(spark, d).select(F.explode(F.split("seq", " ")).alias("stem")).where("stem <> ''").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def polarity_counts(spark, d):
    return _norm(spark, d).groupBy(F.coalesce(F.col("polarity").cast("string"), F.lit("unknown")).alias("polarity")).agg(F.count(F.lit(1)).alias("n_claims"))


def normal_forms(spark, d):
    return _norm(spark, d).select("claim_id", "seq", "terms")


def recurring_shapes(spark, d):
    uri = F.get_json_object("meta", "$.source_uri")
    own = records(table(spark, d, "claims"), "text", "meta").select(F.col("id").alias("claim_id"), uri.alias("source"), "text")
    return mining.recurring(own)


def contradictions(spark, d):
    return verdicts.contradictions(_norm(spark, d), _scope(spark, d))


def attestations(spark, d):
    """Peers hold the subject's run anywhere; verdicts and peer groups only look at peers that begin with its first token, as the reference's index does."""
    return verdicts.attestations(_norm(spark, d), anywhere=True)


def supported_claims(spark, d):
    return attestations(spark, d).groupBy(F.col("subject_id").alias("claim_id")).agg(F.count(F.lit(1)).alias("n_peers"))


def verdict_table(spark, d):
    return verdicts.verdicts(*(table(spark, d, t) for t in ("claims", "claim_evidence", "evidence")))


def verdict_counts(spark, d):
    return verdict_table(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n_claims"))


def peer_groups_found(spark, d):
    return verdicts.peer_groups(verdicts.attestations(_norm(spark, d)))


def neighbour_counts(spark, d):
    """Claims with and without another one that shares a term."""
    norm = _norm(spark, d)
    return norm.join(verdicts.with_neighbours(norm), "claim_id", "left").groupBy(F.col("found").isNotNull().alias("has_neighbours")).agg(F.count(F.lit(1)).alias("n_claims"))


def matching_claims(spark, d):
    return verdicts.matching(_norm(spark, d), QUESTION)


def claim_term_stats(spark, d):
    return search.term_stats(_norm(spark, d))


def claim_search(spark, d):
    """claim_id, score of every claim that matches QUESTION."""
    return search.bm25(_norm(spark, d).select("claim_id", "text"), QUESTION, ["claim_id"]).select("claim_id", "score")


def index_stats(spark, d):
    return search.describe(_norm(spark, d).select("claim_id", "text"))


def unevaluated_claims(spark, d):
    """Claims that a resumed evaluation still has to do."""
    done = table(spark, d, "evaluations").select(F.col("subject_id").alias("id"))
    return records(table(spark, d, "claims")).join(done, "id", "left_anti").select(F.col("id").alias("claim_id"))


def evaluated_states(spark, d):
    """relation, state, n: recorded evaluations by the state their subject is in now."""
    held = records(table(spark, d, "evaluations"), "subject_id", "relation").withColumnRenamed("id", "evaluation_id")
    own = records(table(spark, d, "claims"), "state").withColumnRenamed("id", "subject_id")
    return held.join(own, "subject_id").groupBy("relation", "state").agg(F.count(F.lit(1)).alias("n"))


def _store(spark, d):
    return [table(spark, d, t) for t in ("evaluations", "peer_groups", "claims")]


def verdict_pairs(spark, d):
    return reports.verdict_pairs(*_store(spark, d), "contradicted").select("subject_id", "peer_id")


def verdict_containment(spark, d):
    return reports.containment(*_store(spark, d), "attested")


def contradiction_containment(spark, d):
    return reports.containment(*_store(spark, d), "contradicted")


def stratified_pairs(spark, d):
    return reports.stratified(reports.verdict_pairs(*_store(spark, d), "attested"))


def label_crosstab(spark, d):
    """Graded documents by language and mean grade, as a table of labels against strata."""
    labels = table(spark, d, "reading_labels").where("grade BETWEEN 1 AND 5").groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("label"))
    own = table(spark, d, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("none")).alias("stratum"))
    return reports.crosstab(own.join(labels, "doc_id"), [1, 2, 3, 4, 5])


QUERIES = {f.__name__: f for f in (
    tokens_per_claim, stems, polarity_counts, normal_forms, recurring_shapes, contradictions, attestations, supported_claims, verdict_table, verdict_counts, peer_groups_found, neighbour_counts,
    matching_claims, claim_term_stats, claim_search, index_stats, unevaluated_claims, evaluated_states, verdict_pairs, verdict_containment, contradiction_containment, stratified_pairs, label_crosstab,
)}

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_B = "CASE WHEN len({0}) >= 2 AND {0}[-1] = {0}[-2] AND {0}[-1] NOT IN ('a','e','i','o','u','s','l') AND {0}[-1] BETWEEN '!' AND '~' THEN {0}[:-2] "
_E = "WHEN len({0}) >= 4 AND regexp_matches({0}, '(nc|rc|ng|mg)$') THEN {0} || 'e' ELSE {0} END"
_STEM = f"""CASE WHEN len(w) <= 3 THEN w WHEN len(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y'
  WHEN regexp_matches(w, '(ches|shes|sses|xes|zes)$') THEN w[:-3] WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN w[:-2] WHEN len(w) >= 6 AND w LIKE '%ly' THEN w[:-3]
  WHEN len(w) > 5 AND w LIKE '%ing' THEN ({_B.format('w[:-4]')}{_E.format('w[:-4]')})
  WHEN len(w) > 4 AND w LIKE '%ed' THEN ({_B.format('w[:-3]')}WHEN len(w[:-3]) >= 3 AND w[:-3] LIKE '%i' THEN w[:-4] || 'y' {_E.format('w[:-3]')}) ELSE w END"""
_NORM = _STORE + f""", raw AS (SELECT id AS claim_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM c),
norm AS (SELECT claim_id, text, list_filter(ws, lambda w: NOT list_contains({_list(T.FUNCTION_WORDS)}, w)) AS tokens,
  list_transform(list_filter(ws, lambda w: NOT list_contains({_list(T.FUNCTION_WORDS + T.NEGATORS)}, w)), lambda w: {_STEM}) AS sq,
  len(list_distinct(list_filter(ws, lambda w: list_contains({_list(T.NEGATORS)}, w)))) AS negators FROM raw),
n AS (SELECT claim_id, text, tokens, array_to_string(sq, ' ') AS seq, array_to_string(list_sort(list_distinct(sq)), ' ') AS terms,
  CASE negators WHEN 0 THEN false WHEN 1 THEN true END AS polarity FROM norm),
scope AS (SELECT DISTINCT claim_id, source_id FROM ce JOIN e ON e.id = ce.evidence_id WHERE source_id IS NOT NULL),
con AS (SELECT DISTINCT a.claim_id AS subject_id, b.claim_id AS peer_id FROM n a JOIN n b ON a.terms = b.terms AND a.terms <> '' AND a.polarity <> b.polarity
  JOIN scope x ON x.claim_id = a.claim_id JOIN scope y ON y.claim_id = b.claim_id AND y.source_id = x.source_id),
att AS (SELECT a.claim_id AS subject_id, b.claim_id AS peer_id FROM n a JOIN n b ON split_part(a.seq, ' ', 1) = split_part(b.seq, ' ', 1) AND a.seq <> '' AND a.seq <> b.seq
  AND contains(' ' || b.seq || ' ', ' ' || a.seq || ' ') AND NOT contains(b.text, regexp_replace(a.text, '^\\s+|\\s+$', '', 'g'))),
terms AS (SELECT claim_id, unnest(list_distinct(tokens)) AS term FROM n),
near AS (SELECT DISTINCT claim_id FROM terms WHERE term IN (SELECT term FROM terms GROUP BY term HAVING count(*) > 1)),
ver AS (SELECT claim_id, CASE WHEN claim_id IN (SELECT subject_id FROM con) THEN 'contradicted' WHEN claim_id IN (SELECT subject_id FROM att) THEN 'attested' ELSE 'inconclusive' END AS relation FROM n)
"""
_ANYWHERE = """, anywhere AS (SELECT a.claim_id AS subject_id, b.claim_id AS peer_id FROM n a JOIN (SELECT DISTINCT claim_id, text, seq, unnest(string_split(seq, ' ')) AS word FROM n) b ON split_part(a.seq, ' ', 1) = b.word
  AND a.seq <> '' AND a.seq <> b.seq AND contains(' ' || b.seq || ' ', ' ' || a.seq || ' ') AND NOT contains(b.text, regexp_replace(a.text, '^\\s+|\\s+$', '', 'g')))
"""
_PAIRS = _STORE + """, pairs AS (SELECT DISTINCT subject_id, c.text AS subject_text, member AS peer_id, p.text AS peer_text, relation FROM named JOIN m USING (group_id)
  JOIN c ON c.id = subject_id JOIN c p ON p.id = member WHERE kind = relation AND member <> subject_id)
"""
_GROUP = "'agr-' || sha256('veristrata/v1' || chr(0) || '{\"members\":[' || array_to_string(list_transform(list_sort(list_distinct(list(peer_id))), lambda x: '\"' || x || '\"'), ',') || ']}')"
_STRIP = "regexp_replace({}, '^[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')"
_CONTAINED = _PAIRS + """, per AS (SELECT subject_id, len({strip}) AS n_chars, bool_and(contains(peer_text, {strip})) AS contained FROM pairs WHERE relation = '{relation}' GROUP BY subject_id, subject_text)
SELECT count(*) AS n_subjects, count(*) FILTER (WHERE contained) AS n_contained, count(*) FILTER (WHERE n_chars <= 40) AS n_short, count(*) FILTER (WHERE n_chars <= 40 AND contained) AS n_short_contained,
  list_sort(list(n_chars))[count(*) // 2 + 1] AS median_chars FROM per"""
_SCORE = f"""SELECT claim_id, round(score, 6) AS score FROM (
  SELECT claim_id, sum(ln((nn - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT claim_id, len(tokens) AS dl, q.term, len(list_filter(tokens, lambda w: w = q.term)) AS tf FROM n, (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+'), lambda w: NOT list_contains({_list(T.FUNCTION_WORDS)}, w)))) AS term) q)
  JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) USING (term), (SELECT count(*) AS nn, avg(coalesce(len(tokens), 0)) FILTER (WHERE tokens IS NOT NULL) AS avgdl FROM n)
  WHERE tf > 0 GROUP BY claim_id) WHERE score > 0"""

ORACLES = {
    "tokens_per_claim": _NORM + "SELECT claim_id, CAST(coalesce(len(tokens), -1) AS INT) AS n_tokens FROM n",
    "stems": _NORM + "SELECT stem, count(*) AS n FROM (SELECT unnest(string_split(seq, ' ')) AS stem FROM n) WHERE stem <> '' GROUP BY stem",
    "polarity_counts": _NORM + "SELECT coalesce(CAST(polarity AS VARCHAR), 'unknown') AS polarity, count(*) AS n_claims FROM n GROUP BY 1",
    "normal_forms": _NORM + "SELECT claim_id, seq, terms FROM n",
    "recurring_shapes": r"""WITH own AS (SELECT DISTINCT id, text, meta FROM claims WHERE id IS NOT NULL),
x AS (SELECT trim(regexp_replace(regexp_replace(lower(text), '[-.,;:!?"''`()\[\]{}—–*…]', ' ', 'g'), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS shape, json_extract_string(meta, '$.source_uri') AS source FROM own)
SELECT shape, count(DISTINCT source) AS n_sources, CAST(count(*) AS BIGINT) AS n_claims FROM x WHERE shape <> '' AND source IS NOT NULL GROUP BY shape HAVING count(DISTINCT source) >= 3""",
    "contradictions": _NORM + "SELECT subject_id, peer_id FROM con",
    "attestations": _NORM + _ANYWHERE + "SELECT subject_id, peer_id FROM anywhere",
    "supported_claims": _NORM + _ANYWHERE + "SELECT subject_id AS claim_id, count(*) AS n_peers FROM anywhere GROUP BY 1",
    "verdict_table": _NORM + f""", pe AS (SELECT subject_id, peer_id FROM con UNION ALL SELECT subject_id, peer_id FROM att WHERE subject_id NOT IN (SELECT subject_id FROM con)),
gr AS (SELECT subject_id, CAST(count(DISTINCT peer_id) AS INT) AS n_peers, {_GROUP} AS group_id FROM pe GROUP BY subject_id)
SELECT claim_id, relation, coalesce(n_peers, 0) AS n_peers, group_id, claim_id IN (SELECT claim_id FROM near) AS has_neighbours FROM ver LEFT JOIN gr ON subject_id = claim_id""",
    "verdict_counts": _NORM + "SELECT relation, count(*) AS n_claims FROM ver GROUP BY relation",
    "peer_groups_found": _NORM + f"SELECT DISTINCT {_GROUP} AS id, '[' || array_to_string(list_transform(list_sort(list_distinct(list(peer_id))), lambda x: '\"' || x || '\"'), ',') || ']' AS members, CAST(count(DISTINCT peer_id) AS INT) AS size FROM att GROUP BY subject_id",
    "neighbour_counts": _NORM + "SELECT claim_id IN (SELECT claim_id FROM near) AS has_neighbours, count(*) AS n_claims FROM n GROUP BY 1",
    "matching_claims": _NORM + f"SELECT claim_id FROM n WHERE list_has_any(tokens, list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+'), lambda w: NOT list_contains({_list(T.FUNCTION_WORDS)}, w)))",
    "claim_term_stats": _NORM + "SELECT term, df, tf FROM (SELECT term, count(*) AS df FROM terms GROUP BY term) JOIN (SELECT unnest(tokens) AS term, count(*) AS tf FROM n GROUP BY 1) USING (term)",
    "claim_search": _NORM + _SCORE,
    "index_stats": _NORM + "SELECT count(*) AS n_texts, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, (SELECT count(DISTINCT term) FROM terms) AS n_terms, round(avg(len(tokens)), 6) AS mean_length FROM n",
    "unevaluated_claims": _STORE + "SELECT id AS claim_id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.subject_id = c.id)",
    "evaluated_states": _STORE + "SELECT relation, state, count(*) AS n FROM v JOIN c ON c.id = v.subject_id GROUP BY ALL",
    "verdict_pairs": _PAIRS + "SELECT subject_id, peer_id FROM pairs WHERE relation = 'contradicted'",
    "verdict_containment": _CONTAINED.format(strip=_STRIP.format("subject_text"), relation="attested"),
    "contradiction_containment": _CONTAINED.format(strip=_STRIP.format("subject_text"), relation="contradicted"),
    "label_crosstab": """WITH l AS (SELECT doc_id, CAST(round(avg(grade)) AS INT) AS label FROM reading_labels WHERE grade BETWEEN 1 AND 5 GROUP BY doc_id)
SELECT coalesce(doc_kind, 'none') AS stratum, count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2, count(*) FILTER (WHERE label = 3) AS label_3,
  count(*) FILTER (WHERE label = 4) AS label_4, count(*) FILTER (WHERE label = 5) AS label_5, count(*) AS n FROM documents JOIN l USING (doc_id) GROUP BY 1""",
}
