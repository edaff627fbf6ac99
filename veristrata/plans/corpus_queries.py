"""Corpus, digest, region, chain and path queries, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import chain, digests, regions
from veristrata.operators.records import records
from veristrata.plans.audit_queries import _STORE
from veristrata.sources import exports
from veristrata.session import table

STORE_TABLES = ("sources", "evidence", "investigations", "claims", "peer_groups", "evaluations")
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = "regexp_replace({}, '^[" + _SPACE.replace("{", "{{").replace("}", "}}") + "]+|[" + _SPACE.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "sources"), "uri", "source_type", "content")


def corpus_stats_by_type(spark, d):
    return exports.stats(_sources(spark, d))


def speaker_counts(spark, d):
    return _sources(spark, d).groupBy(exports.speaker(F.col("source_type")).alias("speaker")).agg(F.count(F.lit(1)).alias("n_docs"))


def machine_share(spark, d):
    """Claims by who speaks in their source, with the share of all in percent."""
    uri = F.get_json_object("meta", "$.source_uri")
    own = records(table(spark, d, "claims"), "meta").select(uri.alias("uri"))
    types = _sources(spark, d).select("uri", exports.speaker(F.col("source_type")).alias("speaker"))
    counts = own.join(types, "uri").groupBy("speaker").agg(F.count(F.lit(1)).alias("n_claims"))
    whole = counts.agg(F.sum("n_claims")).scalar()
    return counts.select("speaker", "n_claims", F.round(100 * F.col("n_claims") / whole, 1).alias("pct"))


def claims_per_source(spark, d):
    uri = F.get_json_object("meta", "$.source_uri")
    return records(table(spark, d, "claims"), "meta").select(uri.alias("uri")).where("uri IS NOT NULL").groupBy("uri").agg(F.count(F.lit(1)).alias("n_claims"))


def table_counts(spark, d):
    rows = [table(spark, d, t).where("id IS NOT NULL").agg(F.countDistinct("id").alias("n_records")).select(F.lit(t).alias("table_name"), "n_records") for t in STORE_TABLES]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def state_histogram(spark, d):
    return records(table(spark, d, "claims"), "state").groupBy("state").agg(F.count(F.lit(1)).alias("n_claims"))


def proposition_counts(spark, d):
    """Claims whose text can and can't be a proposition, and how many hold control characters."""
    own = records(table(spark, d, "claims"), "text").where("text IS NOT NULL")
    return own.groupBy(T.is_proposition(F.col("text")).alias("is_proposition")).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(T.contains_control(F.col("text"))).alias("n_control"))


def content_ids(spark, d):
    """id, content_id: the id of each source by its content."""
    json = F.concat(F.lit('{"content":'), T.json_string(F.col("content")), F.lit(',"source_type":'), T.json_string(F.col("source_type")), F.lit(',"uri":'), T.json_string(F.col("uri")), F.lit("}"))
    return _sources(spark, d).select("id", T.content_id("src-", json).alias("content_id"))


def state_digest(spark, d):
    own = records(table(spark, d, "claims"), "state")
    return spark.range(1).select(F.lit(digests.state_digest(own)).alias("state_digest"))


def claim_fingerprint(spark, d):
    return spark.range(1).select(F.lit(digests.fingerprint(table(spark, d, "claims").select("id"))).alias("fingerprint"))


def merkle_root(spark, d):
    """Root and version over the ids of claims, evidence and sources."""
    ids = digests.union_ids(*(table(spark, d, t) for t in ("claims", "evidence", "sources")))
    root = digests.merkle_root(ids)
    return spark.range(1).select(F.lit(root).alias("root"), digests.version(F.lit(root)).alias("version"))


def manifest_diff(spark, d):
    """Records that the store held a year before its last delivery against those it holds at the end."""
    sources = table(spark, d, "sources")
    last = sources.agg(F.max("recorded_at")).scalar()
    held = sources.where(F.col("recorded_at") <= last - F.expr("INTERVAL 365 DAYS"))
    kept = sources.groupBy("id").agg(F.min("removed_at").alias("removed_at")).where("removed_at IS NULL")
    return digests.diff(held, kept)


def code_regions(spark, d):
    return regions.region_rows(table(spark, d, "documents"), "doc_id", "text")


def evidence_in_regions(spark, d):
    """evidence_id, in_region of every evidence whose source is held."""
    held = records(table(spark, d, "evidence"), "source_id", "start_offset", "end_offset").withColumnRenamed("id", "evidence_id")
    found = _sources(spark, d).select(F.col("id").alias("source_id"), regions.regions(F.col("content")).alias("found"))
    return held.join(found, "source_id").select("evidence_id", F.coalesce(regions.inside(F.col("found"), F.col("start_offset"), F.col("end_offset")), F.lit(False)).alias("in_region"))


def front_matter(spark, d):
    """doc_id, key, value of every front-matter field."""
    return table(spark, d, "documents").select("doc_id", F.explode(exports.front_matter(F.col("text"))).alias("key", "value"))


def conversation_turn_docs(spark, d):
    return exports.turns(table(spark, d, "documents"), "doc_id", "text")


def canonical_paths(spark, d):
    """uri, path, under_chat: each source's path with dots resolved, and whether it lies under /chat."""
    path = F.concat(F.lit("/"), F.replace("uri", F.lit("://"), F.lit("/./x/../")))
    own = _sources(spark, d).select("uri", T.canonical_path(path).alias("path"))
    return own.select("uri", "path", T.path_within(F.col("path"), F.lit("/chat")).alias("under_chat"))


def chain_links(spark, d):
    """user_id, event_id, chain_hash: a hash chain over each user's events."""
    return chain.chained(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "chain_hash")


def chain_verify(spark, d):
    """Broken links after every event of the type 'error' was changed behind the chain's back."""
    built = chain.chained(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"])
    forged = built.withColumn("event_type", F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")))
    return chain.broken_links(forged, "user_id", "event_id", ["event_type"])


QUERIES = {f.__name__: f for f in (
    corpus_stats_by_type, speaker_counts, machine_share, claims_per_source, table_counts, state_histogram, proposition_counts, content_ids, state_digest, claim_fingerprint, merkle_root, manifest_diff,
    code_regions, evidence_in_regions, front_matter, conversation_turn_docs, canonical_paths, chain_links, chain_verify,
)}

_SPEAKER = "CASE WHEN source_type LIKE '%\\_other' ESCAPE '\\' THEN 'third_party' WHEN source_type IN ('forum_comment', 'forum_submission', 'chat_user') THEN 'testimony' WHEN source_type = 'chat_assistant' THEN 'machine' ELSE 'neither' END"
_JSON = "'\"' || replace(replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(27), chr(92) || 'u001b') || '\"'"


def _regions(rows: str, key: str) -> str:
    """Lines, flags and islands of (key, text) rows: a blank line goes with the line before it, if that one does."""
    return f"""ln AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {rows} WHERE text IS NOT NULL),
fl AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  regexp_matches(line, '^[{_SPACE}]*$') AS blank, regexp_matches(line, '^(\t|[ \t]{{2}})') AS ind FROM ln),
gr AS (SELECT *, sum(CASE WHEN NOT blank OR ind THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY k) AS anchor FROM fl),
st AS (SELECT *, coalesce(first_value(ind) OVER (PARTITION BY {key}, anchor ORDER BY k), false) AND anchor > 0 AS code FROM gr),
-- an indented blank line that follows no region begins none
cd AS (SELECT *, code AND NOT (blank AND ind AND NOT coalesce(lag(code) OVER (PARTITION BY {key} ORDER BY k), false)) AS c1 FROM st),
isl AS (SELECT *, sum(CASE WHEN NOT c1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY k) AS island FROM cd),
reg AS (SELECT {key}, CAST(min(a) AS INT) AS start_offset, CAST(max(a + len(line) + 1) AS INT) AS end_offset FROM isl WHERE c1 GROUP BY {key}, island)"""


ORACLES = {
    "corpus_stats_by_type": _STORE + f"SELECT source_type, {_SPEAKER} AS speaker, count(*) AS n_docs, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM s GROUP BY source_type",
    "speaker_counts": _STORE + f"SELECT {_SPEAKER} AS speaker, count(*) AS n_docs FROM s GROUP BY 1",
    "machine_share": f"""WITH c AS (SELECT DISTINCT id, meta FROM claims WHERE id IS NOT NULL), s AS (SELECT DISTINCT id, uri, source_type FROM sources WHERE id IS NOT NULL),
n AS (SELECT {_SPEAKER} AS speaker, count(*) AS n_claims FROM c JOIN s ON s.uri = json_extract_string(meta, '$.source_uri') GROUP BY 1)
SELECT speaker, n_claims, round(100 * n_claims / (SELECT sum(n_claims) FROM n), 1) AS pct FROM n""",
    "claims_per_source": "SELECT json_extract_string(meta, '$.source_uri') AS uri, count(*) AS n_claims FROM (SELECT DISTINCT id, meta FROM claims WHERE id IS NOT NULL) WHERE json_extract_string(meta, '$.source_uri') IS NOT NULL GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(DISTINCT id) AS n_records FROM {t}" for t in STORE_TABLES),
    "state_histogram": _STORE + "SELECT state, count(*) AS n_claims FROM c GROUP BY state",
    "proposition_counts": _STORE + f""", x AS (SELECT text, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{85}}\\x{{9F}}]') AS control, {_STRIP.format('text')} AS body FROM c WHERE text IS NOT NULL)
SELECT len(body) >= 25 AND NOT control AND regexp_matches(body, '\\p{{L}}') AS is_proposition, count(*) AS n_claims, count(*) FILTER (WHERE control) AS n_control FROM x GROUP BY 1""",
    "content_ids": _STORE + f"SELECT id, 'src-' || sha256('veristrata/v1' || chr(0) || '{{\"content\":' || {_JSON.format('content')} || ',\"source_type\":' || {_JSON.format('source_type')} || ',\"uri\":' || {_JSON.format('uri')} || '}}') AS content_id FROM s",
    "state_digest": _STORE + "SELECT sha256('veristrata/state/v1' || string_agg(chr(0) || id || chr(0) || state, '' ORDER BY id)) AS state_digest FROM c",
    "claim_fingerprint": "SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS fingerprint FROM (SELECT DISTINCT id FROM claims WHERE id IS NOT NULL)",
    "merkle_root": """WITH RECURSIVE ids AS (SELECT id FROM claims UNION SELECT id FROM evidence UNION SELECT id FROM sources),
level AS (SELECT 0 AS lv, list(h ORDER BY h) AS hs FROM (SELECT DISTINCT sha256('veristrata/leaf/v1' || chr(0) || id) AS h FROM ids WHERE id IS NOT NULL)
  UNION ALL SELECT lv + 1, list_transform(generate_series(1, len(hs), 2), lambda i: sha256(CAST('veristrata/manifest/v1' AS BLOB) || unhex(hs[i]) || unhex(hs[least(i + 1, len(hs))]))) FROM level WHERE len(hs) > 1)
SELECT hs[1] AS root, 'v1-' || substr(hs[1], 1, 16) AS version FROM level WHERE len(hs) = 1""",
    "manifest_diff": """WITH held AS (SELECT DISTINCT id FROM sources WHERE recorded_at <= (SELECT max(recorded_at) FROM sources) - INTERVAL 365 DAY), kept AS (SELECT id FROM sources WHERE id IS NOT NULL GROUP BY id HAVING min(removed_at) IS NULL)
SELECT id, 'added' AS change FROM kept WHERE id NOT IN (SELECT id FROM held) UNION ALL SELECT id, 'removed' FROM held WHERE id NOT IN (SELECT id FROM kept)""",
    "code_regions": "WITH " + _regions("documents", "doc_id") + " SELECT doc_id, start_offset, end_offset FROM reg",
    "evidence_in_regions": _STORE + ", t AS (SELECT id AS source_id, content AS text FROM s), " + _regions("t", "source_id") + """
SELECT e.id AS evidence_id, coalesce(bool_or(reg.start_offset <= e.start_offset AND e.end_offset <= reg.end_offset), false) AS in_region FROM e JOIN s ON s.id = e.source_id LEFT JOIN reg ON reg.source_id = e.source_id GROUP BY e.id""",
    "canonical_paths": _STORE + "SELECT uri, '/' || split_part(uri, '://', 1) || '/' || split_part(uri, '://', 2) AS path, uri LIKE 'chat://%' AS under_chat FROM s",
    "chain_links": """WITH RECURSIVE ev AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
ch AS (SELECT user_id, event_id, k, sha256(repeat('0', 64) || chr(31) || event_id || chr(31) || event_type) AS chain_hash FROM ev WHERE k = 1
  UNION ALL SELECT ev.user_id, ev.event_id, ev.k, sha256(ch.chain_hash || chr(31) || ev.event_id || chr(31) || ev.event_type) FROM ch JOIN ev ON ev.user_id = ch.user_id AND ev.k = ch.k + 1)
SELECT user_id, event_id, chain_hash FROM ch""",
    "chain_verify": "SELECT user_id, event_id, 'content' AS reason FROM events WHERE event_type = 'error'",
}
