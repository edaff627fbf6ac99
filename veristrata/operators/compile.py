"""Corpus to claims: segments, propositions, content ids, evidence, mined recurrences, as lazy relations.

sources (uri, content, source_type) -> one pass of the segmenter -> propositions -> ids by SHA-256 over canonical JSON,
all in the same stage: nothing is shuffled until the miner counts shapes. The same corpus gives the same ids in any
order and partitioning. Compiled claims are ``unexamined`` and mined ones ``derived``; no other state is ever written.

Defined cases. Sources with one content id are one source. Null and empty contents have no claims. Sentences that are
equal at different places are different claims, as their evidence differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import mining, segment

UNEXAMINED, DERIVED = "unexamined", "derived"


@dataclass
class Compiled:
    """The relations of a compiled corpus."""

    sources: DataFrame
    segments: DataFrame
    evidence: DataFrame
    claims: DataFrame
    claim_evidence: DataFrame
    mined: DataFrame
    edges: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Store tables; mined claims are claims as well."""
        mined = self.mined.select("id", "text", F.lit(DERIVED).alias("state"), F.lit(None).cast("string").alias("source_uri"), F.lit(None).cast("int").alias("ordinal"))
        return {"sources": self.sources, "evidence": self.evidence, "claims": self.claims.unionByName(mined), "claim_evidence": self.claim_evidence, "claim_edges": self.edges}

    def dropped(self) -> DataFrame:
        """uri, n_segments, n_dropped: segments that are no propositions."""
        kept = T.is_proposition(F.col("text"))
        return self.segments.groupBy("uri").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(~kept).alias("n_dropped"))


def _object(**fields: Column) -> Column:
    """Canonical JSON of fields that are JSON already, keys in order."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(sorted(fields.items())):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def source_id(uri: Column, content: Column, source_type: Column) -> Column:
    return T.content_id("src-", _object(content=T.json_string(content), source_type=T.json_string(source_type), uri=T.json_string(uri)))


def evidence_id(source: Column, start: Column, end: Column, text: Column) -> Column:
    return T.content_id("ev-", _object(end_offset=end.cast("string"), meta=F.lit("{}"), source_id=T.json_string(source), start_offset=start.cast("string"), text=T.json_string(text)))


def claim_id(evidence: Column, uri: Column, ordinal: Column, text: Column) -> Column:
    """The id hashes the initial state and no time, so a claim keeps its id whatever becomes of it."""
    meta = _object(ordinal=ordinal.cast("string"), origin=F.lit('"extracted"'), source_uri=T.json_string(uri))
    null = F.lit("null")
    return T.content_id("clm-", _object(evidence_ids=T.json_array(F.array(evidence)), investigation_id=null, meta=meta, state=F.lit(f'"{UNEXAMINED}"'), text=T.json_string(text), valid_time=null))


def compile_corpus(sources: DataFrame, least_sources: int = mining.LEAST_SOURCES) -> Compiled:
    """sources: uri, content, source_type."""
    text = F.coalesce("content", F.lit(""))
    own = sources.select(F.col("uri").cast("string").alias("uri"), text.alias("content"), F.coalesce("source_type", F.lit("document")).alias("source_type")).where("uri IS NOT NULL").distinct()
    own = own.select(source_id(F.col("uri"), F.col("content"), F.col("source_type")).alias("id"), "uri", "source_type", F.sha2("content", 256).alias("checksum"), "content")
    found = segment.segments(own.select(F.struct("id", "uri").alias("k"), "content"), "k", "content").select(F.col("k.id").alias("source_id"), F.col("k.uri").alias("uri"), "ordinal", "start_offset", "end_offset", "text")
    kept = segment.propositions(found)
    kept = kept.withColumn("evidence_id", evidence_id(F.col("source_id"), F.col("start_offset"), F.col("end_offset"), F.col("text")))
    kept = kept.withColumn("claim_id", claim_id(F.col("evidence_id"), F.col("uri"), F.col("ordinal"), F.col("text")))
    mined, edges = mining.heuristics(kept.select("claim_id", F.col("source_id").alias("source"), "text"), least_sources)
    return Compiled(
        sources=own,
        segments=found,
        evidence=kept.select(F.col("evidence_id").alias("id"), "source_id", "start_offset", "end_offset", "text"),
        claims=kept.select(F.col("claim_id").alias("id"), "text", F.lit(UNEXAMINED).alias("state"), F.col("uri").alias("source_uri"), "ordinal"),
        claim_evidence=kept.select("claim_id", "evidence_id"),
        mined=mined,
        edges=edges,
    )
