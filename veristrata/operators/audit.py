"""Checks of a store against itself, each a relation of its violations. None of them reads a result of the engine.

All are anti joins, joins with a residual test, or one aggregation. A disjunction over two group columns is never joined
as such: the columns are exploded to rows first, so every join has an equality key. Ids are compared as they stand.

Defined cases. Redelivered rows are one record; null ids are no records. Where a field that a check compares is null on
either side the check reports the record (a missing text can't be verified); null references name nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.operators.graph import reach
from veristrata.operators.records import members, named_groups, records, slices

#: States that need no evidence and no evaluation, ended states, and states that rest on others.
FREE_STATES = ("unexamined", "assumed", "derived", "unresolved")
ENDED, LIVE = ("retracted", "invalidated", "superseded"), ("supported", "derived", "validated")


def checksums(sources: DataFrame) -> DataFrame:
    """id, checksum, computed, ok."""
    computed = F.sha2(F.col("content"), 256)
    return records(sources, "checksum", "content").select("id", "checksum", computed.alias("computed"), F.coalesce(computed == F.col("checksum"), F.lit(False)).alias("ok"))


def spans(claim_evidence: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, evidence_id, source_id, start_offset, end_offset, span, ok: each claim's evidence against its source's text."""
    held = records(evidence, "source_id", "start_offset", "end_offset", "text").withColumnRenamed("id", "evidence_id")
    content = records(sources, "content").withColumnRenamed("id", "source_id")
    span = slices(F.col("content"), F.col("start_offset"), F.col("end_offset"))
    return (
        claim_evidence.select("claim_id", "evidence_id").distinct().join(held, "evidence_id").join(content, "source_id")
        .select("claim_id", "evidence_id", "source_id", "start_offset", "end_offset", span.alias("span"), F.coalesce(span == F.col("text"), F.lit(False)).alias("ok"))
    )


def text_mismatches(claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, n_spans: claims whose text isn't their spans joined in order."""
    whole = spans(claim_evidence, evidence, sources).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "span"))).alias("s"))  # one claim's evidence
    joined = F.array_join(F.transform("s", lambda x: x["span"]), "")
    return whole.join(records(claims, "text").withColumnRenamed("id", "claim_id"), "claim_id").where(~joined.eqNullSafe(F.col("text"))).select("claim_id", F.size("s").alias("n_spans"))


def dangling_edges(claim_evidence: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, evidence_id: evidence of a claim without a source."""
    held = records(evidence, "source_id").withColumnRenamed("id", "evidence_id")
    known = sources.select(F.col("id").alias("source_id"))
    return claim_evidence.select("claim_id", "evidence_id").distinct().join(held, "evidence_id").join(known, "source_id", "left_anti").select("claim_id", "evidence_id")


def orphans(claims: DataFrame, claim_evidence: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """claim_id, state: states that promise evidence without any, nor an edge DERIVED_FROM another claim."""
    own = records(claims, "state").withColumnRenamed("id", "claim_id").where(~F.col("state").isin(*FREE_STATES))
    bare = own.join(claim_evidence.select("claim_id"), "claim_id", "left_anti")
    if edges is not None:
        bare = bare.join(edges.where("relation = 'DERIVED_FROM'").select(F.col("from_id").alias("claim_id")), "claim_id", "left_anti")
    return bare.select("claim_id", "state")


def unresolved_absence(claims: DataFrame, claim_evidence: DataFrame) -> DataFrame:
    """claim_id of unresolved claims without evidence (counted, no violation)."""
    own = records(claims, "state").where("state = 'unresolved'").select(F.col("id").alias("claim_id"))
    return own.join(claim_evidence.select("claim_id"), "claim_id", "left_anti")


def unresolved_without_investigation(claims: DataFrame, investigations: DataFrame) -> DataFrame:
    own = records(claims, "state", "investigation_id").where("state = 'unresolved'")
    return own.join(investigations.select(F.col("id").alias("investigation_id")), "investigation_id", "left_anti").select(F.col("id").alias("claim_id"), "investigation_id")


def state_without_evaluation(claims: DataFrame, evaluations: DataFrame) -> DataFrame:
    own = records(claims, "state").withColumnRenamed("id", "claim_id").where(~F.col("state").isin(*FREE_STATES))
    return own.join(evaluations.select(F.col("subject_id").alias("claim_id")), "claim_id", "left_anti").select("claim_id", "state")


def missing_groups(evaluations: DataFrame, groups: DataFrame) -> DataFrame:
    """evaluation_id, kind, group_id: groups named by an evaluation that don't exist."""
    return named_groups(evaluations).join(groups.select(F.col("id").alias("group_id")), "group_id", "left_anti").select(F.col("id").alias("evaluation_id"), "kind", "group_id")


def empty_groups(evaluations: DataFrame, groups: DataFrame) -> DataFrame:
    """evaluation_id, kind, group_id: decided relations that name a group without members."""
    bare = records(groups, "members").where("members IS NULL OR trim(members) IN ('[]', 'null', '')").select(F.col("id").alias("group_id"))
    named = named_groups(evaluations, "relation").where("relation IN ('attested', 'contradicted')")
    return named.join(bare, "group_id").select(F.col("id").alias("evaluation_id"), "kind", "group_id")


def missing_members(evaluations: DataFrame, groups: DataFrame, claims: DataFrame) -> DataFrame:
    """evaluation_id, missing_claim: members of a named group that are no claims."""
    gone = members(groups).join(claims.select(F.col("id").alias("member")), "member", "left_anti")
    return named_groups(evaluations).join(gone, "group_id").select(F.col("id").alias("evaluation_id"), F.col("member").alias("missing_claim")).distinct()


def stale_dependents(claims: DataFrame, dependencies: DataFrame) -> DataFrame:
    """claim_id, state: live claims that rest on an ended one, over any number of steps and through any state."""
    own = records(claims, "state")
    ended = own.where(F.col("state").isin(*ENDED)).select("id")
    reached = reach(ended, dependencies.select(F.col("support").alias("src"), F.col("dependent").alias("dst")))
    return reached.join(ended, "id", "left_anti").join(own.where(F.col("state").isin(*LIVE)), "id").select(F.col("id").alias("claim_id"), "state")


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """check_name, n_found of every check, and clean: 1 where none found anything."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_found")).select(F.lit(name).alias("check_name"), "n_found") for name, df in checks.items()]
    rows = reduce(DataFrame.unionByName, counted)
    return rows.unionByName(rows.agg((F.max("n_found") == 0).cast("long").alias("n_found")).select(F.lit("clean").alias("check_name"), "n_found"))
