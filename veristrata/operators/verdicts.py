"""Relations between claims by their normal forms: contradictions, attestations, verdicts and peer groups.

Attestation compares token sequences. A subject's sequence has to be a run inside its peer's, so the subject's lead, its
first 1, 2, 4 or 8 tokens (as many as it has), is one of the peer's n-grams. The leads' hashes are the join's equality key:
pairs of sequence hashes are proposed, and sequences and texts decide when the claims come back. Sequences are joined,
not claims: equal sequences are one row on either side. No pair without a common key is ever formed.

Defined cases. Null texts normalise to nothing: no terms, no sequence, in no relation, inconclusive. Redelivered claims
are one; a null id is none. A claim without evidence has no source and is never contradicted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators.records import records

#: Lengths of leads, shortest first; the longest that a subject has is its key, so 1 has to be there.
LEADS = (1, 2, 4, 8)


def normalised(claims: DataFrame) -> DataFrame:
    """claim_id, text, seq (joined by spaces), terms, polarity of every claim."""
    tokens = records(claims, "text").withColumnRenamed("id", "claim_id").withColumn("tokens", T.sequence(F.col("text")))
    return tokens.select("claim_id", "text", F.array_join("tokens", " ").alias("seq"), F.array_join(T.terms(F.col("tokens")), " ").alias("terms"), T.polarity(F.col("text")).alias("polarity"))


def scopes(claim_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, source_id."""
    held = evidence.where("source_id IS NOT NULL").select(F.col("id").alias("evidence_id"), "source_id")
    return claim_evidence.join(held, "evidence_id").select("claim_id", "source_id").distinct()


def contradictions(norm: DataFrame, scope: DataFrame) -> DataFrame:
    """subject_id, peer_id: one source, equal terms, known and opposite polarity."""
    known = norm.where("terms <> '' AND polarity IS NOT NULL").join(scope, "claim_id").select("source_id", "terms", "polarity", "claim_id")
    a = known.where("polarity").select("source_id", "terms", F.col("claim_id").alias("x"))
    b = known.where("NOT polarity").select("source_id", "terms", F.col("claim_id").alias("y"))
    pairs = a.join(b, ["source_id", "terms"]).select("x", "y").distinct()
    return pairs.select(F.col("x").alias("subject_id"), F.col("y").alias("peer_id")).unionByName(pairs.select(F.col("y").alias("subject_id"), F.col("x").alias("peer_id")))


def sequence_runs(sequences: DataFrame, anywhere: bool = False) -> DataFrame:
    """subject_key, peer_key: hashes of distinct sequences (seq) that may be a run of a longer one. Every such pair is there, once.

    anywhere: the run may begin at any token of the peer; else only where the peer's first token stands (both begin alike).
    """
    w = F.col("w")
    held = sequences.where("seq <> ''").select("seq").distinct().select(F.xxhash64("seq").alias("key"), F.split("seq", " ").alias("w"))

    def gram(at: Column | int, n: int) -> Column:
        return F.xxhash64(F.array_join(F.slice(w, at, n), " "))

    def grams_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.transform(places if anywhere else F.filter(places, lambda i: F.element_at(w, i) == w[0]), lambda i: gram(i, n))

    lead = F.coalesce(*(F.when(F.size(w) >= n, gram(1, n)) for n in reversed(LEADS)))
    subjects = held.select(F.col("key").alias("subject_key"), F.size("w").alias("n"), lead.alias("lead"))
    every = F.concat(*(F.when(F.size(w) > n, grams_of(n)).otherwise(F.array().cast("array<bigint>")) for n in LEADS))
    peers = held.select(F.col("key").alias("peer_key"), F.size("w").alias("m"), F.explode(F.array_distinct(every)).alias("lead"))
    # hashed by subjects, the smaller side: the peers' n-grams stream past and are never sorted
    return peers.join(subjects.hint("shuffle_hash"), "lead").where("n < m").select("subject_key", "peer_key")


def attestations(norm: DataFrame, anywhere: bool = False) -> DataFrame:
    """subject_id, peer_id: the peer's sequence holds the subject's and more, and its text doesn't hold the subject's text.

    anywhere: as in sequence_runs.
    """
    own = norm.where("seq <> ''").withColumn("key", F.xxhash64("seq"))
    a = own.select(F.col("key").alias("subject_key"), F.col("seq").alias("subject"), F.col("claim_id").alias("subject_id"), T.strip(F.col("text")).alias("a"))
    b = own.select(F.col("key").alias("peer_key"), F.col("seq").alias("peer"), F.col("claim_id").alias("peer_id"), T.strip(F.col("text")).alias("b"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    run = (F.col("subject") != F.col("peer")) & F.contains(pad("peer"), pad("subject"))
    if not anywhere:
        run &= F.substring_index("subject", " ", 1) == F.substring_index("peer", " ", 1)
    # peers first: copies of a subject multiply the pairs, in the last join
    return sequence_runs(norm, anywhere).join(b, "peer_key").join(a, "subject_key").where(run & ~F.contains("b", "a")).select("subject_id", "peer_id")


def verdicts(claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """claim_id, relation, n_peers, group_id (id of its sorted peers), has_neighbours; contradiction comes before attestation.

    only: claim ids to give verdicts for (a resumed run); the relations are still found among all claims.
    """
    norm = normalised(claims)
    against, for_ = (
        pairs.groupBy("subject_id").agg(F.array_sort(F.collect_set("peer_id")).alias("peers"))  # a record's own peers, as it stores them
        for pairs in (contradictions(norm, scopes(claim_evidence, evidence)), attestations(norm))
    )
    subjects = norm.select("claim_id") if only is None else norm.join(only.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id")
    joined = (
        subjects.join(against.toDF("claim_id", "against"), "claim_id", "left").join(for_.toDF("claim_id", "for_"), "claim_id", "left").join(with_neighbours(norm), "claim_id", "left")
    )
    peers = F.coalesce("against", "for_")
    return joined.select(
        "claim_id", F.when(F.col("against").isNotNull(), "contradicted").when(F.col("for_").isNotNull(), "attested").otherwise("inconclusive").alias("relation"),
        F.coalesce(F.size(peers), F.lit(0)).alias("n_peers"), group_id(peers).alias("group_id"), F.col("found").isNotNull().alias("has_neighbours"),
    )


def group_id(members: Column) -> Column:
    """Content id of a peer group; null for none."""
    return F.when(F.size(members) > 0, T.content_id("agr-", F.concat(F.lit('{"members":'), T.json_array(members), F.lit("}"))))


def peer_groups(found: DataFrame) -> DataFrame:
    """id, members (JSON), size: each distinct set of peers once, from pairs (subject_id, peer_id)."""
    sets = found.groupBy("subject_id").agg(F.array_sort(F.collect_set("peer_id")).alias("m")).select("m").distinct()
    return sets.select(group_id(F.col("m")).alias("id"), T.json_array(F.col("m")).alias("members"), F.size("m").alias("size"))


def term_rows(norm: DataFrame) -> DataFrame:
    """claim_id, term: each claim's distinct search terms."""
    return norm.select("claim_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def with_neighbours(norm: DataFrame) -> DataFrame:
    """claim_id, found of the claims that share a term with another one: a term with two claims is enough, so no pair is formed."""
    terms = term_rows(norm)
    common = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return terms.join(common, "term").groupBy("claim_id").agg(F.lit(True).alias("found"))


def matching(norm: DataFrame, question: str) -> DataFrame:
    """claim_id of every claim that shares a term with the question: membership, no ranking."""
    asked = F.array_distinct(T.tokens(F.lit(question)))
    return norm.where(F.arrays_overlap(T.tokens(F.col("text")), asked)).select("claim_id")
