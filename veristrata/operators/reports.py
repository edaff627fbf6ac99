"""Reading recorded verdicts: pairs, containment, strata, cross tables.

Defined cases. Pairs exist only where both claims do; a subject is never its own peer. Letters outside ASCII decide the
stratum ``non-latin``, so a text without letters has none of them. Numbers within a stratum follow a hash of the pair,
which replaces a random sample: the same data give the same rows in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators.records import members, named_groups, records

SHORT = 40
#: Line beginnings that look like program code.
CODE_LINES = [r"from\s+\S+\s+import", r"import\s+\w", r"def\s+\w+\s*\(", r"class\s+\w+\s*[(:]", r"return\b", r"\w+\s*=\s*[\w.\[\]]+", r"print\(", r"\w+\.\w+\(", r"for\s+\w+\s+in\s", r"if\s+\w+.*:", r"except\b", r"function", r"const", r"let", r"var", r"=>", r"import\s+\{", r"export\s"]


def verdict_pairs(evaluations: DataFrame, groups: DataFrame, claims: DataFrame, relation: str) -> DataFrame:
    """subject_id, subject_text, peer_id, peer_text of every recorded pair of one relation."""
    named = named_groups(evaluations, "relation", "subject_id").where((F.col("relation") == relation) & (F.col("kind") == relation))
    pairs = named.join(members(groups), "group_id").select("subject_id", F.col("member").alias("peer_id")).where("subject_id <> peer_id").distinct()
    own = records(claims, "text")
    return pairs.join(own.toDF("subject_id", "subject_text"), "subject_id").join(own.toDF("peer_id", "peer_text"), "peer_id").select("subject_id", "subject_text", "peer_id", "peer_text")


def containment(evaluations: DataFrame, groups: DataFrame, claims: DataFrame, relation: str) -> DataFrame:
    """One row: n_subjects, n_contained (each peer holds the subject's text), the same of short subjects, and the upper median length."""
    body = T.strip(F.col("subject_text"))
    per = verdict_pairs(evaluations, groups, claims, relation).groupBy("subject_id", F.length(body).alias("n_chars")).agg(F.bool_and(F.contains("peer_text", body)).alias("contained"))
    # lengths are few: the median is read off their histogram
    sizes = per.groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"), F.count_if("contained").alias("held"))
    upto = sizes.withColumn("upto", F.sum("n").over(W.orderBy("n_chars"))).withColumn("all", F.sum("n").over(W.partitionBy()))
    half = F.floor(F.col("all") / 2)
    short = F.col("n_chars") <= SHORT
    return upto.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_subjects"), F.coalesce(F.sum("held"), F.lit(0)).alias("n_contained"), F.coalesce(F.sum(F.when(short, F.col("n"))), F.lit(0)).alias("n_short"),
        F.coalesce(F.sum(F.when(short, F.col("held"))), F.lit(0)).alias("n_short_contained"), F.min(F.when(F.col("upto") > half, F.col("n_chars"))).alias("median_chars"),
    )


def non_latin_share(text: Column) -> Column:
    """Share of letters outside ASCII; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{L}]|[A-Za-z]", "")) / letters).otherwise(0.0)


def stratum(subject: Column, peer: Column) -> Column:
    """non-latin, code or prose."""
    lines = F.split(subject, "\n")
    indented = F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]"))) / F.size(lines)
    plain = F.length(F.regexp_replace(subject, r"[^\p{L}\s\p{Z}]", "")) / F.greatest(F.length(subject), F.lit(1))
    code = ((F.size(lines) > 1) & ((indented > 0.4) | (plain < 0.7))) | subject.rlike(r"(?m)^\s*(?:" + "|".join(CODE_LINES) + ")")
    return F.when((non_latin_share(subject) > 0.2) | (non_latin_share(peer) > 0.2), "non-latin").when(code, "code").otherwise("prose")


def stratified(pairs: DataFrame, per_stratum: int | None = None, seed: str = "0") -> DataFrame:
    """stratum, subject_id, peer_id, rank: the place of each pair in its stratum's random order; the first per_stratum where that is given."""
    kinds = pairs.select(stratum(F.col("subject_text"), F.col("peer_text")).alias("stratum"), "subject_id", "peer_id", F.sha2(F.concat_ws("|", F.lit(seed), "subject_id", "peer_id"), 256).alias("o"))
    if per_stratum is None:
        return kinds.select("stratum", "subject_id", "peer_id", "o").withColumnRenamed("o", "draw")
    # a rank limit is pushed below the window, so each task keeps per_stratum rows of a stratum
    ranked = kinds.withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy("o", "subject_id", "peer_id"))).where(F.col("rank") <= per_stratum)
    number = F.row_number().over(W.orderBy("stratum", "subject_id", "peer_id"))  # at most three strata of per_stratum rows
    return ranked.select(F.format_string("P%04d", number).alias("pair_id"), "stratum", "subject_id", "peer_id", "rank")


def crosstab(rows: DataFrame, labels: list) -> DataFrame:
    """stratum, label_<x> for each label, n: counts of rows (stratum, label)."""
    return rows.groupBy("stratum").agg(*(F.count_if(F.col("label") == x).alias(f"label_{x}") for x in labels), F.count(F.lit(1)).alias("n"))


#: What each policy refuses besides pairs of the stratum code.
REFUSED = {"none": None, "no-code": ("code_fragment",), "no-code-or-subset": ("code_fragment", "subset"), "code-only": ("code_fragment",)}


def policy_cost(rows: DataFrame, policy: str, wanted: str = "real_contradiction") -> DataFrame:
    """n, n_refused, n_wanted, n_wanted_lost of labelled pairs (stratum, label) under a policy."""
    if policy not in REFUSED:
        raise ValueError(f"unknown policy: {policy}")
    refused = F.lit(False) if REFUSED[policy] is None else (F.col("stratum") == "code") | F.col("label").isin(*REFUSED[policy])
    is_wanted = F.col("label") == wanted
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(refused).alias("n_refused"), F.count_if(is_wanted).alias("n_wanted"), F.count_if(is_wanted & refused).alias("n_wanted_lost"))
