"""References to records that do not exist, from signed reference and existence counts.

Every change is a delta: a record's arrival adds one to its key's existence, its removal takes one away, a
reference adds one to its key's references. Counts per key are sums, so they merge from any batches in any
order: :func:`merge_counts` adds a batch to a kept state and :func:`current_orphans` reads it off.
:func:`found` sums the same deltas up to each reference's own time.

Defined cases. Ids are trimmed of Unicode white space and lower-cased; null, empty and blank ids are no
reference and no record. Rows with one id are one record that arrives at the earliest recorded_at; where its
removed_at differs between deliveries the earliest counts. A null arrival of a reference counts as never: its
targets cannot be late or deleted by then, so such references are only reported when missing, with a null period.
Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.skew import join_group_facts
from veristrata.session import written

#: What counts as white space (as str.strip() in Python), as a regular-expression class body.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def id_form(value: Column) -> Column:
    """Trimmed, lower-cased id; null where nothing is left."""
    form = F.lower(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(form != "", form)


def records(table: DataFrame, removable: bool) -> DataFrame:
    """One row per record key: arrival and removal."""
    return (
        table.select(
            id_form(F.col("id")).alias("key"),
            F.col("recorded_at").alias("at"),
            (F.col("removed_at") if removable else F.lit(None).cast("timestamp")).alias("gone"),
        )
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("at").alias("arrival"), F.min("gone").alias("removed"))
    )


def references(table: DataFrame, tab: str, field: str, separator: str | None = None) -> DataFrame:
    """One row per referring record and distinct id, with the record's arrival t."""
    pieces = F.split(F.col(field), separator) if separator else F.array(F.col(field))
    forms = F.array_distinct(F.filter(F.transform(pieces, id_form), lambda x: x.isNotNull()))
    return (
        table.select(F.col("id").alias("row_id"), F.explode(forms).alias("key"), "recorded_at")
        .where("row_id IS NOT NULL")
        .groupBy("row_id", "key")
        .agg(F.min("recorded_at").alias("t"))
        .select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), "row_id", "key", "t")
    )


def deltas(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Signed changes per key: (key, at, refs, existing)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        refs.select("key", F.col("t").alias("at"), one.alias("refs"), none.alias("existing"))
        .unionByName(targets.select("key", F.col("arrival").alias("at"), none.alias("refs"), one.alias("existing")))
        .unionByName(targets.where("removed IS NOT NULL").select("key", F.col("removed").alias("at"), none.alias("refs"), (-one).alias("existing")))
    )


def merge_counts(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add a batch of deltas to the kept counts; the sum is partial before the shuffle, so hot keys are one row per task."""
    rows = changes.select("key", "refs", "existing")
    if state is not None:
        rows = rows.unionByName(state.select("key", "refs", "existing"))
    return rows.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")).where("refs <> 0 OR existing <> 0")


def current_orphans(counts: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return counts.where("refs > 0 AND existing <= 0")


def ledgers(changes: DataFrame) -> DataFrame:
    """key, refs, ledger: references to a key, and its existence deltas in time order (an arrival and at most one removal).

    Sums come first, so a key that a third of all rows refer to is one row per task before the shuffle.
    """
    per_time = changes.groupBy("key", F.when(F.col("existing") != 0, F.col("at")).alias("at"), F.signum("existing").cast("int").alias("sign")).agg(F.sum("refs").alias("refs"))
    entry = F.when(F.col("sign") != 0, F.struct("at", "sign"))
    return per_time.groupBy("key").agg(F.sum("refs").alias("refs"), F.array_sort(F.collect_list(entry)).alias("ledger"))


def found(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The references whose key doesn't exist at their own time: tab, field, row_id, ref_id, reason, period.

    Existence at t is the sum of the key's signed deltas up to t. Where it isn't positive the reason is what the ledger
    lacks: every delta (missing), an arrival by then (late), or all but a spent one (deleted).
    """
    ledger = written(ledgers(deltas(refs, targets)).where("refs > 0"), "ledgers")
    upto = F.filter("ledger", lambda x: x["at"] <= F.col("t"))
    existing = F.aggregate(upto, F.lit(0), lambda total, x: total + x["sign"])
    reason = F.when(F.size("ledger") == 0, "missing").when(F.col("t").isNull() | (existing > 0), None).when(F.exists(upto, lambda x: x["sign"] > 0), "deleted").otherwise("late")
    return (
        join_group_facts(refs, ledger, ["key"], "refs")
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select("tab", "field", "row_id", F.col("key").alias("ref_id"), "reason", F.date_format("t", "yyyy-MM").alias("period"))
    )


def store_references(sources: DataFrame, evidence: DataFrame, claims: DataFrame, peer_groups: DataFrame, evaluations: DataFrame) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """The store's three reference fields (table, field), each with its references and the records they name."""
    return [
        ("evidence", "source_id", references(evidence, "evidence", "source_id"), records(sources, True)),
        ("evaluations", "subject_id", references(evaluations, "evaluations", "subject_id"), records(claims, True)),
        ("evaluations", "attested_by", references(evaluations, "evaluations", "attested_by", ","), records(peer_groups, True)),
    ]
