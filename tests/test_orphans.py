"""Orphan references: reasons, edges, kept counts, hot keys."""

from datetime import datetime as D

from veristrata.operators import orphans
from veristrata.operators.skew import join_group_facts


def frames(spark):
    t = lambda d: D(2025, 1, d)
    refs = [("r1", " A\n", t(5), 0), ("r1", "a", t(4), 0), ("r2", "b", t(5), 0), ("r3", "gone", t(5), 0), ("r4", "gone", t(2), 0), ("r5", "late", t(5), 0), ("r6", None, t(5), 0), ("r7", "  ", t(5), 0), ("r8", "x", None, 0), (None, "x", t(5), 0)]
    held = [("a", t(1), None, 1), ("A ", t(3), None, 1), ("gone", t(1), t(3), 1), ("late", t(9), None, 1), (None, t(1), None, 1)]
    return spark.createDataFrame(refs, "id string, source_id string, recorded_at timestamp, key int"), spark.createDataFrame(held, "id string, recorded_at timestamp, removed_at timestamp, key int")


def test_reasons(spark):
    refs, held = frames(spark)
    got = {(r["row_id"], r["ref_id"], r["reason"], r["period"]) for r in orphans.found(orphans.references(refs, "evidence", "source_id"), orphans.records(held, True)).collect()}
    assert got == {("r2", "b", "missing", "2025-01"), ("r3", "gone", "deleted", "2025-01"), ("r5", "late", "late", "2025-01"), ("r8", "x", "missing", None)}


def test_counts_are_kept_over_batches(spark):
    refs, held = frames(spark)
    r, h = orphans.references(refs, "evidence", "source_id"), orphans.records(held, True)
    changes = orphans.deltas(r, h)
    whole = {tuple(x) for x in orphans.merge_counts(changes).collect()}
    first = orphans.merge_counts(changes.where("key < 'c'"))
    assert {tuple(x) for x in orphans.merge_counts(changes.where("key >= 'c'"), first).collect()} == whole
    assert {x["key"] for x in orphans.current_orphans(orphans.merge_counts(changes)).collect()} == {"b", "gone", "x"}


def test_empty_tables(spark):
    refs, held = frames(spark)
    assert orphans.found(orphans.references(refs.limit(0), "t", "source_id"), orphans.records(held, True)).isEmpty()
    assert {x["reason"] for x in orphans.found(orphans.references(refs, "t", "source_id"), orphans.records(held.limit(0), True)).collect()} == {"missing"}


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("d", 3)], "k string, v int")
    facts = rows.where("k IS NOT NULL AND k <> 'd'").groupBy("k").count()
    want = {tuple(r) for r in rows.join(facts, "k").collect()}
    for hot in (2, 10, 10**6):
        assert {tuple(r) for r in join_group_facts(rows, facts, ["k"], "count", hot).collect()} == want
