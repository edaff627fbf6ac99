"""Closure over the dependency graph of claims.

Each level joins the frontier with the edges and keeps what wasn't reached before; a level is written to the shared
folder, so lineage stays one level deep and the number of jobs is the graph's depth. Cycles end at once, as their
records have been reached. Frontiers are distributed; nothing but their emptiness comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.operators.records import members, records
from veristrata.session import written


def dependencies(evaluations: DataFrame, groups: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """support, dependent: a subject rests on the members of the groups that attest it, a mined record on its sources."""
    named = evaluations.where("relation = 'attested' AND subject_id IS NOT NULL").select(F.col("subject_id").alias("dependent"), F.explode(F.split("attested_by", ",")).alias("g"))
    named = named.select("dependent", F.trim("g").alias("group_id")).distinct()
    out = named.join(members(groups), "group_id").select(F.col("member").alias("support"), "dependent")
    if edges is not None:
        out = out.unionByName(edges.where("relation = 'DERIVED_FROM'").select(F.col("to_id").alias("support"), F.col("from_id").alias("dependent")))
    return out.distinct()


def dependents(deps: DataFrame) -> DataFrame:
    """support, n_dependents."""
    return deps.groupBy("support").agg(F.count(F.lit(1)).alias("n_dependents"))


def levels(start: DataFrame, edges: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """id, level of everything reached from start (id) over edges (src, dst), with start at level 0.

    passes: the ids (id) that hand on what reaches them; others are reached and end there. Start always hands on.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    done = [written(start.select("id").distinct().withColumn("level", F.lit(0)), "frontier")]
    front = done[0]
    while not front.isEmpty():
        after = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, done).select("id")
        new = written(after.join(seen, "id", "left_anti").withColumn("level", F.lit(len(done))), "frontier")
        done.append(new)
        front = new if passes is None else new.join(passes.select("id"), "id", "left_semi")
    return reduce(DataFrame.unionByName, done)


def reach(start: DataFrame, edges: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    return levels(start, edges, passes).select("id")




def revision(claims: DataFrame, deps: DataFrame, ended: tuple[str, ...] = ("retracted", "invalidated", "superseded")) -> DataFrame:
    """claim_id, level, outcome of every record that rests on an ended claim.

    moved: it becomes invalidated and hands the revision on. already: it is invalidated. refused: it is retracted or
    superseded and stays. Only moved records propagate.
    """
    own = records(claims, "state")
    start = own.where(F.col("state").isin(*ended)).select("id")
    moves = own.where(~F.col("state").isin("retracted", "superseded", "invalidated")).select("id")
    found = levels(start, deps.select(F.col("support").alias("src"), F.col("dependent").alias("dst")), moves).where("level > 0")
    outcome = F.when(F.col("state").isin("retracted", "superseded"), "refused").when(F.col("state") == "invalidated", "already").otherwise("moved")
    return found.join(own, "id").select(F.col("id").alias("claim_id"), "level", outcome.alias("outcome"))


def dangling(claims: DataFrame, deps: DataFrame, ended: tuple[str, ...], live: tuple[str, ...]) -> DataFrame:
    """support, dependent: live claims that rest directly on an ended one."""
    own = records(claims, "state")
    a = own.where(F.col("state").isin(*ended)).select(F.col("id").alias("support"))
    b = own.where(F.col("state").isin(*live)).select(F.col("id").alias("dependent"))
    return deps.join(a, "support").join(b, "dependent").select("support", "dependent")
