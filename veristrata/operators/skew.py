"""Joins that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is hot, and with so many that at most MOST_HOT keys are.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size_col: str, hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """Inner join of rows with one row of facts per key, where size_col of facts counts the key's rows.

    Facts of hot keys are broadcast, so their rows never move; the rest is shuffled on the key. A hot key has at least
    hot_rows rows and at least the total divided by most_hot, so no more than most_hot keys are ever broadcast and no
    key that is shuffled holds more than that share. Keys are compared with ``=``: rows with a null key are dropped.
    """
    least = facts.agg(F.greatest(F.lit(hot_rows), F.ceil(F.sum(size_col) / most_hot)).alias("least")).scalar()
    hot = F.broadcast(facts.where(F.col(size_col) >= least))
    cold = facts.where(F.col(size_col) < least)
    on_hot = rows.join(hot, keys, "inner")
    rest = rows.join(F.broadcast(facts.where(F.col(size_col) >= least).select(*keys)), keys, "left_anti")
    return on_hot.unionByName(rest.join(cold, keys, "inner"))
