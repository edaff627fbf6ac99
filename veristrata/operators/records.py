"""Store tables as records: redelivered rows of one id are one record.

Deliveries repeat every column but the time they were recorded at, so the distinct rows of the columns a plan reads are its
records; columns it doesn't read are never shuffled. A null id is no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(table: DataFrame, *columns: str) -> DataFrame:
    """The distinct (id, columns) of a table."""
    return table.where("id IS NOT NULL").select("id", *columns).distinct()


def slices(content: Column, start: Column, end: Column) -> Column:
    """content[start:end] in code points."""
    return F.substring(content, start + 1, end - start)


def listed(ids: Column) -> Column:
    """The ids of a comma-divided list, trimmed, without empty pieces."""
    return F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")


def named_groups(evaluations: DataFrame, *columns: str) -> DataFrame:
    """id, columns, kind (attested, contradicted), group_id: one row per evaluation and group it names."""
    each = [
        evaluations.select("id", *columns, F.lit(kind).alias("kind"), F.explode(listed(F.col(field))).alias("group_id"))
        for kind, field in (("attested", "attested_by"), ("contradicted", "contradicted_by"))
    ]
    return each[0].unionByName(each[1]).distinct()


def members(groups: DataFrame) -> DataFrame:
    """group_id, member: one row per distinct member, as it is written."""
    return groups.select(F.col("id").alias("group_id"), F.explode(F.array_distinct(F.from_json("members", "array<string>"))).alias("member")).where("member IS NOT NULL").distinct()
