"""The training-data queries by name, with SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import containers, encode, form_copies, near_copies, pii, reading, sentences, shared_spans, site_lines, sql
from veristrata.session import spread, table

ORACLES = sql.ORACLES


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return form_copies.copies(table(spark, d, "claims"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return form_copies.collapsed(table(spark, d, "claims"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.record_pairs(table(spark, d, "claims"), table(spark, d, "peer_groups"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.record_classes(table(spark, d, "claims"), table(spark, d, "peer_groups"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    whole = sentences.sentence_units(table(spark, d, "sources"), "sources", "content")
    return whole.unionByName(sentences.sentence_units(table(spark, d, "evidence"), "evidence", "text", fragment=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.spans(table(spark, d, "claims"), "claims", "text").unionByName(shared_spans.spans(table(spark, d, "sources"), "sources", "content"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.found(table(spark, d, "claims"), table(spark, d, "sources"))


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    tested = site_lines.lines(table(spark, d, "claims"), table(spark, d, "sources"))
    return tested.select("source_type", "inside", "outside", F.round("g2", 4).alias("g2"), F.col("significant")).withColumn("significant", F.col("significant").cast("int")).groupBy("source_type", "inside", "outside", "g2", "significant").agg(F.count(F.lit(1)).alias("n_lines"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.cleaned(table(spark, d, "claims"), table(spark, d, "sources"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.places(table(spark, d, "sources"), "sources", "content").unionByName(pii.places(table(spark, d, "claims"), "claims", "text"))


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "sources"), "sources", "content").unionByName(pii.masked(table(spark, d, "claims"), "claims", "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return containers.assigned(encode.encoded(documents, only_count=True), table(spark, d, "container_specs"), documents.count())


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    return containers.summary(p9_containers(spark, d), table(spark, d, "container_specs"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "reading_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    out = reading.levels(spread(table(spark, d, "documents").select("doc_id", "text", "doc_kind")), table(spark, d, "reading_labels"), keep="doc_kind")
    return out.groupBy("doc_kind", F.round("level").cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n_words"), 1).alias("mean_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_classes, p4_found, p5_found, p6_found, p6_lines, p6_cleaned, p7_found, p7_masked, p8_ids, p9_containers, p9_summary, p10_levels, p10_profile)}
