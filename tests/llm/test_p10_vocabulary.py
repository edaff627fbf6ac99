"""Difficulties stay on the executors: the driver's memory doesn't grow with the vocabulary."""

import tracemalloc

from pyspark.sql import functions as F

from veristrata.llm import reading

WORDS = 600_000


def test_driver_holds_no_numbers_per_word(spark):
    own = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(WORDS // 300)), lambda i: F.concat(F.lit("w"), F.col("id") * 10_000 + i)))
    common = F.when(F.col("id") % 2 == 0, "plain short ").otherwise("intricate lengthy ")
    docs = spark.range(0, 300, 1, 4).select(F.col("id").alias("doc_id"), F.concat(common, own).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("r").alias("rater"), F.when(F.col("id") % 2 == 0, 1).otherwise(5).alias("grade"))
    tracemalloc.start()
    try:
        out = reading.levels(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < WORDS * 8, peak  # less than a single number per word
    got = out.agg(F.count("level"), F.min("n_words"), F.max("n_words")).first()
    assert tuple(got) == (300, WORDS // 300 + 2, WORDS // 300 + 2)


def test_chunks_do_not_change_levels(spark, monkeypatch):
    docs = spark.range(0, 200, 1, 3).selectExpr("id AS doc_id", "concat('easy', id % 2, ' a', id % 7, ' b', id % 11, ' c', pmod(xxhash64(id), 50)) AS text")
    docs = docs.union(spark.createDataFrame([(None, "easy1 a1"), (300, None), (301, "")], "doc_id long, text string"))
    labels = spark.range(60).selectExpr("id AS doc_id", "'r' AS rater", "CAST(1 + 4 * (id % 2) AS INT) AS grade")
    whole = {r["doc_id"]: r for r in reading.levels(docs, labels).collect()}
    monkeypatch.setattr(reading, "CHUNK_ITEMS", 40)
    small = reading.levels(docs.repartition(5), labels).collect()
    assert len(small) == len(whole) == 203
    assert all(abs(r["level"] - whole[r["doc_id"]]["level"]) < 1e-4 and r["n_words"] == whole[r["doc_id"]]["n_words"] for r in small)
