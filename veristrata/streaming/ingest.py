"""Streaming ingest: new files of sources become claims in the store.

Each micro-batch is compiled like a corpus and committed to the store. Ids are content-addressed and a commit only adds
ids that the store doesn't hold, so a batch that is replayed after a failure adds nothing twice, and the result doesn't
depend on how the input was cut into batches. Mined shapes need the whole corpus and are left to a batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veristrata.operators.compile import compile_corpus
from veristrata.store import Store

SCHEMA = "uri string, content string, source_type string"


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Start a query that compiles Parquet files of (uri, content, source_type) as they appear in folder, until all there now are done."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def commit(batch: DataFrame, number: int) -> None:
        done = compile_corpus(batch)
        tables = done.tables()
        tables["claims"] = done.claims
        del tables["claim_edges"]
        Store(spark, store).commit(tables)

    return reader.parquet(folder).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
