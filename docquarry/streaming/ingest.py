"""Incremental ingestion as a stream: documents are chunked as they arrive, each name and hash once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators import chunking
from docquarry.plans.ingest import paragraphs
from docquarry.sources.files import cut


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> StreamingQuery:
    """Stream Parquet documents from a folder into target/chunks and target/manifest, all that is there now.

    A document that came before with the same bytes is dropped by the keys (name and hash) that the stream's state keeps, so a batch
    reads nothing of earlier ones; a large corpus wants the session's RocksDB state store. A batch that is run again after a
    failure writes its own folders anew."""

    def batch(rows: DataFrame, number: int) -> None:
        new = cut(rows, "stream")
        chunking.chunks(paragraphs(new)).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        new.select("doc_name", "file_hash", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{target}/manifest/{number}")

    stream = spark.readStream.schema(schema).parquet(source)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = stream.withColumn("doc_name", name).withColumn("file_hash", F.sha2("text", 256)).dropDuplicates(["doc_name", "file_hash"])
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
