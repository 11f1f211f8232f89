"""Ingest documents: keeps a store of chunks up to date with a growing folder of documents.

Each run takes the files that have come since the last one (a file stream with a checkpoint), drops documents that came before with the same
bytes, cuts the others into chunks, and appends them:

    target/chunks/batch=N/section_path=S    the chunks of the documents that batch N brought
    target/versions/batch=N                 doc_id, file_hash, chunks, tokens of each of these documents

A document that comes again with other bytes is a new version; current() shows the newest of each. Nothing is ever
rewritten but the folders of a batch that failed: it is run again over the same files and replaces what it wrote.

    spark-submit jobs/job1_ingest.py --source hdfs:///documents --target hdfs:///store --checkpoint hdfs:///marks --config jobs/job1_ingest.json
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import Chunking
from docquarry.operators import chunking
from docquarry.plans.ingest import paragraphs
from jobs.common import command, log

VERSIONS = "doc_id long, file_hash string, chunks long, tokens long, batch long"
CHUNKS = "doc_id long, chunk_id string, parent_id string, doc_name string, page_number int, element_type string, text string, raw_content string, token_count int, char_count int, ordinal int, batch long, section_path string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    """Columns of the documents, files of a batch at most, and the budgets of chunks."""

    id_column: str = "doc_id"
    text_column: str = "text"
    section_column: str = "lang"
    files_per_batch: int = 1000
    target_tokens: int = 400
    most_tokens: int = 600
    overlap_tokens: int = 50

    def chunking(self) -> Chunking:
        return Chunking(target=self.target_tokens, most=self.most_tokens, overlap=self.overlap_tokens)


def _appended(df: DataFrame, path: str, *partitions: str) -> None:
    """Write df below path, replacing only the partitions it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Settings = Settings()) -> int:
    """Take all files of the source (Parquet with the columns of the settings) that are new to the checkpoint; returns how
    many documents were written. Rows without an id are counted in the log and left out. Of several versions of a document within
    one batch the one with the largest hash counts."""
    schema = f"`{config.id_column}` long, `{config.text_column}` string, `{config.section_column}` string"
    own = {"doc_id": config.id_column, "text": config.text_column, "section": config.section_column}
    written = []

    def batch(rows: DataFrame, number: int) -> None:
        # the batch is read several times below, and its state must be read once
        stage = f"{checkpoint}/staged/batch={number}"
        rows.write.mode("overwrite").parquet(stage)
        staged = spark.read.schema(rows.schema).parquet(stage)
        newest = staged.groupBy("doc_id").agg(F.max_by(F.struct("text", "section"), "file_hash").alias("x"), F.max("file_hash").alias("file_hash"))
        docs = newest.select("doc_id", "file_hash", "x.*")
        els = paragraphs(docs, id_col="doc_id", text_col="text", section_col="section")
        made = chunking.chunks(els, config.chunking())
        number_of = F.regexp_extract("doc_name", "doc_(-?[0-9]+)[.]pdf$", 1).cast("long").alias("doc_id")
        _appended(made.select(number_of, *made.columns, F.lit(number).cast("long").alias("batch")).drop("is_split_table", "part"), f"{target}/chunks", "batch", "section_path")
        chunks = spark.read.schema(CHUNKS).parquet(f"{target}/chunks").where(F.col("batch") == number)
        sums = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        _appended(docs.join(sums, "doc_id", "left").select("doc_id", "file_hash", zero("chunks"), zero("tokens"), F.lit(number).cast("long").alias("batch")), f"{target}/versions", "batch")
        done = spark.read.schema(VERSIONS).parquet(f"{target}/versions").where(F.col("batch") == number)
        totals = done.agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).first()
        written.append(totals.n)
        log.info("batch %d: wrote %d documents, %d chunks, %d tokens to %s", number, totals.n, totals.chunks or 0, totals.tokens or 0, target)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, _ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(source)
        rows = stream.select(*(F.col(c).alias(n) for n, c in own.items())).where("doc_id is not null")
        # a document that came before with the same bytes is dropped by the keys that the state keeps
        rows = rows.withColumn("section", F.coalesce("section", F.lit(""))).withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", "file_hash"])
        query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
        log.info("read %d rows of %s, wrote %d documents in %d batches", sum(p["numInputRows"] for p in query.recentProgress), source, sum(written), len(written))
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return sum(written)


def versions(spark: SparkSession, target: str) -> DataFrame:
    """Every version of every document."""
    return spark.read.schema(VERSIONS).parquet(f"{target}/versions")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of the newest version of each document."""
    newest = versions(spark, target).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CHUNKS).parquet(f"{target}/chunks").join(newest, ["doc_id", "batch"], "left_semi")


if __name__ == "__main__":
    command(__doc__, ("source", "target", "checkpoint"), Settings, run)
