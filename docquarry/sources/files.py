"""Sources and sinks: binary documents, extracted documents, chunks, manifests, evaluation sets."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schemas


#: Folders that documents are dealt to by a hash of their names, where a sink keeps documents apart.
BUCKETS = 256


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a session on one machine
    gets a temporary one, and any other is refused, since each machine would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(context.applicationId, _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="docquarry-"))


def cut(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: plans that follow start from it, and a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession)}/docquarry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of cut() or the like."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if "/docquarry/" in path:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def release(spark: SparkSession) -> None:
    """Let the driver forget its finished jobs now, whereupon executors delete the shuffle files and broadcasts of these. A
    job of many steps would else keep them all until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """df dealt by a hash of a document's name, with the column bucket, each document's rows together in one file."""
    return df.withColumn("bucket", bucket_of(name)).repartition("bucket", name).sortWithinPartitions("bucket", name)


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_name, path, length, file_hash of the files of a folder (not below it), content last, so that it can be pruned.

    No library that reads PDF is available here: a front end turns content into the layout tables of operators.layout
    (schemas.BLOCKS, SPANS, GRIDS), which plans.ingest.layout_tables() reads as JSON lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_name"), "path", "length", content_hash(F.col("content")).alias("file_hash"), "content")


def content_hash(c) -> F.Column:
    """SHA-256 of a file's bytes, in hexadecimal digits."""
    return F.sha2(c, 256)


def complete(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """The rows of a manifest whose document is among those with outputs (doc_name)."""
    return manifest.join(outputs.select("doc_name").distinct(), "doc_name", "left_semi")


def pending(found: DataFrame, manifest: DataFrame | None, force: bool = False) -> DataFrame:
    """Documents to extract: all if forced, else those whose name and hash the manifest lacks."""
    if force or manifest is None:
        return found
    return found.join(manifest.select("doc_name", "file_hash"), ["doc_name", "file_hash"], "left_anti")


def cached(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose last extraction still holds."""
    return found.join(manifest.select("doc_name", "file_hash"), ["doc_name", "file_hash"], "left_semi")


def extraction_manifest(docs: DataFrame) -> DataFrame:
    """One row of totals over documents (doc_name, status, pages, elements, tables, code_blocks, seconds); cached documents
    count too. No documents give no row. The documents themselves stay a table: see write_manifest()."""
    rows = docs.agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(f"total_{c}") for c in ("pages", "elements", "tables", "code_blocks")), F.round(F.sum("seconds"), 3).alias("seconds"))
    return rows.where("documents > 0")


def write_manifest(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents of an extraction to path/documents, and return their totals."""
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    return extraction_manifest(docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/documents"))


def bucket_of(name) -> F.Column:
    """The folder of a document."""
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _write_json(rows: DataFrame, name: str, path: str, only: bool) -> None:
    mode = "dynamic" if only else "static"
    bucketed(rows, name).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").json(path)


def _read_json(spark: SparkSession, schema: str, path: str, buckets: list[int] | None) -> DataFrame:
    rows = spark.read.schema(f"{schema}, bucket int").json(path)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")


def write_markdown(markdown: DataFrame, path: str, only: bool = False) -> None:
    """Markdown of documents (doc, markdown) as JSON lines, dealt to folders by a hash of the name. only: folders of other
    documents stay as they are."""
    _write_json(markdown.select("doc", "markdown"), "doc", path, only)


def write_elements(elements: DataFrame, path: str, only: bool = False) -> None:
    """Elements as JSON lines, dealt to folders by a hash of the document's name. only: as in write_markdown()."""
    _write_json(elements, "doc_name", path, only)


def read_elements(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Elements that write_elements() wrote, of all folders or of some."""
    return _read_json(spark, schemas.ELEMENTS, path, buckets)


def read_markdown(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """doc and markdown that write_markdown() wrote, of all folders or of some."""
    return _read_json(spark, "doc string, markdown string", path, buckets)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks of all documents as Parquet, in folders by a hash of the name, so that a document is found in one of them."""
    bucketed(chunks, "doc_name").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str, doc_name: str | None = None) -> DataFrame:
    """Chunks that write_chunks() wrote, of all documents or of one."""
    rows = spark.read.schema(f"{schemas.CHUNKS}, bucket int").parquet(path)
    if doc_name is not None:
        rows = rows.where((F.col("bucket") == bucket_of(F.lit(doc_name))) & (F.col("doc_name") == doc_name))
    return rows.drop("bucket")


def chunks_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON array; rows that don't fit the schema raise an error."""
    return spark.read.schema(schemas.CHUNKS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array."""
    return spark.read.schema(schemas.EVAL_DATASET).option("multiLine", True).json(path)


def write_evaluation(summary: DataFrame, details: DataFrame, path: str) -> None:
    """The summary and the detail rows as JSON."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")
