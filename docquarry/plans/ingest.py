"""Jobs of ingestion: elements to chunks to an index, each step a table that the next one reads."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.config import CHUNKING, Chunking
from docquarry.functions.text import trimmed
from docquarry.operators import chunking, layout, retrieval
from docquarry.sources import files
from docquarry.sources.files import cut


def paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", section_col: str = "lang") -> DataFrame:
    """Elements of plain texts: each line that isn't blank is a paragraph."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), trimmed), lambda x: x != "")
    rows = docs.select(F.concat(F.lit("doc_"), F.col(id_col).cast("string"), F.lit(".pdf")).alias("doc_name"), F.posexplode(lines).alias("ord", "content"), F.col(section_col).alias("section"))
    return rows.select("doc_name", "ord", F.lit(1).alias("page_number"), F.lit("paragraph").alias("element_type"), "content", "section")


def layout_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, spans and grids from JSON lines in folder/blocks, folder/spans and folder/grids: what a front end writes for
    each document it reads. Rows that don't fit the schema raise an error."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}")
    return read("blocks", schemas.BLOCKS), read("spans", schemas.SPANS), read("grids", schemas.GRIDS)


def _found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """A table of an earlier run, or None if there is none."""
    try:
        return read()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


#: The manifest of an extraction, a row for each document.
MANIFEST = "doc_name string, file_hash string, status string, pages int, elements long, tables long, code_blocks long, seconds double"


def extract_job(blocks: DataFrame, spans: DataFrame, grids: DataFrame, path: str, hashes: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Extract elements from layout tables; write them as JSON, their Markdown, and a manifest; returns the totals.

    hashes: doc_name, file_hash. A document that an earlier run at path extracted from the same bytes, and whose elements
    and Markdown are both there, is kept as it is and counts as cached, unless forced. Without hashes all are extracted.
    Only the folders of documents that are new, changed or gone are written; if such a folder would end up empty, all are.
    The manifest comes last: after a failure before, the next run finds no new hashes in it and extracts these documents
    again. If there is no document at all, FileNotFoundError is raised."""
    spark = blocks.sparkSession
    names = blocks.select(F.col("doc").alias("doc_name")).distinct()
    found = cut(names.join(hashes, "doc_name", "left") if hashes is not None else names.withColumn("file_hash", F.lit(None).cast("string")), "found")
    before = _found(lambda: spark.read.schema(MANIFEST).parquet(f"{path}/documents"))
    old_rows, old_markdown = _found(lambda: files.read_elements(spark, f"{path}/elements")), _found(lambda: files.read_markdown(spark, f"{path}/markdown"))
    if before is not None and old_rows is not None and old_markdown is not None and not force:
        before = files.complete(files.complete(before, old_rows), old_markdown.withColumnRenamed("doc", "doc_name"))
        kept = cut(files.cached(found, before), "kept")
    else:
        before, kept = None, found.limit(0)
    new = cut(files.pending(found, before, force).select(F.col("doc_name").alias("doc")), "new")
    some = lambda df: df.join(new, "doc", "left_semi")
    made = layout.elements(some(blocks), some(spans), some(grids))
    rows = cut(made.select(F.col("doc").alias("doc_name"), "ord", F.col("page").alias("page_number"), "element_type", "content", "section"), "elements")
    as_elements = lambda df: df.select(F.col("doc_name").alias("doc"), F.col("page_number").alias("page"), "ord", "element_type", "content")
    markdown = layout.full_markdown(as_elements(rows))
    buckets = None
    if before is not None:
        # at most BUCKETS numbers; what lies in other folders is neither read nor written
        named = new.select(F.col("doc").alias("doc_name"))
        for there in (old_rows.select("doc_name"), old_markdown.select(F.col("doc").alias("doc_name"))):
            named = named.unionByName(there.distinct().join(found, "doc_name", "left_anti"))
        buckets = sorted(r[0] for r in named.select(files.bucket_of(F.col("doc_name"))).distinct().collect())
        stay = kept.select("doc_name")
        filled = {r[0] for r in rows.select("doc_name").unionByName(stay).select(files.bucket_of(F.col("doc_name"))).distinct().collect()}
        if not filled >= set(buckets):
            buckets = list(range(files.BUCKETS))
        # the new rows stand in the shared folder before the old ones are replaced
        rows = cut(rows.unionByName(files.read_elements(spark, f"{path}/elements", buckets).join(stay, "doc_name", "left_semi")), "elements")
        markdown = cut(markdown.unionByName(files.read_markdown(spark, f"{path}/markdown", buckets).join(stay.withColumnRenamed("doc_name", "doc"), "doc", "left_semi")), "markdown")
    if not rows.head(1) and not kept.head(1):
        raise FileNotFoundError("there is no document to extract")
    only = buckets is not None and len(buckets) < files.BUCKETS
    files.write_elements(rows, f"{path}/elements", only)
    files.write_markdown(markdown, f"{path}/markdown", only)
    els = as_elements(files.read_elements(spark, f"{path}/elements"))
    pages = els.groupBy("doc").agg(F.max("page").alias("pages"), F.count(F.lit(1)).alias("elements")).join(layout.doc_statistics(els), "doc").withColumnRenamed("doc", "doc_name")
    status = F.when(F.col("cached"), "cached").otherwise("extracted")
    docs = found.join(kept.select("doc_name", F.lit(True).alias("cached")), "doc_name", "left").join(pages, "doc_name")
    return files.write_manifest(docs.select("doc_name", "file_hash", status.alias("status"), "pages", "elements", "tables", "code_blocks", F.lit(0.0).alias("seconds")), path)


def chunk_job(spark: SparkSession, elements_path: str, chunks_path: str, config: Chunking = CHUNKING) -> DataFrame:
    """Chunk the extracted elements at a path; write the chunks, and their manifest by type and by document; returns that by
    type. FileNotFoundError if there are no elements."""
    els = _found(lambda: files.read_elements(spark, elements_path))
    if els is None or not els.head(1):
        raise FileNotFoundError(f"there are no elements at {elements_path}")
    files.write_chunks(chunking.chunks(els, config), chunks_path)
    made = files.read_chunks(spark, chunks_path)
    for by in ("element_type", "doc_name"):
        chunking.manifest(made, by).write.mode("overwrite").parquet(f"{chunks_path}-manifest/{by}")
    return spark.read.parquet(f"{chunks_path}-manifest/element_type")


def index_job(spark: SparkSession, chunks_path: str, index_path: str, vectors: DataFrame | None = None, probe: str | None = None) -> retrieval.Index:
    """Build, save and reload the index of the chunks at a path. probe: a question that must find a chunk by its words, or
    RuntimeError is raised. A chunk's ordinal is its place in the order of documents
    and chunks, which is made by ranges, not in one task."""
    rows = files.read_chunks(spark, chunks_path).repartitionByRange("doc_name", "ordinal").sortWithinPartitions("doc_name", "ordinal")
    numbered = rows.withColumn("ordinal", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{index_path}/chunks")
    numbered = spark.read.parquet(f"{index_path}/chunks")
    retrieval.build(numbered, vectors, id_col="ordinal").save(index_path)
    index = retrieval.load(spark, index_path)
    if probe is not None and not retrieval.search_sparse(index, spark.createDataFrame([(0, probe)], "query_id long, text string"), 3).head(1):
        raise RuntimeError(f"nothing is found for: {probe}")
    return index


def main(arguments: list[str] | None = None) -> None:
    """The jobs from a command line: extract, chunk, index."""
    parser = argparse.ArgumentParser(prog="python -m docquarry.plans.ingest", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    extract = jobs.add_parser("extract", help="layout tables to elements")
    extract.add_argument("--input-dir", required=True, help="folder with blocks, spans and grids")
    extract.add_argument("--documents-dir", help="folder with the documents themselves, for their hashes")
    extract.add_argument("--force", action="store_true", help="extract what was extracted before, too")
    chunk = jobs.add_parser("chunk", help="elements to chunks")
    index = jobs.add_parser("index", help="chunks to an index")
    index.add_argument("--probe", help="a question that must find something")
    for job in (chunk, index):
        job.add_argument("--input-dir", required=True)
    for job in (extract, chunk, index):
        job.add_argument("--output-dir", required=True)
        job.add_argument("-v", "--verbose", action="store_true", help="show the manifest")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"docquarry {a.job}").getOrCreate()
    if a.job == "extract":
        hashes = files.documents(spark, a.documents_dir).select("doc_name", "file_hash") if a.documents_dir else None
        out = extract_job(*layout_tables(spark, a.input_dir), a.output_dir, hashes, a.force)
    elif a.job == "chunk":
        out = chunk_job(spark, a.input_dir, a.output_dir)
    else:
        made = index_job(spark, a.input_dir, a.output_dir, probe=a.probe)
        out = spark.createDataFrame([(made.n_docs, made.avgdl)], "chunks long, mean_words double")
    if a.verbose:
        out.show(truncate=False)


if __name__ == "__main__":
    main()
