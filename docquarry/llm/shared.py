"""What the training-data operators share: reading tables, Arrow batch sizes, and tables written to the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.files import shared_folder

#: The white space that ends a word, and the words themselves, as Java, DuckDB and Python regular expressions read them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so any store that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 128, mb: int = 4) -> None:
    """Keep Arrow batches small, so that a Python worker holds a few long texts at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/docquarry/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs only a reread."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch()."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if "/docquarry/" in path:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, name)


def release(spark: SparkSession) -> None:
    """Let the driver forget its finished jobs now, whereupon executors delete the shuffle files and broadcasts of these. A
    job of many steps would else keep them all until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text) -> F.Column:
    """The words of a text column, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text) -> F.Column:
    """How many words a text column has, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., and the new name of each, so that an operator's own columns can't clash with df's."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
