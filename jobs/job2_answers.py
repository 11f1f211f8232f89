"""Answer questions: finds the evidence for a batch of questions in a corpus, and writes answers with citations.

Reads a table of texts and a table of conversations, whose user turns are the questions. It indexes the texts, routes each
question by the rules, ranks the texts by BM25, and abstains where nothing scores high enough:

    target/index                     the index: postings by term, lengths, term statistics
    target/answers/workflow=W        a row for each question: its route, what was found, the best snippet, whether it abstains
    target/citations/workflow=W      a row for each text cited, by rank
    target/report                    questions, answers and mean scores of each workflow

Every output is a function of the two tables and the settings, and replaces that of an earlier run.

    spark-submit jobs/job2_answers.py --texts hdfs:///documents --conversations hdfs:///conversations --target hdfs:///answers --config jobs/job2_answers.json
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import concise_snippet
from docquarry.operators import answers, retrieval, routing
from docquarry.sources.files import cut, forget, release
from jobs.common import command, log


ANSWERS = "query_id string, conv_id long, turn long, question string, total_score int, sources int, score double, answer string, abstained boolean, workflow string"
CITATIONS = "query_id string, rank int, ordinal long, doc_name string, page_number int, section string, chunk_id string, score double, snippet string, label string, workflow string"


@dataclass(frozen=True)
class Settings:
    """Columns of the texts, who asks, citations of a question at most, and the least score of one."""

    id_column: str = "doc_id"
    text_column: str = "text"
    name_column: str = "source"
    section_column: str = "lang"
    role: str = "user"
    citations: int = 5
    least_score: float = 2.0


def questions(conversations: DataFrame, role: str) -> DataFrame:
    """query_id, conv_id, turn, question: the turns of a role that have text; of turns that come twice the first text."""
    rows = conversations.where((F.col("role") == role) & (F.length(F.trim("text")) > 0)).groupBy("conv_id", "turn").agg(F.min("text").alias("question"))
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", "question")


def run(spark: SparkSession, texts: str, conversations: str, target: str, config: Settings = Settings()) -> int:
    """Answer the questions of a table of conversations from a table of texts (both Parquet); returns how many were answered."""
    corpus = spark.read.parquet(texts)
    asked = questions(spark.read.parquet(conversations), config.role)
    built = retrieval.build(corpus, id_col=config.id_column, text_col=config.text_column)
    built.save(f"{target}/index")
    built.forget()
    index = retrieval.load(spark, f"{target}/index")
    log.info("read %d texts of %s (%.1f words on average)", index.n_docs, texts, index.avgdl)

    routes = routing.routed(asked.select("query_id", "question")).select("query_id", "total_score", "workflow")
    hits = retrieval.search_sparse(index, asked.select("query_id", F.col("question").alias("text")), config.citations)
    good = hits.where(F.col("score") >= config.least_score)
    chunks = corpus.select(F.col(config.id_column).alias("ordinal"), F.col(config.name_column).alias("doc_name"), F.lit(1).alias("page_number"), F.coalesce(F.col(config.section_column), F.lit("")).alias("section_path"), F.concat(F.lit("chunk_"), F.col(config.id_column).cast("string")).alias("chunk_id"), concise_snippet(F.col(config.text_column)).alias("snippet"))
    # a text is cut to its snippet once, however many questions cite it, and no whole text is joined
    chunks = cut(chunks, "snippets")
    cited = answers.citations(good, chunks, every=True).join(routes.select("query_id", "workflow"), "query_id")
    cited.repartition("workflow", "query_id").write.mode("overwrite").partitionBy("workflow").parquet(f"{target}/citations")
    forget(chunks)
    release(spark)

    best = spark.read.schema(CITATIONS).parquet(f"{target}/citations").groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.max("score").alias("score"), F.min_by("snippet", "rank").alias("answer"))
    rows = asked.join(routes, "query_id").join(best, "query_id", "left")
    none = F.col("sources").isNull()
    rows = rows.select("query_id", "conv_id", "turn", "question", "total_score", F.coalesce("sources", F.lit(0)).cast("int").alias("sources"), "score", F.when(none, answers.NO_EVIDENCE).otherwise(F.col("answer")).alias("answer"), none.alias("abstained"), "workflow")
    rows.write.mode("overwrite").partitionBy("workflow").parquet(f"{target}/answers")
    done = read(spark, target)
    done.groupBy("workflow").agg(F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("abstained")).alias("answered"), F.round(F.avg("score"), 4).alias("mean_score")).write.mode("overwrite").parquet(f"{target}/report")
    answered = 0
    for r in spark.read.schema("workflow string, questions long, answered long, mean_score double").parquet(f"{target}/report").orderBy("workflow").collect():
        answered += r.answered
        log.info("wrote %d of %d questions of %s answered to %s", r.answered, r.questions, r.workflow, target)
    return answered


def read(spark: SparkSession, target: str) -> DataFrame:
    """The answers of the last run."""
    return spark.read.schema(ANSWERS).parquet(f"{target}/answers")


def with_citations(spark: SparkSession, target: str) -> DataFrame:
    """Each question with its citations; one without any has a row of nulls."""
    cited = spark.read.schema(CITATIONS).parquet(f"{target}/citations").drop("workflow").withColumnRenamed("score", "cited_score")
    return read(spark, target).join(cited, "query_id", "left")


if __name__ == "__main__":
    command(__doc__, ("texts", "conversations", "target"), Settings, run)
