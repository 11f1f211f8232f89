"""Answering a batch of requests: validate, route, run the workflow, return one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import AGENT
from docquarry.operators import agent, answers, retrieval, routing
from docquarry.sources.files import cut


def validity(query: Column, force: Column, top_k: Column) -> Column:
    """Why a request is refused, or null: two characters at least, 1 to 20 hits, a known workflow."""
    return F.when(query.isNull() | (F.length(query) < 2), "query").when((top_k < 1) | (top_k > 20), "top_k").when(~F.coalesce(force, F.lit("auto")).isin("auto", "simple_rag", "agentic"), "force_workflow")


def validated(requests: DataFrame) -> DataFrame:
    """requests with refused (null where they are valid)."""
    return requests.withColumn("refused", validity(F.col("query"), F.col("force_workflow"), F.col("top_k")))


def effective(routed: DataFrame, requests: DataFrame) -> DataFrame:
    """routed with the workflow that runs: the one a request forces, else the router's. Routing always happens."""
    forced = requests.select("query_id", F.when(F.col("force_workflow").isin("simple_rag", "agentic"), F.col("force_workflow")).alias("forced"))
    return routed.join(forced, "query_id", "left").withColumn("runs", F.coalesce("forced", "workflow")).drop("forced")


def rounded(rows: DataFrame) -> DataFrame:
    """Results as they are handed out: confidence with 4 digits and, if there is one, latency_seconds with 3."""
    out = rows.withColumn("confidence", F.round("confidence", 4))
    return out.withColumn("latency_seconds", F.round("latency_seconds", 3)) if "latency_seconds" in rows.columns else out


def answer(index: retrieval.Index, chunks: DataFrame, requests: DataFrame, embed, provider=None, replies: DataFrame | None = None, assess=None) -> DataFrame:
    """query_id, question, workflow, answer, confidence, status (of the audit), sources (a number), abstained, model_used,
    refused (why a request is not valid; then the others but query_id and question are null).

    requests: query_id, question, force_workflow and, where requests have one, top_k. embed: adds embedding to rows with
    query_id, text and request, the query_id of the request they belong to. top_k (that of the configuration where null) holds for the single-pass workflow; the multi-step one searches less
    for each sub-question, and assess judges what it finds (see agent.searched)."""
    given = requests if "top_k" in requests.columns else requests.withColumn("top_k", F.lit(None).cast("int"))
    given = cut(given.withColumn("refused", validity(F.col("question"), F.col("force_workflow"), F.col("top_k"))), "requests")
    good = given.where("refused is null")
    runs = cut(effective(routing.routed(good.select("query_id", "question"), replies), good).join(good.select("query_id", "top_k"), "query_id"), "routes")
    simple, multi = runs.where("runs = 'simple_rag'"), runs.where("runs = 'agentic'")
    columns = ["query_id", "question", "workflow", "answer", "confidence", "status", "sources", "abstained", "model_used"]

    one = cut(retrieval.search_hybrid(index, embed(simple.select("query_id", F.col("question").alias("text"), "top_k", F.col("query_id").alias("request")))), "hits")
    single = answers.answered(simple.select("query_id", "question"), answers.context(one, chunks), answers.citations(one, chunks), provider)
    single = single.withColumn("sources", F.coalesce(F.array_size("sources"), F.lit(0))).withColumn("status", F.col("audit.status")).select(columns)

    def search(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("key", F.col("query_id") * 16 + F.col("step"))
        found = retrieval.search_hybrid(index, embed(keyed.select(F.col("key").alias("query_id"), F.col("active_query").alias("text"), F.col("query_id").alias("request"))), AGENT.top_k)
        cited = answers.citations(found, chunks, every=True)
        lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_name", "page_number", "section", "score", "snippet"))).alias("hits"))
        return keyed.join(lists.withColumnRenamed("query_id", "key"), "key").select("query_id", "step", "hits")

    steps = cut(agent.searched(agent.planned(multi.select("query_id", "question")), search, assess, cut=cut), "steps")
    rows = multi.select("query_id", "question").join(agent.aggregated_context(steps), "query_id").join(agent.traced(steps), "query_id")
    rows = cut(rows.join(agent.audited_context(agent.evidence(steps)), "query_id", "left"), "evidence")
    some, none = rows.where("not abstained"), rows.where("abstained")
    told = answers.drafted(some, provider, "proof") if provider else some.withColumn("draft", F.col("context")).withColumn("model_used", F.lit("extractive")).withColumn("audit", answers.agent_audit())
    stops = answers.abstains(F.col("audit.status"), F.col("audit.is_grounded"), F.col("audit.supported"), F.col("audit.unsupported"))
    reply = F.when(stops, F.concat(F.lit(answers.ABSTAINS + "\n\n"), "audit.rationale")).otherwise(F.col("draft"))
    told = told.select("query_id", "question", F.lit("agentic").alias("workflow"), reply.alias("answer"), F.col("audit.confidence").alias("confidence"), F.col("audit.status").alias("status"), F.col("unique_chunks").cast("int").alias("sources"), stops.alias("abstained"), "model_used")
    silent = none.select("query_id", "question", F.lit("agentic").alias("workflow"), F.lit(answers.NO_EVIDENCE).alias("answer"), F.lit(0.0).alias("confidence"), F.lit("unsupported").alias("status"), F.lit(0).alias("sources"), F.lit(True).alias("abstained"), F.lit("none").alias("model_used"))
    done = single.unionByName(told).unionByName(silent).withColumn("refused", F.lit(None).cast("string"))
    refused = given.where("refused is not null").select("query_id", "question", "refused")
    return rounded(done.unionByName(refused, allowMissingColumns=True))


def health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, dimension of vectors, documents."""
    dimension = vectors.agg(F.max(F.size("embedding"))).scalar()
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_name").alias("documents")).withColumn("dimension", dimension)


def metadata(catalog: DataFrame) -> DataFrame:
    """What is told of each document of the corpus: its name, title, domain, number of topics, and entities."""
    return catalog.select("doc_name", "title", "domain", F.size("topics").alias("n_topics"), "entities")
