"""Routing: how complex a question is, by rules or by features that a model named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import ROUTING, Routing
from docquarry.functions.text import SPACE, stripped

# The words of the rules.
COMPARISON = ("compare", "versus", "vs", "difference between", "trade-off", "tradeoff", "better than")
SEVERAL_DOCS = ("and", "both", "across all", "compare vector database and rag")
PLANNING = ("how should i design", "how to implement", "production architecture", "step by step", "security considerations")
CALCULATION = ("calculate", "formula", "compute", "cost at scale")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def rule_flags(question: Column) -> dict[str, Column]:
    """The four rules: words anywhere in the lower-cased question; several documents also takes over 8 words."""
    q = F.lower(question)
    n = F.size(F.filter(F.split(stripped(question), f"{SPACE}+"), lambda w: w != ""))
    return {"comparison": _any(q, COMPARISON), "several_docs": _any(q, SEVERAL_DOCS) & (n > 8), "planning": _any(q, PLANNING), "calculation": _any(q, CALCULATION)}


def rule_routed(questions: DataFrame, config: Routing = ROUTING, *, text_col: str = "question") -> DataFrame:
    """questions with the rules' flags, total_score, threshold, workflow and model_used."""
    weights = dict(config.weights)
    of = {"comparison": "requires comparison", "several_docs": "requires multiple documents", "planning": "requires planning or multi-step reasoning", "calculation": "requires calculations or external tools"}
    rows = questions.withColumns(rule_flags(F.coalesce(F.col(text_col), F.lit(""))))
    score = reduce(lambda a, b: a + b, [F.when(F.col(f), weights[name]).otherwise(0) for f, name in of.items()])
    rows = rows.withColumn("total_score", score).withColumn("threshold", F.lit(config.threshold))
    return rows.withColumn("workflow", F.when(F.col("total_score") >= config.threshold, "agentic").otherwise("simple_rag")).withColumn("model_used", F.lit("rule_based_fallback"))


def feature_weight(name: Column, config: Routing = ROUTING) -> Column:
    """Weight of the first rubric feature whose name holds the given one or is held by it; an empty name is held by all."""
    n = stripped(F.lower(F.coalesce(name, F.lit(""))))
    found = F.coalesce(*(F.when(n.contains(k) | F.lit(k).contains(n), w) for k, w in config.weights))
    return F.coalesce(found, F.lit(0))


def rubric_scored(replies: DataFrame, config: Routing = ROUTING) -> DataFrame:
    """replies: query_id, features array<struct<feature, present>>, total_score (of the model, may be null). Returns them
    with features scored by the rubric, total_score (the larger of the sum and the model's) and workflow."""
    scored = F.transform("features", lambda f: F.struct(f["feature"].alias("feature"), F.coalesce(f["present"], F.lit(False)).alias("present"), F.when(F.coalesce(f["present"], F.lit(False)), feature_weight(f["feature"], config)).otherwise(0).alias("score")))
    rows = replies.withColumn("features", F.coalesce(scored, F.expr("array()").cast("array<struct<feature:string,present:boolean,score:int>>")))
    total = F.aggregate("features", F.lit(0), lambda acc, f: acc + f["score"])
    rows = rows.withColumn("total_score", F.greatest(total, F.coalesce(F.col("total_score").cast("int"), total)))
    return rows.withColumn("workflow", F.when(F.col("total_score") >= config.threshold, "agentic").otherwise("simple_rag"))


def routed(questions: DataFrame, replies: DataFrame | None = None, config: Routing = ROUTING) -> DataFrame:
    """query_id, question, total_score, workflow, model_used: by a reply's features where there is one, else by rules."""
    rules = rule_routed(questions, config).select("query_id", "question", "total_score", "workflow", "model_used")
    if replies is None:
        return rules
    told = rubric_scored(replies, config).select("query_id", F.col("total_score").alias("t"), F.col("workflow").alias("w"))
    both = rules.join(told, "query_id", "left")
    return both.select("query_id", "question", F.coalesce("t", "total_score").alias("total_score"), F.coalesce("w", "workflow").alias("workflow"), F.when(F.col("w").isNotNull(), "model").otherwise(F.col("model_used")).alias("model_used"))


def corpus_context(catalog: DataFrame) -> DataFrame:
    """One text that lists a catalogue (ord, doc_name, title, domain, topics, summary) for a router."""
    entry = F.format_string("\nDocument: %s\n  Title: %s\n  Domain: %s\n  Key Topics: %s\n  Summary: %s", "doc_name", "title", "domain", F.array_join("topics", ", "), "summary")
    rows = catalog.agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("x"))
    return rows.select(F.concat_ws("\n", F.lit("Available Knowledge Base Documents and Coverage:"), F.transform("x", lambda r: r["entry"])).alias("context"))
