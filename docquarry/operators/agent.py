"""The multi-step workflow over a batch of questions: plan, search and rewrite in rounds, gather evidence, decide.

Sub-questions of all questions are searched together, so a round is one plan however many questions there are. Replies
of models come as tables or functions of DataFrames; where none answers, the fallbacks hold: the question itself as the
plan, any evidence as sufficient, and the first five longer words as the rewrite.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.config import AGENT, Agent
from docquarry.functions.text import keywords


def planned(questions: DataFrame, plans: DataFrame | None = None, config: Agent = AGENT) -> DataFrame:
    """query_id, step, sub_question: up to the limit of a plan's sub-questions, or the question. plans: query_id, sub_questions."""
    rows = questions.withColumn("sub_questions", F.lit(None).cast("array<string>")) if plans is None else questions.join(plans, "query_id", "left")
    some = F.when(F.coalesce(F.array_size("sub_questions"), F.lit(0)) > 0, F.col("sub_questions")).otherwise(F.array("question"))
    return rows.select("query_id", F.posexplode(F.slice(some, 1, config.sub_questions)).alias("step", "sub_question")).withColumn("step", F.col("step") + 1)


Search = Callable[[DataFrame], DataFrame]
Assess = Callable[[DataFrame], DataFrame]


def searched(steps: DataFrame, search: Search, assess: Assess | None = None, config: Agent = AGENT, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Search, assess and rewrite each sub-question, in rounds of all that are still open.

    search: rows with query_id, step, active_query to rows with query_id, step and hits (an array of structs). assess: rows with
    sub_question, active_query, hits to the same with sufficient and suggested. A sub-question with hits keeps those of
    its last search that had any; without hits it is rewritten unassessed. cut: writes a round's table and rereads it, so
    that a round's searches run once; rounds then end as soon as nothing is open."""
    open_ = steps.withColumn("active_query", F.col("sub_question")).withColumn("rewrites", F.array().cast("array<string>")).withColumn("best", F.lit(None))
    done: DataFrame | None = None
    last = config.rewrites + 1
    for attempt in range(1, last + 1):
        found = search(open_.select("query_id", "step", "active_query"))
        rows = open_.join(found, ["query_id", "step"], "left")
        if assess:
            rows = assess(rows)
        else:
            rows = rows.withColumn("sufficient", F.lit(True)).withColumn("suggested", F.lit(None).cast("string"))
        some = F.coalesce(F.array_size("hits"), F.lit(0)) > 0
        previous = F.lit(None).cast(rows.schema["hits"].dataType) if attempt == 1 else F.col("best")
        rows = rows.withColumn("best", F.when(some, F.col("hits")).otherwise(previous)).withColumn("sufficient", some & F.coalesce("sufficient", F.lit(True))).withColumn("attempts", F.lit(attempt))
        if cut:
            rows = cut(rows, f"round-{attempt}")
        ends = F.lit(attempt == last) | F.col("sufficient")
        columns = ["query_id", "step", "sub_question", "active_query", "rewrites", "attempts", "best", "sufficient"]
        ended = rows.where(ends).select(columns)
        done = ended if done is None else done.unionByName(ended)
        if cut and attempt < last and not rows.where(~ends).head(1):
            return done
        if attempt < last:
            rewrite = F.coalesce(F.when(F.col("suggested") != "", F.col("suggested")), keywords(F.col("sub_question")))
            open_ = rows.where(~ends).select("query_id", "step", "sub_question", rewrite.alias("active_query"), F.array_append("rewrites", rewrite).alias("rewrites"), "best")
    return done


def evidence(steps: DataFrame) -> DataFrame:
    """query_id, source_no, step, and the fields of a hit: hits of all steps, each chunk_id once, at its first place."""
    rows = steps.select("query_id", "step", F.posexplode("best").alias("place", "hit")).select("query_id", "step", "place", "hit.*")
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("step", "place"))
    once = rows.withColumn("first", first).where("first = 1").drop("first")
    return once.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "place"))).drop("place")


def audited(sources: DataFrame, config: Agent = AGENT) -> DataFrame:
    """The sources that an audit reads: the first eight of a question."""
    return sources.where(F.col("source_no") <= config.audited)


def audited_context(sources: DataFrame, config: Agent = AGENT) -> DataFrame:
    """query_id and proof: a line for each source that an audit reads."""
    line = F.format_string("- [%s, p.%d]: %s", "doc_name", "page_number", "snippet")
    rows = audited(sources, config).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_no", line.alias("line")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("proof"))


def assessed(ask: Callable[[str, str, list], tuple[bool, str]]) -> Assess:
    """An assessment of evidence by a model. ask: sub-question, active query and snippets of the hits to whether they are
    sufficient and another query; where it raises, the evidence is sufficient."""

    def judge(batches):
        for pdf in batches:
            out = []
            for key, step, sub, query, snippets in pdf.itertuples(index=False):
                try:
                    enough, other = ask(sub, query, list(snippets) if snippets is not None else [])
                except Exception:  # no model answers: any evidence will do
                    enough, other = True, ""
                out.append((key, step, bool(enough), other or None))
            yield pd.DataFrame(out, columns=["query_id", "step", "sufficient", "suggested"])

    def assess(rows: DataFrame) -> DataFrame:
        asked = rows.where(F.array_size("hits") > 0).select("query_id", "step", "sub_question", "active_query", F.transform("hits", lambda h: h["snippet"]).alias("snippets"))
        kind = rows.schema["query_id"].dataType.simpleString()
        return rows.join(asked.mapInPandas(judge, f"query_id {kind}, step int, sufficient boolean, suggested string"), ["query_id", "step"], "left")

    return assess


def aggregated_context(steps: DataFrame) -> DataFrame:
    """query_id and one text: a heading for each step and a line for each of its hits."""
    line = lambda h: F.format_string("- [%s, p.%d, %s]: %s", h["doc_name"], h["page_number"], h["section"], h["snippet"])
    head = F.format_string("### Sub-Question %d: %s", "step", "sub_question")
    block = F.array_join(F.concat(F.array(head), F.coalesce(F.transform("best", line), F.array().cast("array<string>"))), "\n")
    rows = steps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step", block.alias("block")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["block"]), "\n\n").alias("context"))


def traced(steps: DataFrame) -> DataFrame:
    """Per question: steps, attempts, total_rewrites, unique_chunks and whether it abstains for want of evidence."""
    counts = steps.groupBy("query_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("attempts").alias("attempts"), F.sum(F.size("rewrites")).alias("total_rewrites"))
    chunks = evidence(steps).groupBy("query_id").agg(F.count(F.lit(1)).alias("unique_chunks"))
    return counts.join(chunks, "query_id", "left").withColumn("unique_chunks", F.coalesce("unique_chunks", F.lit(0))).withColumn("abstained", F.col("unique_chunks") == 0)
