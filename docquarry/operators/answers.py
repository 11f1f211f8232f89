"""Answering over evidence: citations, context, the decision to abstain, and the single-pass workflow.

Model calls sit behind a provider: an object with draft(question, context) and audit(question, draft, context), each over
one string, that raises when no model answers. It is sent to each task once and called over Arrow batches. Without a provider drafts are extractive
(our own addition, marked by the model name "extractive") and audits take their fallback.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import RETRIEVAL, Retrieval
from docquarry.functions.text import citation_label, concise_section, concise_snippet
from docquarry.sources.files import cut

AUDIT = "status string, is_grounded boolean, confidence double, supported array<string>, unsupported array<string>, rationale string"
AUDIT_FIELDS = [x.split()[0] for x in AUDIT.split(", ")]
NO_EVIDENCE = "The indexed documents hold no sufficient evidence to answer this question."
ABSTAINS = "The evidence found doesn't support an answer, so none is given."


def citations(hits: DataFrame, chunks: DataFrame, config: Retrieval = RETRIEVAL, every: bool = False) -> DataFrame:
    """Hits with a score of min_score at least (every: all hits), as citations. hits: query_id, ordinal, score, rank; chunks: ordinal,
    doc_name, page_number, section_path, chunk_id, raw_content (or its snippet), text."""
    # hits are written, so that Spark knows their size and leaves the texts where they are
    good = cut(hits if every else hits.where(F.col("score") >= config.min_score), "hits").join(chunks, "ordinal")
    section = concise_section(F.col("section_path"))
    snippet = F.col("snippet") if "snippet" in chunks.columns else concise_snippet(F.col("raw_content"))
    return good.select("query_id", "rank", "ordinal", "doc_name", "page_number", section.alias("section"), "chunk_id", F.round("score", 4).alias("score"), snippet.alias("snippet"), citation_label(F.col("doc_name"), F.col("page_number"), section).alias("label"))


def context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id and the numbered evidence blocks of its hits, in order of rank."""
    rows = cut(hits, "hits").join(chunks, "ordinal")
    block = F.format_string("--- Evidence [%d] ---\nSource: %s (Page %d, Section: %s)\n%s", "rank", "doc_name", "page_number", "section_path", "text")
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("x"))
    return ordered.select("query_id", F.array_join(F.transform("x", lambda r: r["block"]), "\n\n").alias("context"))


def abstains(status: Column, grounded: Column, supported: Column, unsupported: Column) -> Column:
    """Unsupported, or more claims without support than with it in an answer that isn't grounded."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return (status == "unsupported") | ((size(unsupported) > size(supported)) & ~grounded)


def audit_fallback() -> Column:
    """The audit where no model answers: it lets the draft pass with a confidence of 0.85."""
    return F.expr(f"CAST(named_struct('status', 'supported', 'is_grounded', true, 'confidence', 0.85D, 'supported', array(), 'unsupported', array(), 'rationale', 'no audit was possible') AS STRUCT<{AUDIT.replace(' ', ':').replace(',:', ',')}>)")


def audit_skipped() -> Column:
    """The audit where audits are switched off: a confidence of 0.9."""
    return audit_fallback().withField("confidence", F.lit(0.9)).withField("rationale", F.lit("the audit is switched off"))


def agent_audit() -> Column:
    """The audit of a multi-step answer that none was made for: it passes with a confidence of 0.85."""
    return audit_fallback().withField("rationale", F.lit("the multi-step answer stands without an audit"))


def no_evidence() -> Column:
    """The audit of a question without evidence."""
    return audit_fallback().withField("status", F.lit("unsupported")).withField("is_grounded", F.lit(False)).withField("confidence", F.lit(0.0)).withField("rationale", F.lit("no evidence was found"))


def drafted(rows: DataFrame, provider=None, audited: str = "context") -> DataFrame:
    """rows (query_id, question, context, ...) with draft, model_used and audit. audited: the column of the evidence that an
    audit reads."""
    if provider is None:
        best = F.regexp_extract("context", r"(?s)^--- Evidence \[1\] ---\n[^\n]*\n(.*?)(\n\n--- Evidence \[2\] ---|$)", 1)
        return rows.withColumn("draft", best).withColumn("model_used", F.lit("extractive")).withColumn("audit", audit_fallback())
    asked = rows.select("query_id", "question", F.col("context").alias("evidence"), F.col(audited).alias("proof"))
    schema = f"query_id {rows.schema['query_id'].dataType.simpleString()}, draft string, model_used string, audit struct<{AUDIT.replace(' ', ':').replace(',:', ',')}>"

    def ask(batches):
        for pdf in batches:
            out = []
            for key, question, evidence, proof in pdf.itertuples(index=False):
                draft, model = provider.draft(question, evidence)
                try:
                    audit = provider.audit(question, draft, proof)
                except Exception:  # an audit that fails lets the draft pass
                    audit = ("supported", True, 0.85, [], [], "no audit was possible")
                out.append((key, draft, model, dict(zip(AUDIT_FIELDS, audit, strict=True))))
            yield pd.DataFrame(out, columns=["query_id", "draft", "model_used", "audit"])

    # written, so that no model is asked twice for one question
    return rows.join(cut(asked.mapInPandas(ask, schema), "drafts"), "query_id")


def answered(questions: DataFrame, evidence: DataFrame, cited: DataFrame, provider=None, verify: bool = True) -> DataFrame:
    """The single-pass workflow. questions: query_id, question; evidence: query_id, context; cited: of citations().
    Returns query_id, question, workflow, answer, draft, confidence, sources, audit, abstained, model_used.

    A question without evidence abstains with the default confidence of 1, as one with evidence takes its audit's."""
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_name", "page_number", "section", "chunk_id", "score", "snippet"))).alias("sources"))
    rows = questions.join(evidence, "query_id", "left").join(sources, "query_id", "left")
    some = drafted(rows.where("sources is not null"), provider)
    if not verify:
        some = some.withColumn("audit", audit_skipped())
    stops = abstains(F.col("audit.status"), F.col("audit.is_grounded"), F.col("audit.supported"), F.col("audit.unsupported"))
    some = some.withColumn("abstained", stops).withColumn("answer", F.when(stops, F.concat(F.lit(ABSTAINS + "\n\n"), "audit.rationale")).otherwise(F.col("draft"))).withColumn("confidence", F.col("audit.confidence"))
    none = rows.where("sources is null").withColumn("draft", F.lit("")).withColumn("model_used", F.lit("none")).withColumn("audit", no_evidence()).withColumn("abstained", F.lit(True)).withColumn("answer", F.lit(NO_EVIDENCE)).withColumn("confidence", F.lit(1.0))
    columns = ["query_id", "question", F.lit("simple_rag").alias("workflow"), "answer", "draft", "confidence", "sources", "audit", "abstained", "model_used"]
    return some.select(columns).unionByName(none.select(columns))
