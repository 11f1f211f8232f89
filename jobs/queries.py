"""The jobs as queries over the given tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquarry import oracles, queries
from docquarry.operators.answers import NO_EVIDENCE
from docquarry.sources.files import shared_folder
from jobs import job1_ingest, job2_answers


def job1_ingest_documents(spark, sf_dir):
    """The chunks in the store after two runs over documents; the second finds nothing new. The table may be one file, and a
    file stream takes folders and patterns, so it is named by a pattern."""
    folder = f"{shared_folder(spark)}/docquarry/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        job1_ingest.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/store", f"{folder}/checkpoint")
    return job1_ingest.current(spark, f"{folder}/store").drop("batch")


def job2_answer_questions(spark, sf_dir):
    """The answers with their citations after two runs over documents and conversations."""
    folder = f"{shared_folder(spark)}/docquarry/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        job2_answers.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", folder)
    rows = job2_answers.with_citations(spark, folder)
    return rows.select("conv_id", "turn", "question", "workflow", "total_score", "sources", "answer", "abstained", "rank", F.col("ordinal").alias("doc_id"), F.round("cited_score", 4).alias("cited_score"), "snippet", "label")


_INGEST_SQL = f"SELECT regexp_extract(doc_name, 'doc_(-?[0-9]+)', 1)::BIGINT AS doc_id, chunk_id, parent_id, doc_name, page_number, element_type, text, raw_content, token_count, char_count, ordinal, section_path FROM ({oracles.chunks(oracles.PARAGRAPHS)})"

_SETTINGS = job2_answers.Settings()
_TERMS = queries._TERMS
_ANSWERS_SQL = f"""WITH {queries._POSTINGS}, {queries._STATS}, {queries._IDF},
    turns AS (SELECT conv_id, turn, min(text) AS question FROM conversations WHERE role = '{_SETTINGS.role}' AND length(trim(text)) > 0 GROUP BY 1, 2),
    asked AS (SELECT conv_id, turn, term, count(*) AS times FROM (SELECT conv_id, turn, unnest({_TERMS.replace('text', 'question')}) AS term FROM turns) GROUP BY 1, 2, 3),
    scored AS (SELECT conv_id, turn, p.ordinal, round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM postings p JOIN asked USING (term) JOIN idf USING (term) JOIN stats USING (ordinal), corpus GROUP BY 1, 2, 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ordinal DESC)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= {_SETTINGS.citations} AND score >= {_SETTINGS.least_score}),
    cited AS (SELECT conv_id, turn, rank, doc_id, round(score::DECIMAL(18, 6), 4)::DOUBLE AS cited_score, CASE WHEN length(s) <= 160 THEN s ELSE regexp_replace(s[1:160], ' [^ ]*$', '') || '...' END AS snippet, '[' || source || ', p.1 - ' || coalesce(lang, 'General') || ']' AS label FROM best JOIN (SELECT *, {queries._SNIP} AS s FROM documents) ON doc_id = ordinal),
    routed AS ({queries._rules_sql('conv_id, turn, question', '(SELECT *, question AS text FROM turns)')}),
    sums AS (SELECT conv_id, turn, count(*)::INTEGER AS sources, arg_min(snippet, rank) AS answer FROM cited GROUP BY 1, 2)
    SELECT r.conv_id, r.turn, question, workflow, total_score, coalesce(sources, 0) AS sources, coalesce(answer, '{NO_EVIDENCE}') AS answer, sources IS NULL AS abstained, rank, doc_id, cited_score, snippet, label
    FROM routed r LEFT JOIN sums s ON s.conv_id = r.conv_id AND s.turn = r.turn LEFT JOIN cited c ON c.conv_id = r.conv_id AND c.turn = r.turn"""

QUERIES = {"job1_ingest_documents": job1_ingest_documents, "job2_answer_questions": job2_answer_questions}
ORACLE_SQL = {"job1_ingest_documents": _INGEST_SQL, "job2_answer_questions": _ANSWERS_SQL}
