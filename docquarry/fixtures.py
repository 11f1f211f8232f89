"""Small tables for tests that show the edges of each rule: page layout, routing replies, model texts, evaluation records. Each is
given once and becomes a DataFrame or DuckDB SQL. Queries run over the derived tables of the same columns (derived.py)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docquarry import schemas

_P = "report.pdf"


def _block(page, ord_, y, text, x=50.0, kind=0, height=10.0, doc=_P):
    return (doc, page, ord_, kind, x, y, x + 200.0, y + height, text)


BLOCKS = [
    _block(1, 0, 10.0, "SECTION 1 Overview"),
    _block(1, 1, 30.0, "This is the first paragraph.\nIt has two lines."),
    _block(1, 2, 2.5, "Page 1 of 5"),
    _block(1, 3, 50.0, "1.2 Vector Search"),
    _block(1, 4, 70.0, "Name\nLatency\nCost"),
    _block(1, 5, 90.0, "Alpha\n5ms\nlow|high"),
    _block(1, 6, 92.4, "Page 2"),
    _block(1, 7, 110.0, "Beta\n9ms\n"),
    _block(1, 8, 110.0, "left\nof\nit", x=10.0),
    _block(1, 9, 130.0, "def f(x):\n    return x"),
    _block(1, 10, 150.0, "image", kind=1),
    _block(1, 11, 170.0, "   "),
    _block(1, 12, 190.0, "covered by grid one", x=300.0),
    _block(1, 13, 210.0, "also covered", x=300.0),
    _block(2, 0, 7.5, "Intro to things"),
    _block(2, 1, 12.4, "right of it", x=300.0),
    _block(2, 2, 40.0, "a\nb\nc\nd\ne\nf\ng\nh"),
    _block(2, 3, 60.0, "1\n2\n3\n4\n5\n6\n7\n8"),
    _block(2, 4, 80.0, "a\nb\nc\nd\ne\nf\ng\nh\ni"),
    _block(2, 5, 100.0, "1\n2\n3\n4\n5\n6\n7\n8\n9"),
    _block(2, 6, 120.0, "p\nq\nr", x=300.0),
    _block(2, 7, 140.0, "s\nt\nu"),
    _block(2, 8, 160.0, "v\nw\nx"),
    _block(2, 9, 180.0, "only two\nlines here"),
    _block(2, 10, 200.0, "SECTION 2 Results"),
    _block(1, 0, 10.0, "1. Intro without a number heading", doc="other_doc.v2.pdf"),
    _block(1, 1, 30.0, "3 Apples", doc="other_doc.v2.pdf"),
    _block(1, 2, 50.0, "plain  text\twith gaps", doc="other_doc.v2.pdf"),
]


def _span(page, ord_, line, span, text, font="Helvetica", size=10.0, flags=0, doc=_P):
    return (doc, page, ord_, line, span, text, font, size, flags)


SPANS = [
    _span(1, 0, 0, 0, "SECTION 1 Overview", "Noto-Sans-Bold", 14.0, 16),
    _span(1, 1, 0, 0, "This is the "),
    _span(1, 1, 0, 1, "first", "DejaVu-Sans-Mono"),
    _span(1, 1, 0, 2, " paragraph."),
    _span(1, 1, 1, 0, "It has two lines."),
    _span(1, 3, 0, 0, "1.2 Vector Search", "Helvetica", 12.0, 2),
    _span(1, 9, 0, 0, "def f(x):", "CourierNew", 9.0),
    _span(1, 9, 1, 0, "    return x", "CourierNew", 9.0),
    _span(2, 0, 0, 0, "Intro to things", "Helvetica", 11.5, 2),
    _span(2, 1, 0, 0, "right of it", "Consolas", 10.0),
    _span(2, 9, 0, 0, "only two", "NotoCode", 10.0),
    _span(2, 9, 1, 0, "", "Helvetica", 30.0, 2),
    _span(2, 9, 1, 1, "x", "NotoCode", 10.0),
    _span(2, 10, 0, 0, "SECTION 2 Results", "Helvetica", 13.0, 0),
    _span(1, 2, 0, 0, "plain  text\twith gaps", doc="other_doc.v2.pdf"),
]
GRIDS = [
    (_P, 1, 1, 0, [["H1", "H2"], ["a", None], ["b | c", " d  e "]], 290.0, 185.0, 510.0, 225.0),
    (_P, 1, 1, 1, [["only one row", "x"]], 0.0, 0.0, 1.0, 1.0),
    (_P, 1, 2, 2, [["second", "finder"], ["not", "used"]], 0.0, 300.0, 100.0, 320.0),
    (_P, 2, 1, 0, [["", ""], ["", "x"]], 0.0, 0.0, 10.0, 10.0),
    (_P, 2, 2, 1, [["A", "B"], ["1", "2"], ["3"]], 290.0, 115.0, 510.0, 135.0),
    (_P, 2, 2, 2, [["far", "", "away"], ["1", "2", "3", "4"]], 600.0, 600.0, 700.0, 700.0),
    (_P, 2, 2, 3, [["long", "cell"], ["x" * 351, "y"]], 600.0, 600.0, 700.0, 700.0),
]
_LONG_ROW = "| " + "word " * 60 + "| value |"
ELEMENTS = [
    ("guide.pdf", 1, 1, "heading", "# Start here", "Start here"),
    ("guide.pdf", 2, 1, "paragraph", "A short opening paragraph.", "Start here"),
    ("guide.pdf", 3, 1, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |", "Start here"),
    ("guide.pdf", 4, 2, "heading", "## First", "Start here > First"),
    ("guide.pdf", 5, 2, "heading", "### Second", "Start here > First > Second"),
    ("guide.pdf", 6, 2, "list_item", "dropped", "Start here > First > Second"),
    ("guide.pdf", 7, 3, "paragraph", " ".join(f"Sentence number {i} says something of note." for i in range(90)), "Start here > First > Second"),
    ("guide.pdf", 8, 3, "paragraph", "A tail that stays with the section.", "Start here > First > Second"),
    ("guide.pdf", 9, 4, "table", "\n".join(["| text | n |", "| --- | --- |", *[_LONG_ROW] * 12]), "Next"),
    ("guide.pdf", 10, 4, "table", "x" * 2500 + "\n| --- |", "Next"),
    ("guide.pdf", 11, 5, "code", "```python\n" + "print(1)\n" * 400 + "```", "Next"),
    ("guide.pdf", 12, 5, "heading", "# Last", "Last"),
    ("my_v2x_notes.pdf", 1, 1, "paragraph", "One. Two! Three? 4 is a number.", ""),
    ("my_v2x_notes.pdf", 2, 2, "paragraph", "Same section on the next page.", None),
]
# The evaluation questions with the workflow each should take.
QUESTIONS = [
    (1, "simple_rag", "What is Reciprocal Rank Fusion and how is its formula defined?"),
    (2, "simple_rag", "What chunking strategies are discussed for processing technical documents?"),
    (3, "simple_rag", "Which vector database provides in-process, GPU-accelerated nearest neighbor search?"),
    (4, "agentic", "Compare FAISS and Pinecone across query latency, hosting architecture, and operational cost."),
    (5, "simple_rag", "Is a standard index better than none"),
    (6, "agentic", "How should I design a production architecture step by step?"),
    (7, "simple_rag", "both of the words here make it exactly eight"),
    (8, "agentic", "both of the words here make it nine words long"),
    (9, "agentic", "Calculate the cost at scale"),
    (10, "simple_rag", ""),
]
ROUTER_REPLIES = [
    (1, [("Direct factual question", True), ("Requires one focused retrieval", True), ("Requires comparison", False)], 0),
    (2, [("Requires comparison", True), ("requires multiple documents ", True)], None),
    (3, [("comparison", True), ("", True), ("unknown thing", True)], 1),
    (4, [("Requires planning or multi-step reasoning", None), ("calculations", True)], 7),
    (5, [], None),
]
RANKED = [(q, o, d, s) for q, rows in {
    1: [(i, 1.0 - i / 100, (20 - i) / 10 if i % 2 else None) for i in range(12)],
    2: [(i, 0.5, 0.0) for i in range(4)],
    3: [(10 + i, None, 3.0 - i) for i in range(8)] + [(3, 0.9, None), (4, 0.9, None)],
}.items() for o, d, s in rows]
MODEL_TEXTS = [
    (1, '{"a": 1, "b": [1, 2]}'),
    (2, 'First\n```json\n{"a": 1}\n```\nthen\n```\nnot json\n```'),
    (3, 'Some thought. {"x": {"y": 2}}'),
    (4, "The list is [1, 2, 3] and no more"),
    (5, 'A brace in a string {"a": "}"} breaks balance'),
    (6, "nothing here"),
    (7, "* Question: what?\n* Constraint: short\n\n*   Option one\n\nThe answer is 42."),
    (8, "* Question: what?\n  * Constraint: short\n\n*   Option one\n\nThe answer."),
    (9, "* Question: q\n* Constraint: c\n\n*   Question: q"),
    (10, ""),
    (11, '  {"z": null}  '),
    (12, '{"a": 1} and then {"b": 2}'),
]
MODEL_CHAINS = [(1, "primary", "p", "c", ["c", "p", "g", ""]), (2, "complex", "p", "c", ["x", "x", "p"]), (3, "flash", "", "c", ["c"]), (4, "primary", "p", "p", ["p"])]
HITS = [
    (1, 1, 1, "c1", "a.pdf", 1, "S > T", "one"), (1, 1, 2, "c2", "a.pdf", 2, "S", "two"), (1, 2, 1, "c2", "a.pdf", 2, "S", "two"),
    (1, 2, 2, "c3", "b.pdf", 3, "General", "three"), (2, 1, 1, "c9", "b.pdf", 9, "U", "nine"), *((3, s, r, f"d{s}{r}", "c.pdf", r, "V", f"hit {s}{r}") for s in (1, 2, 3) for r in (1, 2, 3)), (3, 3, 4, "d11", "c.pdf", 1, "V", "hit 11"),
]
AUDITS = [
    (1, "supported", True, ["a"], []), (2, "unsupported", True, ["a"], []), (3, "partially_supported", False, ["a"], ["b", "c"]),
    (4, "partially_supported", True, ["a"], ["b", "c"]), (5, "partially_supported", False, ["a", "b"], ["c"]), (6, "supported", False, None, ["x"]),
]
EVAL = [
    ("e1", "simple_rag", "simple_rag", False, False, "supported", 1.234, False), ("e2", "agentic", "simple_rag", False, False, "unsupported", 2.5, False),
    ("e3", "simple_rag", "simple_rag", True, True, "unsupported", 0.5, False), ("e4", "simple_rag", "simple_rag", True, False, "supported", 0.75, False),
    ("e5", "agentic", None, False, None, None, None, True), ("e6", "agentic", "agentic", False, True, "unsupported", 9.125, False), ("e7", "simple_rag", None, True, None, None, None, True),
]
REQUESTS = [(1, "What is it?", "auto", 5), (2, "x", "auto", 5), (3, None, None, None), (4, "good query", "agentic", 21), (5, "good query", "other", 3), (6, "good query", "simple_rag", 1), (7, "ok", None, None), (8, "zero", "auto", 0)]
# The catalogue of the evaluation corpus.
CATALOG = [
    (1, "rag_architecture_patterns.pdf", "RAG Architecture Patterns & Production Implementation", "RAG Architecture & Information Retrieval", ["Document chunking strategies (fixed, semantic, structural)", "Dense vector search vs sparse BM25 retrieval", "Hybrid search and Reciprocal Rank Fusion (RRF)"], ["FAISS", "BM25", "HyDE"], "Architectural patterns for retrieval systems."),
    (2, "vector_database_comparison.pdf", "Comparative Analysis of Vector Databases", "Vector Storage & Database Benchmarking", ["Index structures: HNSW, IVF-PQ, Flat indexing", "Metadata filtering strategies"], ["Pinecone", "Weaviate", "pgvector"], "Benchmarks of vector databases."),
    (3, "agentic_ai_frameworks.pdf", "Agentic AI Frameworks & Multi-Agent Orchestration", "Agent Orchestration & Workflow Architectures", ["Tool execution, sandboxing, and function calling"], ["ReAct", "StateGraph"], "A review of agent frameworks."),
]
SECTIONS = [(i, s) for i, s in enumerate(["", None, "A > B > C", "Table of Contents > Intro", "document", " One ", "Document > Table of contents", "x>y", " > > z"])]
SNIPPETS = [(i, s) for i, s in enumerate(["(Guide > Part 2) The text.", "A_b > C-d > The rest of it", "short", "word " * 60, "x" * 200, "  spaced \n\n out  ", "( no breadcrumb ) text", "a (b > c) d", ""])]
FOOTERS = [(i, s) for i, s in enumerate(["Page 1 of 5", "Page 10", "SENIOR AI ENGINEER TECHNICAL ASSESSMENT — SAMPLE CORPUS", "   ", "1. Introduction to RAG", "Vector databases store high-dimensional embeddings.", "page 3", "Page one", "Document 2  of 3", "Agentic AI Frameworks — Document 1 of 3 x"])]
FONTS = [(i, s) for i, s in enumerate(["DejaVu-Sans-Mono", "Noto-Sans-Mono", "CourierNew", "Consolas", "Helvetica", "Noto-Sans-Bold", "FiraCode", ""])]

TABLES = {
    "blocks": (schemas.BLOCKS, BLOCKS), "spans": (schemas.SPANS, SPANS), "grids": (schemas.GRIDS, GRIDS), "elements": (schemas.ELEMENTS, ELEMENTS),
    "questions": ("query_id int, expected string, question string", QUESTIONS), "router_replies": ("query_id int, features array<struct<feature:string,present:boolean>>, total_score int", ROUTER_REPLIES),
    "ranked": ("query_id int, ordinal int, dense double, sparse double", RANKED), "model_texts": ("id int, text string", MODEL_TEXTS), "model_chains": ("id int, tier string, first string, second string, fallbacks array<string>", MODEL_CHAINS),
    "hits": ("query_id int, step int, place int, chunk_id string, doc_name string, page_number int, section string, snippet string", HITS), "audits": ("id int, status string, is_grounded boolean, supported array<string>, unsupported array<string>", AUDITS),
    "eval_records": (schemas.EVAL, EVAL), "requests": (schemas.REQUESTS, REQUESTS), "catalog": (schemas.CATALOG, CATALOG),
    "sections": ("id int, section string", SECTIONS), "snippets": ("id int, raw string", SNIPPETS), "footers": ("id int, text string", FOOTERS), "fonts": ("id int, font string", FONTS),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if isinstance(v, tuple):
        return "{'feature': " + _literal(v[0]) + ", 'present': " + _literal(v[1]) + "}"
    return repr(v)


def duck(kind: str) -> str:
    kind = kind.strip()
    if kind.startswith("array<struct"):
        return "STRUCT(feature VARCHAR, present BOOLEAN)[]"
    if kind.startswith("array<"):
        return duck(kind[6:-1]) + "[]"
    return {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "long": "BIGINT"}[kind]


def columns(name: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns."""
    return [tuple(c.strip().split(" ", 1)) for c in re.split(r",\s*(?=\w+ )", TABLES[name][0])]


def values(name: str) -> str:
    """A fixture as a DuckDB subquery."""
    own = columns(name)
    selects = ", ".join(f"CAST({c} AS {duck(k)}) AS {c}" for c, k in own)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in TABLES[name][1])
    return f"(SELECT {selects} FROM (VALUES {body}) AS t({', '.join(c for c, _ in own)}))"
