"""Column functions on text. The expected breadcrumbs, slugs, labels and footers, which any equal engine must give."""

import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import model_text, text
from docquarry.operators import chunking


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_footers_and_fonts(spark):
    from docquarry.operators import layout

    yes = ["Page 1 of 5", "Page 10", "SENIOR AI ENGINEER TECHNICAL ASSESSMENT — SAMPLE CORPUS", "   "]
    no = ["1. Introduction to RAG", "Vector databases store high-dimensional embeddings."]
    assert column(spark, yes + no, layout.is_header_or_footer) == [True] * 4 + [False] * 2
    fonts = ["DejaVu-Sans-Mono", "Noto-Sans-Mono", "CourierNew", "Consolas", "Helvetica", "Noto-Sans-Bold"]
    assert column(spark, fonts, layout.is_code_font) == [True] * 4 + [False] * 2


def test_breadcrumb_and_label(spark):
    row = spark.range(1).select(text.breadcrumb(F.lit("vector_database_comparison.pdf"), F.lit("8. Performance Benchmarks"), F.lit(5)), text.citation_label(F.lit("vector_database_comparison.pdf"), F.lit(3), F.lit("3. Benchmark Results")), text.title_case(F.lit("v2x it's ünder")))
    assert list(row.first()) == ["[Document: Vector Database Comparison | Section: 8. Performance Benchmarks | Page: 5]", "[vector_database_comparison.pdf, p.3 - 3. Benchmark Results]", "v2x it's ünder".title()]


def test_token_estimate(spark):
    assert column(spark, ["", None, "a", "a sentence of some words"], text.token_estimate) == [0, 0, 1, 6]
    assert chunking.estimate("") == 0 and chunking.estimate("a sentence of some words") == 6


def test_sentences_equal_a_split_with_look_behind(spark):
    rng = random.Random(5)
    pool = ["One", "two", ".", "!", "?", " ", "  ", "\n", "3", "- x", "É", "end.", "✓"]
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert column(spark, values, text.sentences) == [chunking.sentences(v) for v in values]


def test_sections_and_snippets_equal_plain_python(spark):
    rng = random.Random(6)
    pool = ["Intro", ">", " > ", "(", ")", "Table of Contents", "document", " ", "a.b", "\n", "x" * 90, "word "]
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(500)]

    def section(v):
        parts = [p.strip() for p in v.split(">") if p.strip() and p.strip().lower() not in ("table of contents", "document")]
        return " > ".join(parts[-2:]) or "General"

    def snippet(v):
        v = regex.sub(r"^([A-Za-z0-9_.\s-]+\s*>\s*)+", "", regex.sub(r"^\([^)]*?>[^)]*?\)\s*", "", v.strip()))
        v = " ".join(v.split())
        return v if len(v) <= 160 else v[:160].rsplit(" ", 1)[0] + "..."

    assert column(spark, values, text.concise_section) == [section(v) for v in values]
    assert column(spark, values, text.concise_snippet) == [snippet(v) for v in values]


def test_stems(spark):
    assert column(spark, ["a.pdf", "a.b.pdf", "none", ".hidden"], text.stem) == ["a", "a.b", "none", ".hidden"]


def test_json_repair_of_known_replies():
    cases = {'{"a": 1}': '{"a": 1}', "x\n```json\n[1]\n```": "[1]", 'so {"x": {"y": 2}} ': '{"x": {"y": 2}}', "list [1, 2]": "[1, 2]", "no": None, None: None, '{"a": "}"} tail': None, '```\nbad\n```\n```\n{"k": 0}\n```': '{"k": 0}'}
    assert {k: model_text.repaired(k) for k in cases} == cases


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c.!D", min_size=1, max_size=40), min_size=1, max_size=30))
def test_windows_keep_every_sentence(parts):
    from docquarry.config import Chunking

    config = Chunking(target=20, most=30, overlap=5)
    made = list(chunking.windows(parts, chunking.estimate, config))
    at = 0
    for body in made:  # each window goes on from the sentences before
        start = next(k for k in range(at, -1, -1) if any(" ".join(parts[k:e]) == body for e in range(k + 1, len(parts) + 1)))
        at = max(e for e in range(start + 1, len(parts) + 1) if " ".join(parts[start:e]) == body)
    assert at == len(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab| ", min_size=1, max_size=60).filter(str.strip), min_size=1, max_size=60))
def test_table_parts_hold_all_rows(rows):
    from docquarry.config import Chunking

    rows = [f"|{r}|" for r in rows]
    parts = chunking.table_parts("\n".join(["| h |", "| --- |", *rows]), chunking.estimate, Chunking(target=40))
    assert [x for body, _ in parts for x in body.split("\n")[2:]] == rows
    assert all(body.startswith("| h |\n| --- |\n") for body, _ in parts) and [i for _, i in parts] == list(range(1, len(parts) + 1))
