"""Tables that the given ones don't have, derived from them row by row: page layout, routing replies, model texts, hits, audits,
evaluation records. Each grows with the table it comes from, and is given once, as SQL for Spark or DuckDB, which name a few functions differently. The columns are those of fixtures.TABLES.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import fixtures


def sources(spark: bool) -> dict[str, str]:
    """The derived tables by name, as SQL of Spark or of DuckDB over the given tables."""
    either = lambda a, b: a if spark else b
    list_of = lambda *items: either("array", "list_value") + f"({', '.join(items)})"
    split = lambda c, by: either("split", "string_split") + f"({c}, {by})"
    part = lambda c, start, n: either(f"slice({c}, {start} + 1, {n})", f"list_slice({c}, {start} + 1, {start} + {n})")
    at = lambda c, i: either(f"get({c}, cast({i} AS INT))", f"({c})[{i} + 1]")
    joined = lambda c, by: either("array_join", "array_to_string") + f"({c}, {by})"
    upto = lambda n: either(f"explode(sequence(0, {n} - 1))", f"unnest(range(0, {n}))")
    ordered = lambda c, by: either(f"transform(array_sort(collect_list(struct({by} AS o, {c} AS v))), x -> x.v)", f"list({c} ORDER BY {by})")
    feature = lambda name, present: either(f"named_struct('feature', {name}, 'present', {present})", f"struct_pack(feature := {name}, present := {present})")

    first = at(split("coalesce(text, '')", "chr(10)"), "0")
    by_line = f"SELECT doc_id, {split("coalesce(text, '')", "chr(10)")} AS l, cast(doc_id % 4 + 1 AS INT) AS w FROM documents"
    # groups of one to four lines are blocks, eight to a page; some are headings, code, footers or images, by their place
    groups = f"SELECT doc_id, g, n, cast(floor(g / 8) AS INT) + 1 AS page, cast(g % 8 AS INT) AS block_ord, (doc_id * 7 + g) % 13 AS r, {joined(part("l", "g * w", "w"), "chr(10)")} AS body, substr({at("l", "g * w")}, 1, 40) AS head FROM (SELECT *, {upto("n")} AS g FROM (SELECT *, cast(ceil(size_of / w) AS INT) AS n FROM (SELECT *, cardinality(l) AS size_of FROM ({by_line}))))"
    texts = f"SELECT *, CASE r WHEN 0 THEN 'SECTION ' || cast(g + 1 AS STRING) || ' ' || head WHEN 1 THEN cast(page AS STRING) || '.' || cast(g AS STRING) || ' ' || head WHEN 2 THEN 'def f' || cast(g AS STRING) || '(x):' || chr(10) || '    return ' || head WHEN 3 THEN 'Page ' || cast(page AS STRING) || ' of ' || cast(n AS STRING) WHEN 4 THEN 'import x' || chr(10) || body ELSE body END AS text FROM ({groups})"
    pieces = f"SELECT doc_id, g, page, block_ord, line, k, substr({at("b", "line")}, 1 + 12 * k, CASE k WHEN 0 THEN 12 ELSE 100000 END) AS text, cast((doc_id + g) % 6 AS INT) AS f FROM (SELECT *, {upto("2")} AS k FROM (SELECT *, {upto("cardinality(b)")} AS line FROM (SELECT *, {split("text", "chr(10)")} AS b FROM ({texts}) WHERE r <> 5)))"
    cells = f"SELECT doc_id, page, {ordered("cells", "block_ord")} AS cells FROM (SELECT doc_id, page, block_ord, {list_of(f"nullif({at(split("body", "' '"), "0")}, 'de')", at(split("body", "' '"), "1"), f"CASE WHEN doc_id % 13 = 0 THEN substr(body, 1, 400) ELSE {at(split("body", "' '"), "2")} END")} AS cells FROM ({groups}) WHERE block_ord <= doc_id % 4) GROUP BY doc_id, page"
    found = "SELECT *, 1 AS finder, 0 AS table_ord FROM ({0}) WHERE (doc_id + page) % 3 <> 0 UNION ALL SELECT *, 2, 1 FROM ({0}) WHERE (doc_id + page) % 2 = 0 UNION ALL SELECT *, 1, 2 FROM ({0}) WHERE (doc_id + page) % 5 = 1".format(cells)
    turns = "SELECT *, conv_id * 100 + turn AS id FROM conversations"
    word = f"coalesce(regexp_extract({at(split("coalesce(text, '')", "' '"), "1")}, '[a-z]+', 0), '')"

    return {
        "blocks": f"SELECT 'doc_' || cast(doc_id AS STRING) || '.pdf' AS doc, page, block_ord, CASE r WHEN 5 THEN 1 ELSE 0 END AS block_kind, 50 + 250 * (CASE WHEN doc_id % 5 = 0 THEN g % 2 ELSE 0 END) AS x0, 12.5 * block_ord AS y0, 250 + 250 * (CASE WHEN doc_id % 5 = 0 THEN g % 2 ELSE 0 END) AS x1, 12.5 * block_ord + 10 AS y1, text FROM ({texts})",
        "spans": f"SELECT 'doc_' || cast(doc_id AS STRING) || '.pdf' AS doc, page, block_ord, line, k AS span, text, CASE WHEN (g + line + k) % 4 = 0 THEN 'Helvetica' WHEN f = 0 THEN 'DejaVu-Sans-Mono' WHEN f = 1 THEN 'CourierNew' WHEN f = 2 THEN 'Noto-Sans-Bold' WHEN f = 3 THEN 'Consolas' ELSE 'Times' END AS font, 9.0 + f AS size, g % 4 AS flags FROM ({pieces})",
        "grids": f"SELECT 'doc_' || cast(doc_id AS STRING) || '.pdf' AS doc, page, finder, table_ord, cells, 40 AS x0, 20 * (page % 3) + 30 * table_ord AS y0, 260 AS x1, 20 * (page % 3) + 30 * table_ord + 28 AS y1 FROM ({found})",
        "sections": "SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Table of Contents > ' || lang WHEN 3 THEN 'Document > ' || lang || ' > ' || source || '>' || substr(text, 1, 12) WHEN 4 THEN ' ' || source || ' ' ELSE lang || ' > > document' END AS section FROM documents",
        "snippets": "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '(Guide > Part ' || lang || ') ' || text WHEN 1 THEN 'A_b > C-d > ' || text WHEN 2 THEN '  ' || text || ' ' ELSE text END AS raw FROM documents WHERE text IS NOT NULL",
        "questions": f"SELECT id AS query_id, CASE WHEN conv_id % 3 = 0 THEN 'agentic' ELSE 'simple_rag' END AS expected, text AS question FROM ({turns}) WHERE role = 'user'",
        "router_replies": f"SELECT id AS query_id, CASE WHEN conv_id % 7 = 0 THEN {part(list_of(feature("''", "true")), "0", "0")} ELSE {list_of(feature("'Requires comparison'", "length(text) % 2 = 0"), feature("' requires multiple documents '", "turn % 3 = 1"), feature("CASE conv_id % 4 WHEN 0 THEN 'calculations' WHEN 1 THEN '' WHEN 2 THEN 'Direct factual question' ELSE 'unknown thing' END", "CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) > 300 END"))} END AS features, CASE conv_id % 5 WHEN 0 THEN NULL ELSE conv_id % 4 END AS total_score FROM ({turns})",
        "ranked": f"SELECT label AS query_id, vec_id AS ordinal, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round(cast({at("embedding", "0")} AS DOUBLE), 2) END AS dense, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE round(cast({at("embedding", "1")} AS DOUBLE), 2) END AS sparse FROM embeddings",
        "model_texts": f"""SELECT id, CASE id % 9 WHEN 0 THEN '{{"a":"' || {word} || '"}}' WHEN 1 THEN 'First' || chr(10) || '```json' || chr(10) || '{{"id":' || cast(id AS STRING) || '}}' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```' || chr(10) || 'no' || chr(10) || '```' WHEN 2 THEN substr(text, 1, 50) || ' {{"x":{{"y":' || cast(turn AS STRING) || '}}}}' WHEN 3 THEN 'The list is [1,' || cast(id AS STRING) || '] and ' || {word} WHEN 4 THEN '{{"a":"}}' || {word} || '"}} breaks' WHEN 5 THEN '* Question: ' || {word} || chr(10) || '* Constraint: short' || chr(10) || chr(10) || '*   Option one' || chr(10) || chr(10) || text WHEN 6 THEN '* Question: q' || chr(10) || '  * Constraint: c' || chr(10) || chr(10) || '*   Option' || chr(10) || chr(10) || text WHEN 7 THEN '  {{"z":null}}  ' ELSE text END AS text FROM ({turns})""",
        "model_chains": f"SELECT id, CASE turn % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'complex' ELSE 'flash' END AS tier, role AS first, CASE WHEN conv_id % 4 = 0 THEN '' ELSE {word} END AS second, {list_of("role", word, "''", "'m' || cast(conv_id % 3 AS STRING)", "'m1'")} AS fallbacks FROM ({turns})",
        "hits": f"SELECT query_id, step, row_number() OVER (PARTITION BY query_id, step ORDER BY doc_id) AS place, 'c' || cast(doc_id % 37 AS STRING) AS chunk_id, 's' || cast(doc_id % 37 AS STRING) || '.pdf' AS doc_name, doc_id % 37 + 1 AS page_number, 'part ' || cast(doc_id % 37 AS STRING) AS section, 'text ' || cast(doc_id % 37 AS STRING) AS snippet FROM (SELECT doc_id, cast(floor(doc_id / 20) AS INT) AS query_id, doc_id % 3 + 1 AS step, {first} AS head FROM documents) WHERE head <> ''",
        "audits": f"SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'partially_supported' END AS status, d.doc_id % 2 = 0 AS is_grounded, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE {part(split("text", "' '"), "0", "cast(d.doc_id % 3 AS INT)")} END AS supported, {part(split("text", "' '"), "3", "cast(n_chars % 4 AS INT)")} AS unsupported FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE text IS NOT NULL",
        "eval_records": "SELECT cast(doc_id AS STRING) AS id, CASE WHEN quality = 1 THEN 'simple_rag' ELSE 'agentic' END AS expected_workflow, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'agentic' ELSE 'simple_rag' END AS actual_workflow, toxic = 1 AS should_abstain, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS abstained, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'unsupported' WHEN doc_id % 5 = 1 THEN 'partially_supported' ELSE 'supported' END AS verification_status, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 64) / 8 END AS latency, doc_id % 11 = 0 AS errored FROM labels",
        "requests": f"SELECT id AS request_id, CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN substr(text, 1, cast(turn % 4 AS INT)) ELSE text END AS query, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'agentic' WHEN 2 THEN 'other' ELSE 'auto' END AS force_workflow, CASE WHEN turn % 2 = 0 THEN NULL ELSE conv_id % 24 END AS top_k FROM ({turns})",
        "catalog": f"SELECT low AS ord, source || '.pdf' AS doc_name, 'Texts of ' || source AS title, lang AS domain, {list_of("'documents: ' || cast(n AS STRING)", "'characters: ' || cast(chars AS STRING)")} AS topics, {list_of("source", "lang")} AS entities, 'From ' || cast(low AS STRING) || ' to ' || cast(high AS STRING) || '.' AS summary FROM (SELECT source, min(lang) AS lang, count(*) AS n, sum(n_chars) AS chars, min(doc_id) AS low, max(doc_id) AS high FROM documents WHERE source IS NOT NULL GROUP BY source)",
    }


SPARK, DUCK = sources(True), sources(False)
_TABLES = r"\b(FROM|JOIN) (documents|conversations|labels|embeddings)\b"


def sql(name: str) -> str:
    """A derived table as a DuckDB subquery."""
    columns = ", ".join(f"CAST({c} AS {fixtures.duck(k)}) AS {c}" for c, k in fixtures.columns(name))
    return f"(SELECT {columns} FROM ({DUCK[name].replace('cardinality(', 'len(').replace(' AS STRING)', ' AS VARCHAR)')}))"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame over the tables of a folder."""
    text = SPARK[name].replace("{", "{{").replace("}", "}}")
    used = {t for _, t in re.findall(_TABLES, text)}
    rows = spark.sql(re.sub(_TABLES, r"\1 {\2}", text), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
    return rows.select(*(F.col(c).cast(k) for c, k in fixtures.columns(name)))
