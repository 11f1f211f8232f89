import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import fixtures, schemas
from docquarry.config import Chunking
from docquarry.operators import agent, answers, chunking, embedding, layout, retrieval, routing
from docquarry.plans import ingest
from docquarry.sources import files, html


def test_chunk_ids_types_and_pages(spark):
    rows = {r.chunk_id: r for r in chunking.chunks(fixtures.frame(spark, "elements")).collect()}
    guide = [r for r in sorted(rows.values(), key=lambda r: r.ordinal) if r.doc_name == "guide.pdf"]
    assert [r.element_type for r in guide][:3] == ["prose", "table", "prose"]
    assert guide[0].raw_content == "### Start here\n\nA short opening paragraph." and guide[0].page_number == 1
    assert guide[2].raw_content == "### First" and guide[2].page_number == 2
    split = [r for r in guide if r.is_split_table]
    assert [r.part for r in split] == list(range(1, len(split) + 1)) and len(split) > 1 and all(r.raw_content.startswith("| text | n |\n| --- | --- |") for r in split)
    assert sum(len(r.raw_content.split("\n")) - 2 for r in split) == 12
    code = next(r for r in guide if r.element_type == "code")
    assert code.token_count > 600 and code.raw_content.count("print(1)") == 400
    assert guide[-1].raw_content == "### Last" and guide[-1].section_path == "Last"
    assert not any("dropped" in r.raw_content for r in guide)
    notes = rows["my_v2x_notes_c1"]
    assert notes.text.startswith("[Document: My V2X Notes | Section: Introduction | Page: 2]\n") and notes.parent_id == "my_v2x_notes_s_introduction"


def test_exact_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    made = chunking.chunks(fixtures.frame(spark, "elements"), ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)
    assert all(r.token_count > 0 for r in made.collect())


def pages(seed: int):
    """Random pages of a document: blocks and grids."""
    rng = random.Random(seed)
    blocks, grids = [], []
    for page in range(1, 13):
        for k in range(rng.randint(1, 14)):
            body = rng.choice(["Page 3", "a\nb\nc", "d\ne\nf", "p\nq\nr\ns", "one line", "SECTION 4 x", "1\n2\n3\n4"])
            blocks.append(("r.pdf", page, k, 0 if rng.random() < 0.95 else 1, 0.0, 20.0 * k, 100.0, 20.0 * k + 10, body))
        for t in range(rng.randint(0, 2)):
            top = 20.0 * rng.randint(0, 10)
            grids.append(("r.pdf", page, 1, t, [["a", "b"], ["c", "d"]], 0.0, top, 100.0, top + 10 + 20 * rng.randint(0, 2)))
    return blocks, grids


def walked(blocks, grids):
    """Tables and other elements of the pages, by a walk over the blocks: (page, kind, rows)."""
    foot = lambda t: t == "Page 3"
    out = []
    for page in sorted({b[1] for b in blocks}):
        own = sorted((b for b in blocks if b[1] == page and b[3] == 0), key=lambda b: b[5])
        tables = [g for g in grids if g[1] == page]
        over = lambda b: [g[3] for g in tables if max(0, min(b[7], g[8]) - max(b[5], g[6])) / (b[7] - b[5]) > 0.4]
        shown, i = set(), 0
        while i < len(own):
            b = own[i]
            if over(b):
                for t in over(b):
                    if t not in shown:
                        shown.add(t)
                        out.append((page, "table", 1))
                i += 1
                continue
            n = len(b[8].split("\n"))
            if foot(b[8]):
                i += 1
                continue
            j, rows = i + 1, 1
            if 3 <= n <= 8:
                while j < len(own) and (foot(own[j][8]) or len(own[j][8].split("\n")) == n):
                    rows += not foot(own[j][8])
                    j += 1
            if rows > 1:
                out.append((page, "table", rows - 1))
                i = j
                continue
            out.append((page, "heading" if b[8].startswith("SECTION") else "paragraph", None))
            i += 1
        out += [(page, "table", 1) for t in tables if t[3] not in shown]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_elements_equal_a_walk_over_blocks(spark, seed):
    blocks, grids = pages(seed)
    from docquarry import schemas

    frames = spark.createDataFrame(blocks, schemas.BLOCKS), spark.createDataFrame([], schemas.SPANS), spark.createDataFrame(grids, schemas.GRIDS)
    got = layout.elements(*frames).orderBy("ord").collect()
    assert [(r.page, r.element_type, r.n_rows) for r in got] == walked(blocks, grids)
    assert [r.id for r in got] == [f"r_p{r.page}_e{k}" for k, r in enumerate(got, 1)]


def test_sections_nest_until_a_new_first_level(spark):
    got = [r.section for r in layout.elements(fixtures.frame(spark, "blocks"), fixtures.frame(spark, "spans"), fixtures.frame(spark, "grids")).where("doc = 'report.pdf' and element_type = 'heading'").orderBy("ord").collect()]
    assert got == ["SECTION 1 Overview", "SECTION 1 Overview > 1.2 Vector Search", "SECTION 1 Overview > 1.2 Vector Search > Intro to things", "SECTION 2 Results"]


def test_a_document_of_a_million_elements_is_packed_as_it_comes(spark):
    """No more than the elements of a chunk are taken before it is handed on, and batches may cut documents anywhere."""
    taken = 0

    def rows():
        nonlocal taken
        for i in range(1_000_000):
            taken += 1
            yield ("a.pdf", 1, "paragraph", f"Line {i} of a long document.", "S")

    ahead = 0
    for n, _ in enumerate(chunking.packed_documents(rows())):
        ahead = max(ahead, taken - 50 * n)
        if n == 2000:
            break
    assert ahead < 60_000 and taken < 200_000
    els = spark.createDataFrame([(f"d{i % 3}.pdf", i, 1, "paragraph", f"Sentence {i} goes here. " * 3, "S") for i in range(900)], schemas.ELEMENTS)
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            got.append(sorted(map(str, chunking.chunks(els).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] and len(got[0]) > 10


def docs(spark, n=60):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(n)], "doc_id long, text string")


def test_bm25_equals_a_plain_loop(spark):
    d = docs(spark)
    query = "w1 w2 w2 w29 nothing"
    want = plain_bm25({r.doc_id: r.text.split() for r in d.collect()}, query, 10)
    assert found(retrieval.build(d), spark, [query], 10)[0] == want


def test_index_round_trip_and_dimension(spark, tmp_path):
    d = docs(spark)
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "ordinal long, embedding array<float>")
    retrieval.build(d, vec).save(str(tmp_path))
    got = retrieval.load(spark, str(tmp_path), 2)
    q = spark.createDataFrame([(1, "w1 w2", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    hits = retrieval.search_hybrid(got, q).orderBy("rank").collect()
    assert len(hits) == 5 and hits[0].score == pytest.approx(max(h.score for h in hits))
    with pytest.raises(ValueError):
        retrieval.load(spark, str(tmp_path), 3)
    with pytest.raises(ValueError):
        retrieval.build(d.limit(0))


def plain_bm25(corpus, query, k):
    """(score, ordinal) of the k best texts, by loops; corpus: ordinal to words."""
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(t for ws in corpus.values() for t in set(ws))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    score = {i: sum(idf.get(t, 0) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t in query.split()) for i, ws in corpus.items()}
    return sorted(((round(s, 6), i) for i, s in score.items() if s > 0), reverse=True)[:k]


def found(index, spark, questions, k):
    rows = retrieval.search_sparse(index, spark.createDataFrame(list(enumerate(questions)), "query_id int, text string"), k).orderBy("query_id", "rank").collect()
    return {i: [(pytest.approx(r.score, abs=2e-6), r.ordinal) for r in rows if r.query_id == i] for i in range(len(questions))}


def zipf(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return {i: rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=rng.randint(0, 60)) for i in range(n)}


def test_optional_words_are_looked_up_for_candidates_only(spark, monkeypatch):
    """The same rows as by scoring everything; a stop word's postings are no longer scored one by one."""
    corpus = zipf(3000)
    corpus = {i: ws + ["the"] * (i % 7 > 0) + ["rare"] * (i % 200 == 0) for i, ws in corpus.items()}
    index = retrieval.build(spark.createDataFrame([(i, " ".join(ws)) for i, ws in corpus.items()], "doc_id long, text string"))
    questions = ["the rare w300", "the w0 rare w399", "w1 w399 w399 the the", "the", "nothing at all", "w250 w251 w252 w5"]
    seen, cut = {}, retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, label: seen.setdefault(label, cut(df, label)))
    got = found(index, spark, questions, 5)
    assert got == {i: plain_bm25(corpus, q, 5) for i, q in enumerate(questions)}
    df = Counter(t for ws in corpus.values() for t in set(ws))
    everything = {i: sum(df[t] for t in set(q.split())) for i, q in enumerate(questions)}
    scored = {r.query_id: r["count"] for r in seen["candidates"].groupBy("query_id").count().collect()}
    assert 5 * scored[0] < everything[0] and 5 * scored[1] < everything[1]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_many_questions_are_scored_in_cells(spark, monkeypatch, k):
    """The same rows as by loops, copies and repeated words too; no part of a score is a row, and each cell hands on k rows a question at most."""
    monkeypatch.setattr(retrieval, "PARTS", 10_000)
    monkeypatch.setattr(retrieval, "CELL", 3_000)
    monkeypatch.setattr(retrieval, "QUESTIONS", 30)
    corpus = zipf(600) | {1000 + i: ["w3", "w9", "w9", "copy"] for i in range(300)}
    index = retrieval.build(spark.createDataFrame([(i, " ".join(ws)) for i, ws in corpus.items()], "doc_id long, text string"))
    rng = random.Random(5)
    questions = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.randint(1, 30))) for _ in range(100)] + ["copy w9", "w0 w0 w1", "none", ""]
    labels, cut = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, label: labels.append(label) or cut(df, label))
    best, scored = retrieval._best, []
    monkeypatch.setattr(retrieval, "_best", lambda rows, k: scored.append(rows) or best(rows, k))
    assert found(index, spark, questions, k) == {i: plain_bm25(corpus, q, k) for i, q in enumerate(questions)}
    assert "candidates" not in labels and len(scored) == 1
    df = Counter(t for ws in corpus.values() for t in set(ws))
    blocks = -(-sum(df[t] for t in {t for q in questions for t in q.split()}) // retrieval.CELL)
    assert blocks > 1 and scored[0].groupBy("query_id").count().agg(F.max("count")).first()[0] <= k * blocks


def test_segments_are_searched_like_one_index(spark, tmp_path):
    """Texts added, replaced and removed, once more after a failure; every other table stays as it is."""
    path, corpus = str(tmp_path / "i"), zipf(200)
    frame = lambda rows: spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows.items()], "doc_id long, text string")
    first = {i: ws for i, ws in corpus.items() if i < 150}
    retrieval.build(frame(first)).save(path)
    before = sorted(p.name for p in (tmp_path / "i" / "postings" / "segment=0").rglob("*.parquet"))
    new = {i: ws for i, ws in corpus.items() if i >= 150} | {3: ["w1", "fresh", "fresh"], 4: []}
    gone = spark.createDataFrame([(7,), (9999,)], "ordinal long")
    write, calls = retrieval._write, []

    def fails(*a):
        calls.append(a[1])
        raise OSError("lost")

    # postings of a segment without its row of corpus don't count
    monkey = pytest.MonkeyPatch()
    monkey.setattr(retrieval, "_write", fails)
    with pytest.raises(OSError):
        retrieval.append(frame(new), path, removed=gone)
    monkey.undo()
    frame({1: ["stray"]}).selectExpr("doc_id as ordinal", "text as term", "1L as tf", "1L as dl", "1 as segment", "0 as bucket").write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    assert found(retrieval.load(spark, path), spark, ["w1 stray"], 5)[0] == plain_bm25(first, "w1 stray", 5)
    assert retrieval.append(frame(new), path, removed=gone) == 1 and calls == [1]
    now = {i: ws for i, ws in (first | new).items() if i != 7}
    questions = ["w1 fresh", "w0 w2 w3", "w50 w51 stray"]
    want = {i: plain_bm25(now, q, 8) for i, q in enumerate(questions)}
    assert found(retrieval.load(spark, path), spark, questions, 8) == want
    assert before == sorted(p.name for p in (tmp_path / "i" / "postings" / "segment=0").rglob("*.parquet"))
    # again, a text that a later segment brought is replaced; then all is written as one segment
    assert retrieval.append(frame({160: ["fresh"]}), path) == 2
    now[160] = ["fresh"]
    whole = retrieval.load(spark, path)
    assert (whole.n_docs, whole.words) == (len(now), sum(map(len, now.values())))
    whole.save(str(tmp_path / "j"))
    for p in (path, str(tmp_path / "j")):
        assert found(retrieval.load(spark, p), spark, questions, 8) == {i: plain_bm25(now, q, 8) for i, q in enumerate(questions)}


def test_a_search_reads_the_folders_of_its_words_only(spark, tmp_path):
    retrieval.build(docs(spark)).save(str(tmp_path))
    index = retrieval.load(spark, str(tmp_path))
    rows = retrieval.search_sparse(index, spark.createDataFrame([(1, "w1 w2")], "query_id int, text string"), 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(", plan)


@pytest.mark.parametrize("rows", [16, 10_000])
def test_a_task_hands_on_its_best_once(spark, rows):
    """At most tasks x questions x k rows leave the tasks, whatever the size of Arrow batches."""
    rng = np.random.default_rng(1)
    vectors, questions = np.round(rng.normal(size=(700, 4)), 1), np.round(rng.normal(size=(300, 4)), 1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "ordinal long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(questions)], "query_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = {}
        for r in retrieval.search_dense(v, q, 7).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.ordinal))
        monkey, sent = pytest.MonkeyPatch(), []
        monkey.setattr(retrieval, "ranked", lambda found, *a: sent.append(found) or found)
        retrieval.search_dense(v, q, 7)
        monkey.undo()
        assert sent[0].count() == 3 * 300 * 7
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    scores = np.round(questions @ vectors.T, 6) + 0.0
    for i in range(300):
        assert sorted(got[i]) == sorted((-s, o) for o, s in enumerate(scores[i]))[:7]


def test_two_chunk_index(spark):
    chunks = spark.createDataFrame([(1, "FAISS latency 2-5ms at 1M vectors | benchmarks"), (2, "Retrieval basics for everyone")], "doc_id long, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "ordinal long, embedding array<float>")
    q = spark.createDataFrame([(1, "FAISS latency benchmarks", [0.9, 0.1])], "query_id long, text string, embedding array<float>")
    top = retrieval.search_hybrid(retrieval.build(chunks, vec), q, 1).collect()
    assert [(r.ordinal, r.score > 0) for r in top] == [(1, True)]


def test_threshold_keeps_one_of_two(spark):
    hits = spark.createDataFrame([(1, 1, 0.025, 1), (1, 2, 0.005, 2)], "query_id int, ordinal long, score double, rank int")
    chunks = spark.createDataFrame([(k, "a.pdf", 1, "S", f"c{k}", "text", "text") for k in (1, 2)], "ordinal long, doc_name string, page_number int, section_path string, chunk_id string, raw_content string, text string")
    assert [r.chunk_id for r in answers.citations(hits, chunks).collect()] == ["c1"]


def test_routes_of_the_evaluation_questions(spark):
    got = {r.query_id: r.total_score for r in routing.rule_routed(fixtures.frame(spark, "questions")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [5, 0, 0, 4]
    factual = spark.createDataFrame([(1, [(n, True) for n in ("Direct factual question", "Requires one focused retrieval")], 0)], "query_id int, features array<struct<feature:string,present:boolean>>, total_score int")
    assert routing.rubric_scored(factual).first().workflow == "simple_rag"


class Provider:
    def draft(self, question, context):
        return f"about {question}", "model"

    def audit(self, question, draft, context):
        if question == "fails":
            raise RuntimeError("no model")
        return ("unsupported", False, 0.2, [], ["x"], "why") if question == "bad" else ("supported", True, 0.95, ["x"], [], "")


def test_single_pass_workflow_with_a_provider(spark):
    questions = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fails"), (4, "nothing")], "query_id int, question string")
    evidence = spark.createDataFrame([(k, "text") for k in (1, 2, 3)], "query_id int, context string")
    cited = spark.createDataFrame([(k, 1, "a.pdf", 1, "S", "c", 0.1, "s") for k in (1, 2, 3)], "query_id int, rank int, doc_name string, page_number int, section string, chunk_id string, score double, snippet string")
    got = {r.query_id: r for r in answers.answered(questions, evidence, cited, Provider()).collect()}
    assert (got[1].answer, got[1].abstained, got[1].confidence) == ("about good", False, 0.95)
    assert got[2].abstained and got[2].answer.startswith(answers.ABSTAINS) and got[2].confidence == 0.2
    assert not got[3].abstained and got[3].confidence == 0.85
    assert got[4].abstained and got[4].confidence == 1.0 and got[4].sources is None
    plain = answers.answered(questions, evidence, cited, Provider(), verify=False).where("query_id = 2").first()
    assert plain.confidence == 0.9 and not plain.abstained


def test_agent_rewrites_until_evidence_suffices(spark):
    questions = spark.createDataFrame([(1, "first question about retrieval latency"), (2, "never found anything here")], "query_id int, question string")
    plans = spark.createDataFrame([(1, [f"sub {i} needs evidence" for i in range(6)])], "query_id int, sub_questions array<string>")
    hit = "array(named_struct('chunk_id', active_query, 'doc_name', 'a.pdf', 'page_number', 1, 'section', 'S', 'snippet', 's'))"

    def search(rows):
        return rows.where("query_id = 1").select("query_id", "step", F.expr(hit).alias("hits"))

    def assess(rows):
        return rows.withColumn("sufficient", F.col("active_query").startswith("needs")).withColumn("suggested", F.lit(""))

    steps = agent.searched(agent.planned(questions, plans), search, assess).collect()
    one = [r for r in steps if r.query_id == 1]
    assert sorted(r.step for r in one) == [1, 2, 3, 4] and all(r.attempts == 2 and r.rewrites == ["needs evidence"] and r.sufficient for r in one)
    two = [r for r in steps if r.query_id == 2]
    assert [(r.attempts, r.best, r.sufficient, len(r.rewrites)) for r in two] == [(3, None, False, 2)]


def test_files_are_hashed_and_skipped_when_known(spark, tmp_path):
    import hashlib

    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.documents(spark, str(tmp_path))
    assert {r.doc_name: r.file_hash for r in found.collect()} == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.pdf", "b.pdf")}
    manifest = found.where("doc_name = 'a.pdf'").select("doc_name", "file_hash")
    assert [r.doc_name for r in files.pending(found, manifest).collect()] == ["b.pdf"]
    assert [r.doc_name for r in files.cached(found, manifest).collect()] == ["a.pdf"]
    assert files.pending(found, manifest, force=True).count() == 2


def test_ingestion_from_elements_to_an_index(spark, tmp_path):
    files.write_elements(fixtures.frame(spark, "elements"), str(tmp_path / "elements"))
    manifest = ingest.chunk_job(spark, str(tmp_path / "elements"), str(tmp_path / "chunks"))
    assert {r.element_type for r in manifest.collect()} == {"prose", "table", "code"}
    index = ingest.index_job(spark, str(tmp_path / "chunks"), str(tmp_path / "index"))
    assert index.n_docs == files.read_chunks(spark, str(tmp_path / "chunks")).count()


def test_stream_chunks_each_document_once(spark, tmp_path):
    from docquarry.streaming.ingest import ingest as stream

    rows = spark.createDataFrame([(1, "One text. Here.", "en", "s", 15), (2, "Another text.", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    run = lambda: stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows.write.parquet(str(tmp_path / "in"))
    run()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(3, "New.", "en", "s", 4)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    made = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert sorted(r.doc_name for r in made.collect()) == ["doc_1.pdf", "doc_2.pdf", "doc_3.pdf"]


def test_hashed_vectors_in_functions_equal_the_embedder(spark):
    texts = ["Größe und Maß — ✓ 😀a", "one two two", "ab", "", None, "a\u00a0b\x1cc " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.ordinal: r.embedding for r in embedding.dense(embedding.hashed_features(df, 64), 64).collect()}
    want = embedding.normalised(embedding.Hashed(64).embed(texts))
    assert sorted(got) == [i for i in range(6) if want[i].any()] == [0, 1, 2, 5]
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in got)


def test_html_elements(spark):
    page = '<html><script>x="<p>no</p>"</script><h1>Title &amp; more</h1><p>One<b> two</b><br><p>Three</p><!-- <p>no</p> --><ul><li>item</li></ul></html>'
    got = html.elements(spark.createDataFrame([(7, page), (8, None)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.element_type, r.content, r.section) for r in got] == [("heading", "Title & more", "Title & more"), ("paragraph", "One two", "Title & more"), ("paragraph", "Three", "Title & more"), ("list_item", "item", "Title & more")]


def test_overlap_of_chunks(spark):
    config = Chunking(target=12, most=15, overlap=6)
    parts = [f"Sentence number {i}." for i in range(8)]
    made = list(chunking.windows(parts, chunking.estimate, config))
    assert all(chunking.estimate(m) <= 12 for m in made) and made[1].startswith(made[0].rsplit("Sentence", 1)[1].join(["Sentence", ""]).strip())
