"""Jobs from layout files to an index, and requests from validation to answers."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docquarry import fixtures, schemas
from docquarry.operators import agent, answers, chunking, layout, retrieval
from docquarry.plans import ingest, service
from docquarry.sources import files


def layout_files(spark, folder):
    for name in ("blocks", "spans", "grids"):
        fixtures.frame(spark, name).write.json(f"{folder}/{name}")


def test_from_layout_files_to_an_index(spark, tmp_path):
    """What a front end would write, by the command line, job after job."""
    layout_files(spark, str(tmp_path / "layout"))
    ingest.main(["extract", "--input-dir", str(tmp_path / "layout"), "--output-dir", str(tmp_path / "out"), "-v"])
    want = layout.elements(*[fixtures.frame(spark, n) for n in ("blocks", "spans", "grids")]).select(F.col("doc").alias("doc_name"), "ord", F.col("page").alias("page_number"), "element_type", "content", "section")
    assert sorted(map(str, files.read_elements(spark, str(tmp_path / "out" / "elements")).collect())) == sorted(map(str, want.collect()))
    ingest.main(["chunk", "--input-dir", str(tmp_path / "out" / "elements"), "--output-dir", str(tmp_path / "chunks")])
    by_doc = {r.doc_name: r.chunks for r in spark.read.parquet(str(tmp_path / "chunks-manifest" / "doc_name")).collect()}
    assert by_doc == {d: files.read_chunks(spark, str(tmp_path / "chunks"), d).count() for d in ("report.pdf", "other_doc.v2.pdf")}
    ingest.main(["index", "--input-dir", str(tmp_path / "chunks"), "--output-dir", str(tmp_path / "index"), "--probe", "Beta latency"])
    with pytest.raises(RuntimeError):
        ingest.index_job(spark, str(tmp_path / "chunks"), str(tmp_path / "index"), probe="nowhere")
    with pytest.raises(FileNotFoundError):
        ingest.chunk_job(spark, str(tmp_path / "missing"), str(tmp_path / "chunks"))


def test_documents_of_the_same_bytes_are_kept(spark, tmp_path):
    frames = [fixtures.frame(spark, n) for n in ("blocks", "spans", "grids")]
    hashes = spark.createDataFrame([("report.pdf", "a"), ("other_doc.v2.pdf", "b")], "doc_name string, file_hash string")
    path = str(tmp_path / "out")
    status = lambda: {r.doc_name: r.status for r in spark.read.parquet(f"{path}/documents").collect()}
    first = ingest.extract_job(*frames, path, hashes).first()
    assert status() == {"report.pdf": "extracted", "other_doc.v2.pdf": "extracted"}
    changed = [frames[0].withColumn("text", F.upper("text")), *frames[1:]]
    before = files.read_elements(spark, f"{path}/elements").where("doc_name = 'report.pdf'").collect()
    again = ingest.extract_job(*changed, path, hashes.withColumn("file_hash", F.when(F.col("doc_name") == "report.pdf", "a").otherwise("new"))).first()
    assert status() == {"report.pdf": "cached", "other_doc.v2.pdf": "extracted"} and again == first
    after = files.read_elements(spark, f"{path}/elements")
    assert sorted(map(str, after.where("doc_name = 'report.pdf'").collect())) == sorted(map(str, before))
    assert after.where("doc_name = 'other_doc.v2.pdf' and content rlike 'APPLES'").count() == 1
    ingest.extract_job(*changed, path, hashes, force=True)
    assert set(status().values()) == {"extracted"}
    # without its Markdown a document is extracted anew
    files.write_markdown(files.cut(files.read_markdown(spark, f"{path}/markdown").where("doc <> 'report.pdf'"), "rest"), f"{path}/markdown")
    ingest.extract_job(*changed, path, hashes)
    assert status() == {"report.pdf": "extracted", "other_doc.v2.pdf": "cached"}


def test_only_the_folders_of_changed_documents_are_written(spark, tmp_path):
    """New, changed and vanished documents; other folders keep their files, and a failure before the manifest is made good."""
    path = str(tmp_path / "out")
    names = [f"d{i}.pdf" for i in range(40)]
    blocks = lambda texts: spark.createDataFrame([(n, 1, 0, 0, 0.0, 0.0, 9.0, 9.0, t) for n, t in texts.items()], schemas.BLOCKS)
    none = [spark.createDataFrame([], s) for s in (schemas.SPANS, schemas.GRIDS)]
    hashes = lambda texts: spark.createDataFrame(list(texts.items()), "doc_name string, file_hash string")
    run = lambda texts: ingest.extract_job(blocks(texts), *none, path, hashes(texts))
    texts = {n: f"Text of {n}" for n in names}
    run(texts)
    stamp = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*.json")}
    before = stamp()
    texts["d3.pdf"], texts["d77.pdf"] = "Another text", "A new text"
    manifest = files.write_manifest

    def fails(*a):
        raise OSError("lost")

    monkey = pytest.MonkeyPatch()
    monkey.setattr(files, "write_manifest", fails)
    with pytest.raises(OSError):
        run(texts)
    monkey.undo()
    run(texts)
    content = lambda: {r.doc_name: r.content for r in files.read_elements(spark, f"{path}/elements").collect()}
    assert content() == texts and set(files.read_markdown(spark, f"{path}/markdown").select("doc").toPandas()["doc"]) == set(texts) and files.write_manifest is manifest
    kept = {p for p, t in stamp().items() if before.get(p) == t}
    assert len(kept) >= 2 * 30
    # a document that is alone in its folder goes: all folders are written
    del texts["d5.pdf"]
    run(texts)
    assert content() == texts


def test_sinks_deal_documents_to_a_fixed_number_of_folders(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("doc_"), "id").alias("doc_name"), F.lit(1).alias("ord"), F.lit(1).alias("page_number"), F.lit("paragraph").alias("element_type"), F.lit("text").alias("content"), F.lit("s").alias("section"))
    files.write_elements(rows, str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("bucket=*"))) <= files.BUCKETS and files.read_elements(spark, str(tmp_path / "e")).count() == 600


def test_null_contents_are_empty(spark):
    rows = [("a.pdf", i, 1, k, None, None) for i, k in enumerate(("paragraph", "heading", "table", "code"))] + [("a.pdf", 5, 1, "paragraph", "text", None)]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_name string, ord int, page_number int, element_type string, content string, section string")).collect()
    assert [(r.element_type, r.raw_content) for r in sorted(got, key=lambda r: r.ordinal)] == [("prose", "###"), ("table", ""), ("code", ""), ("prose", "text")]


def test_vectors_of_other_dimensions(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.5, 0.5])], "ordinal long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.ordinal for r in retrieval.search_dense(vectors, q, 9).orderBy("rank").collect()] == [1, 4]
    assert retrieval.search_dense(vectors, q.limit(0), 9).count() == 0
    with pytest.raises(ValueError):
        retrieval.search_dense(vectors, q.unionByName(spark.createDataFrame([(2, [1.0])], q.schema)), 9)


class Provider:
    """Notes what an audit reads in the reply that it gives."""

    def draft(self, question, context):
        return f"{question}: {len(context)}", "model"

    def audit(self, question, draft, context):
        return "supported", True, 0.123456, [context], [], ""


def requests(spark):
    rows = [(1, "what is latency", "auto", 2), (2, "what is latency", None, None), (3, "x", "auto", 5), (4, "what is latency", "agentic", None), (5, "zzz qqq", "agentic", None), (6, None, None, None), (7, "what is latency", "other", 1)]
    return spark.createDataFrame(rows, "query_id long, question string, force_workflow string, top_k int")


def corpus(spark):
    rows = [(i, f"latency of part {i} " * (i + 1), f"doc{i % 3}.pdf", 1, "S", f"c{i}") for i in range(12)]
    return spark.createDataFrame(rows, "ordinal long, text string, doc_name string, page_number int, section_path string, chunk_id string").withColumn("raw_content", F.col("text"))


def test_requests_from_validation_to_answers(spark):
    chunks = corpus(spark)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "ordinal long, embedding array<float>")
    embed = lambda rows: rows.withColumn("embedding", F.when(F.col("request") != 5, F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>")))
    built = retrieval.build(chunks, vectors, id_col="ordinal")
    got = {r.query_id: r for r in service.answer(built, chunks, requests(spark), embed, Provider()).collect()}
    assert {k: r.refused for k, r in got.items()} == {1: None, 2: None, 3: "query", 4: None, 5: None, 6: "query", 7: "force_workflow"}
    assert (got[1].workflow, got[1].sources, got[2].sources, got[4].workflow) == ("simple_rag", 2, 5, "agentic")
    assert got[1].confidence == got[4].confidence == 0.1235 and got[4].model_used == "model"
    assert (got[5].abstained, got[5].confidence, got[5].answer, got[5].sources, got[5].model_used) == (True, 0.0, answers.NO_EVIDENCE, 0, "none")
    plain = {r.query_id: r for r in service.answer(built, chunks, requests(spark), embed).collect()}
    assert plain[4].model_used == "extractive" and plain[4].confidence == 0.85 and plain[4].answer.startswith("### Sub-Question 1: what is latency\n- [doc")


def test_an_agent_is_audited_over_its_first_sources(spark):
    hits = [{"chunk_id": f"c{i}", "doc_name": "a.pdf", "page_number": i, "section": "S", "snippet": f"s{i}"} for i in range(12)]
    steps = spark.createDataFrame([(1, 1, json.dumps(hits))], "query_id int, step int, h string").select("query_id", "step", F.from_json("h", "array<struct<chunk_id:string,doc_name:string,page_number:int,section:string,snippet:string>>").alias("best"))
    assert agent.audited_context(agent.evidence(steps)).first().proof == "\n".join(f"- [a.pdf, p.{i}]: s{i}" for i in range(8))


def test_evidence_is_assessed_by_a_model(spark):
    def ask(sub, query, snippets):
        if "fails" in sub:
            raise RuntimeError("no model")
        return "better" in query, f"better {sub}"

    hit = "array(named_struct('chunk_id', active_query, 'doc_name', 'a.pdf', 'page_number', 1, 'section', 'S', 'snippet', 's'))"
    questions = spark.createDataFrame([(1, "weak question"), (2, "it fails")], "query_id int, question string")
    steps = {r.query_id: r for r in agent.searched(agent.planned(questions), lambda rows: rows.select("query_id", "step", F.expr(hit).alias("hits")), agent.assessed(ask)).collect()}
    assert (steps[1].attempts, steps[1].rewrites, steps[1].sufficient) == (2, ["better weak question"], True)
    assert (steps[2].attempts, steps[2].rewrites) == (1, [])


def test_temporary_folders_are_for_one_machine(spark):
    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=master))
    assert files.shared_folder(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert files.shared_folder(session("local[4]")) == files.shared_folder(session("local[4]")) != files.shared_folder(session("local[2]"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            files.shared_folder(session(master))
