"""Rows on which queries once differed from their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from docquarry import queries
from docquarry.operators import answers, embedding, layout, retrieval
from docquarry.plans import ingest
from jobs import queries as jobs
from tests import oracle

TEXTS = ["Ends in 4990", "0 first", "1\n21 and 1\n2", " two  ", " three \n \n\tfour\t", "five six\n", "five six sev\n", "a > b", None, ""]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with a table of odd texts, and one of more vectors of one label than a search keeps."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(6 * i + 3, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    vectors.coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def database(path):
    con = oracle.database("/nowhere")
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["concise_section", "document_chunks", "document_chunk_manifest", "fused_fixture"])
def test_odd_rows_equal_sql(spark, odd, name):
    assert not oracle.differences(queries.QUERIES[name](spark, odd), database(odd), queries.ORACLE[name])


def test_ingested_odd_rows_equal_sql(spark, odd):
    assert not oracle.differences(jobs.job1_ingest_documents(spark, odd), database(odd), jobs.ORACLE_SQL["job1_ingest_documents"])


def test_paragraphs_keep_their_digits(spark):
    rows = spark.createDataFrame([(1, "40 is 0\n 1 and 1 \n2", "en")], "doc_id long, text string, lang string")
    assert [r.content for r in ingest.paragraphs(rows).orderBy("ord").collect()] == ["40 is 0", "1 and 1", "2"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_texts_are_not_shuffled(spark):
    """Unless rows share an id, which then are one text."""
    rows = [(1, "a b a ab"), (2, "B c"), (3, ""), (4, None)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([*rows, (2, "b d"), (1, "a"), (3, "é")], "doc_id long, text string")
    assert "Exchange" not in plan(retrieval.postings(once)) and "Exchange" not in plan(embedding.hashed_features(once))
    assert {(r.ordinal, r.term): r.tf for r in retrieval.postings(many).collect()} == {(1, "a"): 3, (1, "b"): 1, (1, "ab"): 1, (2, "b"): 2, (2, "c"): 1, (2, "d"): 1, (3, "é"): 1}
    index = retrieval.build(many)
    assert {(r.ordinal, r.term): (r.tf, r.dl) for r in index.postings.collect()}[2, "b"] == (2, 4) and (index.n_docs, index.words) == (7, 10)
    got, texts = embedding.dense(embedding.hashed_features(many)).collect(), {1: "a b a ab a", 2: "b c b d", 3: "é"}
    want = embedding.normalised(embedding.Hashed().embed([texts[r.ordinal] for r in got]))
    assert len(got) == 3 and all(abs(a - b) < 1e-6 for r, w in zip(got, want, strict=True) for a, b in zip(r.embedding, w, strict=True))


def test_hits_do_not_shuffle_texts(spark):
    texts = spark.range(50).select(F.col("id").alias("ordinal"), F.lit("d").alias("doc_name"), F.lit(1).alias("page_number"), F.lit("a > b").alias("section_path"), F.lit("c").alias("chunk_id"), F.lit("t").alias("raw_content"), F.lit("t").alias("text"))
    hits = retrieval.ranked(texts.select(F.lit(1).alias("query_id"), "ordinal", F.rand(3).alias("score")), 5, "score", F.col("ordinal").asc())
    for made in (retrieval.results(hits.withColumn("dense_rank", F.lit(1)).withColumn("sparse_rank", F.lit(1)), texts), answers.citations(hits, texts, every=True)):
        assert "SortMergeJoin" not in plan(made) and "Window" not in plan(made)


def test_a_text_is_cleaned_once_for_all_footers(spark):
    texts = ["Page 1 of 5", " page\t2 ", "", " \n", None, "Page 1 of 5 x", "a\nPage 1", "SENIOR AI ENGINEER ASSESSMENT, part 2", "S E N I O R A I  E N G I N E E R", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", layout.is_header_or_footer(F.col("text")).alias("x"))
    assert [r.x for r in rows.orderBy("i").collect()] == [True, True, True, True, None, False, False, True, True, False]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 2


def shuffled(spark) -> int:
    """Bytes of shuffles that the session has written."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteBytes()
    return n


def many_questions(spark):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), i * 5).cast("string"))), " ").alias("text"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i, F.lit(7)), i * 9).cast("string"))), " ").alias("text"))
    return retrieval.build(texts), asked


def test_what_many_questions_shuffle_does_not_grow_with_texts_times_questions(spark, monkeypatch):
    """Postings are dealt out once, whatever the number of questions, and the tables between are deleted."""
    index, asked = many_questions(spark)
    want = {(r.query_id, r.ordinal, r.rank): r.score for r in retrieval.search_sparse(index, asked, 3).collect()}
    monkeypatch.setattr(retrieval, "PARTS", 10)
    monkeypatch.setattr(retrieval, "CELL", 2_000)
    gone, forget = [], retrieval.forget
    monkeypatch.setattr(retrieval, "forget", lambda df: gone.append(df.inputFiles()) or forget(df))
    took = []
    for questions in (1000, 10):
        monkeypatch.setattr(retrieval, "QUESTIONS", questions)
        before = shuffled(spark)
        got = {(r.query_id, r.ordinal, r.rank): r.score for r in retrieval.search_sparse(index, asked, 3).collect()}
        took.append(shuffled(spark) - before)
        assert got == want
    assert took[1] < 2 * took[0]
    assert len(gone) == 6 and not any(os.path.exists(f.removeprefix("file:")) for files in gone for f in files)


def test_words_with_one_number_are_told_apart(spark, monkeypatch):
    index, asked = many_questions(spark)
    want = sorted(map(str, retrieval.search_sparse(index, asked, 3).collect()))
    key, salts = retrieval._key, []
    monkeypatch.setattr(retrieval, "_key", lambda salt: salts.append(salt) or (key(salt) if salt else F.length("term").cast("long")))
    monkeypatch.setattr(retrieval, "PARTS", 10)
    assert sorted(map(str, retrieval.search_sparse(index, asked, 3).collect())) == want and max(salts) == 1


def test_the_index_of_the_answering_job_leaves_no_tables_behind(spark, tmp_path):
    index, _ = many_questions(spark)
    files = [f.removeprefix("file:") for df in (index.postings, index.lengths, index.terms) for f in df.inputFiles()]
    index.save(str(tmp_path / "i"))
    assert all(map(os.path.exists, files))
    index.forget()
    assert files and not any(map(os.path.exists, files)) and retrieval.load(spark, str(tmp_path / "i")).terms.count()


def test_hybrid_search_asks_every_item(spark, monkeypatch):
    """In several parts too, where there are more than a dense search takes."""
    sf = f"{oracle.DATA}/sf0.001"
    n = queries.table(spark, sf, "benchmark").count()
    for batch in (retrieval.BATCH, 30):
        monkeypatch.setattr(retrieval, "BATCH", batch)
        got = queries.QUERIES["hybrid_rrf"](spark, sf)
        assert got.select("query_id").distinct().count() == n
        assert not oracle.differences(got, oracle.database(sf), queries.ORACLE["hybrid_rrf"])
