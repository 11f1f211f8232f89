"""The ingestion job over a folder that grows."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunking
from docquarry.plans.ingest import paragraphs
from jobs import job1_ingest
from jobs.queries import ORACLE_SQL, QUERIES
from tests import oracle

SCHEMA = "doc_id long, text string, lang string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df):
    return sorted(map(str, df.select("chunk_id", "doc_name", "section_path", "text", "token_count", "ordinal").collect()))


def want(spark, rows):
    return rows_of(chunking.chunks(paragraphs(spark.createDataFrame(rows, SCHEMA))))


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / x) for x in ("source", "store", "marks")]


def test_each_run_takes_only_what_is_new(spark, places):
    source, store, _ = places
    first = [(i, f"Line {i} of text.\n" * (i * 40 + 1), "en") for i in range(6)]
    add(spark, source, first)
    assert job1_ingest.run(spark, *places) == 6 and job1_ingest.run(spark, *places) == 0
    assert rows_of(job1_ingest.current(spark, store)) == want(spark, first)
    # one new document, one again with the same bytes, one with others
    add(spark, source, [(6, "New here.", "fr"), (1, first[1][1], "en"), (2, "Another text now.", "en")])
    assert job1_ingest.run(spark, *places) == 2
    now = [r for r in first if r[0] != 2] + [(6, "New here.", "fr"), (2, "Another text now.", "en")]
    assert rows_of(job1_ingest.current(spark, store)) == want(spark, now)
    assert {(r.doc_id, r.batch) for r in job1_ingest.versions(spark, store).where("doc_id in (1, 2, 6)").collect()} == {(1, 0), (2, 0), (2, 1), (6, 1)}


def test_a_batch_that_failed_is_written_again(spark, places, monkeypatch):
    source, store, _ = places
    rows = [(i, f"Text {i}.", "en") for i in range(4)]
    add(spark, source, rows)
    real, seen = job1_ingest._appended, []

    def fails(df, path, *partitions):
        real(df, path, *partitions)
        seen.append(path)
        raise OSError("the executor is lost")

    monkeypatch.setattr(job1_ingest, "_appended", fails)
    with pytest.raises(Exception, match="the executor is lost"):
        job1_ingest.run(spark, *places)
    assert seen[0].endswith("chunks")
    monkeypatch.setattr(job1_ingest, "_appended", real)
    assert job1_ingest.run(spark, *places) == 4
    assert rows_of(job1_ingest.current(spark, store)) == want(spark, rows)


def test_odd_rows(spark, places):
    """Null ids are left out; null and empty texts are versions without chunks; null languages are no section; of two versions
    in one batch one counts."""
    source, store, _ = places
    add(spark, source, [(None, "no id", "en"), (1, None, "en"), (2, "", None), (3, "a", None), (4, "one", "en"), (4, "two", "en"), (4, "two", "en"), (5, "long word " * 60_000, "de")])
    assert job1_ingest.run(spark, *places) == 5
    got = job1_ingest.current(spark, store)
    assert {r.doc_id for r in got.collect()} == {3, 4, 5} and got.where("doc_id = 4").count() == 1
    assert got.where("doc_id = 5").agg(F.sum("char_count")).first()[0] >= 599_000
    assert {(r.doc_id, r.chunks) for r in job1_ingest.versions(spark, store).where("doc_id < 3").collect()} == {(1, 0), (2, 0)}


def test_settings_stay_as_they_were(spark, places):
    add(spark, places[0], [(1, "a", "en")])
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    job1_ingest.run(spark, *places)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None))


def test_the_command_line_reads_a_config_file(spark, places, tmp_path, monkeypatch):
    """With other columns and budgets; the session isn't stopped here, since the tests share it."""
    spark.createDataFrame([(1, "One sentence. " * 200, "en")], "number long, body string, tongue string").write.parquet(places[0])
    config = {"id_column": "number", "text_column": "body", "section_column": "tongue", "target_tokens": 100, "most_tokens": 150}
    (tmp_path / "c.json").write_text(json.dumps(config))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    job1_ingest.command(job1_ingest.__doc__, ("source", "target", "checkpoint"), job1_ingest.Settings, job1_ingest.run, ["--source", places[0], "--target", places[1], "--checkpoint", places[2], "--config", str(tmp_path / "c.json")])
    got = job1_ingest.current(spark, places[1]).collect()
    assert len(got) > 6 and max(r.token_count for r in got) < 140


def test_the_given_settings_are_those_of_the_config_file():
    import pathlib

    given = json.loads((pathlib.Path(job1_ingest.__file__).parent / "job1_ingest.json").read_text())
    assert job1_ingest.Settings(**given) == job1_ingest.Settings()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    sf = f"{oracle.DATA}/sf0.001"
    assert not oracle.differences(QUERIES[name](spark, sf), oracle.database(sf), ORACLE_SQL[name])


def test_jobs_need_nothing_of_the_optional_part():
    import pathlib

    for path in pathlib.Path(job1_ingest.__file__).parent.glob("*.py"):
        assert "docquarry.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
    assert sys.modules["jobs.job1_ingest"] is job1_ingest
