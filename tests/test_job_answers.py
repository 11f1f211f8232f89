"""The answering job over small tables."""

import json
import pathlib

import pytest

from jobs import job2_answers

TEXTS = [(1, "The index of the north keeps cold ledgers.", "src1", "en"), (2, "Harbours and tides, and nothing else.", "src2", None), (3, "", "src1", "en"), (4, None, "src1", "en"), (5, "The ledgers of the south. " * 3, "src3", "fr")]
TURNS = [(1, 0, "user", "Where are the cold ledgers of the north?"), (1, 1, "assistant", "cold"), (2, 0, "user", "Compare harbours and tides step by step"), (3, 0, "user", "zzz qqq"), (4, 0, "user", "   "), (5, 0, "user", None), (6, 0, "user", "tides"), (6, 0, "user", "ledgers")]


def tables(spark, folder):
    spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/t")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/c")
    return f"{folder}/t", f"{folder}/c"


def test_answers_citations_and_report(spark, tmp_path):
    texts, turns = tables(spark, tmp_path)
    target, config = str(tmp_path / "out"), job2_answers.Settings(least_score=0.2)
    assert job2_answers.run(spark, texts, turns, target, config) == 3
    got = {r.conv_id: r for r in job2_answers.read(spark, target).collect()}
    assert sorted(got) == [1, 2, 3, 6] and got[3].abstained and got[3].sources == 0 and got[3].score is None
    assert got[2].workflow == "agentic" and got[1].workflow == "simple_rag"
    # of a turn that comes twice the first text is asked
    assert got[6].question == "ledgers"
    best = {(r.conv_id, r.rank): r.ordinal for r in job2_answers.with_citations(spark, target).collect()}
    assert best[(1, 1)] == 1 and best[(2, 1)] == 2 and best[(3, None)] is None
    report = {r.workflow: (r.questions, r.answered) for r in spark.read.parquet(f"{target}/report").collect()}
    assert report == {"agentic": (1, 1), "simple_rag": (3, 2)}


def test_a_second_run_gives_the_same(spark, tmp_path):
    texts, turns = tables(spark, tmp_path)
    target = str(tmp_path / "out")
    seen = []
    for _ in range(2):
        job2_answers.run(spark, texts, turns, target)
        seen.append(sorted(map(str, job2_answers.with_citations(spark, target).collect())))
    assert seen[0] == seen[1] and seen[0]


def test_a_higher_threshold_abstains(spark, tmp_path):
    texts, turns = tables(spark, tmp_path)
    assert job2_answers.run(spark, texts, turns, str(tmp_path / "out"), job2_answers.Settings(least_score=99.0)) == 0
    assert job2_answers.read(spark, str(tmp_path / "out")).where("abstained").count() == 4


def test_empty_tables(spark, tmp_path):
    """No question gives no answer; no text at all is an error."""
    texts, _ = tables(spark, tmp_path)
    none = str(tmp_path / "none")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(none)
    assert job2_answers.run(spark, texts, none, str(tmp_path / "o")) == 0 and job2_answers.with_citations(spark, str(tmp_path / "o")).count() == 0
    spark.read.parquet(texts).limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="nothing to index"):
        job2_answers.run(spark, str(tmp_path / "empty"), none, str(tmp_path / "o2"))


def test_the_command_line(spark, tmp_path, monkeypatch):
    texts, turns = tables(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"citations": 1, "least_score": 0.2}))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    job2_answers.command(job2_answers.__doc__, ("texts", "conversations", "target"), job2_answers.Settings, job2_answers.run, ["--texts", texts, "--conversations", turns, "--target", str(tmp_path / "o"), "--config", str(tmp_path / "c.json")])
    assert {r.sources for r in job2_answers.read(spark, str(tmp_path / "o")).collect()} == {0, 1}


def test_the_given_settings_are_those_of_the_config_file():
    given = json.loads((pathlib.Path(job2_answers.__file__).parent / "job2_answers.json").read_text())
    assert job2_answers.Settings(**given) == job2_answers.Settings()
