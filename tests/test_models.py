import numpy as np
import pytest

from docquarry import config, fixtures
from docquarry.operators import answers, embedding, models, retrieval
from docquarry.plans import ingest


class Flaky:
    dimension = 4

    def __init__(self, failures):
        self.failures, self.calls = failures, []

    def embed(self, texts, kind="document"):
        self.calls.append(len(texts))
        if self.failures:
            self.failures -= 1
            raise RuntimeError("busy")
        return np.ones((len(texts), 4))


def test_embedding_retries_in_batches():
    pauses, inner = [], Flaky(2)
    e = embedding.Retrying(inner, sleep=pauses.append)
    assert e.embed(["t"] * 32).shape == (32, 4) and pauses == [2.0, 4.0, 0.5, 0.5] and inner.calls == [15, 15, 15, 15, 2]
    with pytest.raises(RuntimeError):
        embedding.Retrying(Flaky(3), sleep=pauses.append).embed(["t"])


def test_fallback_needs_one_dimension():
    e = embedding.Either(Flaky(9), embedding.Hashed(4))
    assert e.embed(["a b"]).shape == (1, 4) and e.failed
    with pytest.raises(ValueError):
        embedding.Either(Flaky(0), embedding.Hashed(5))


def test_a_provider_is_chosen_by_a_probe():
    asked = []

    def call(texts, kind):
        asked.append((len(texts), kind))
        return [[1.0, 2.0, 3.0, 4.0]] * len(texts)

    remote, down = embedding.Remote(call, 4), Flaky(99)
    assert embedding.chosen("auto", remote) is remote and asked == [(1, "query")] and embedding.chosen("remote", down) is down
    assert isinstance(embedding.chosen("auto", down), embedding.Hashed) and isinstance(embedding.chosen("auto"), embedding.Hashed) and embedding.chosen("local", remote, down) is down
    assert embedding.Either(remote, embedding.Hashed(4)).embed(["a", "b"], "query").shape == (2, 4) and asked[-1] == (2, "query")
    for wrong in (("remote",), ("other", remote)):
        with pytest.raises(ValueError):
            embedding.chosen(*wrong)


def test_settings_of_the_session_and_the_environment(spark):
    spark.conf.set("spark.docquarry.chunking.target", "300")
    try:
        got = config.configured(config.Chunking, spark, {"DOCQUARRY_CHUNKING_TARGET": "200", "DOCQUARRY_CHUNKING_BREADCRUMBS": "false"})
    finally:
        spark.conf.unset("spark.docquarry.chunking.target")
    assert (got.target, got.most, got.breadcrumbs) == (300, 600, False)
    assert config.configured(config.Retrieval, environment={"DOCQUARRY_RETRIEVAL_MIN_SCORE": "0.5"}).min_score == 0.5
    with pytest.raises(ValueError):
        config.configured(config.Chunking, environment={"DOCQUARRY_CHUNKING_BREADCRUMBS": "perhaps"})


def test_vectors_have_length_one_and_find_their_text(spark):
    df = spark.createDataFrame([(0, "vector search latency"), (1, "cooking with salt"), (2, "")], "ordinal long, text string")
    got = embedding.embedded(df, embedding.Hashed())
    norms = {r.ordinal: np.linalg.norm(r.embedding) for r in got.collect()}
    assert norms == {0: pytest.approx(1), 1: pytest.approx(1), 2: 0}
    asked = embedding.embedded(spark.createDataFrame([(1, "latency of vectors")], "query_id long, text string"), embedding.Hashed())
    assert retrieval.search_dense(got.where("ordinal < 2"), asked, 1).first().ordinal == 0


def answer(model, prompt, system):
    if model == "down":
        raise RuntimeError("down")
    return {"plain": "no value", "json": 'so {"ok": 1}', "pad": "* Question: q\n* Constraint: c\n\n*   Option\n\nDone."}[model]


def chain(*names):
    return models.Chain(answer, *names, sleep=lambda s: None)


def test_chain_falls_back_and_repairs():
    assert chain("down", "pad").generate("p") == ("* Question: q\n* Constraint: c\n\nDone.", "pad")
    assert chain("plain", "json").generate_json("p") == ({"ok": 1}, "json")
    with pytest.raises(ValueError):
        chain("plain", "plain").generate_json("p")
    with pytest.raises(RuntimeError, match="down"):
        chain("down", "down").generate("p")
    assert models.Chain(answer, "a", "b", ("b", "", "c")).models("flash") == ["b", "a", "c"]


def test_provider_in_the_workflow(spark):
    def call(model, prompt, system):
        return '{"status": "unsupported", "is_grounded": false, "confidence": 0.1}' if "Check each claim" in prompt else "A draft."

    provider = models.ChainProvider(models.Chain(call, "m", "n"))
    questions = spark.createDataFrame([(1, "q")], "query_id int, question string")
    evidence = spark.createDataFrame([(1, "text")], "query_id int, context string")
    cited = spark.createDataFrame([(1, 1, "a.pdf", 1, "S", "c", 0.1, "s")], "query_id int, rank int, doc_name string, page_number int, section string, chunk_id string, score double, snippet string")
    got = answers.answered(questions, evidence, cited, provider).first()
    assert (got.draft, got.abstained, got.confidence, got.model_used) == ("A draft.", True, 0.1, "m")


def test_extraction_job(spark, tmp_path):
    frames = [fixtures.frame(spark, n) for n in ("blocks", "spans", "grids")]
    got = ingest.extract_job(*frames, str(tmp_path)).first()
    assert got.documents == 2 and got.total_pages == 3 and got.total_tables > 3
    assert ingest.chunk_job(spark, str(tmp_path / "elements"), str(tmp_path / "chunks")).count() > 1
    with pytest.raises(FileNotFoundError):
        ingest.extract_job(*[f.limit(0) for f in frames], str(tmp_path / "none"))
