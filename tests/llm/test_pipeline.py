import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers

import corpus_pipeline
from docquarry.llm import materialise, mixing, quality, queries, secrets, simhash
from docquarry.llm.shared import table
from tests.llm.test_secrets import KEY
from tests.oracle import DATA, database, differences

SF = f"{DATA}/sf0.001"


def test_stages_keep_the_columns_and_only_known_rows(spark):
    docs = table(spark, SF, "documents")
    columns, known = docs.columns, {r.doc_id for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= known, name
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1]
    assert not docs.where("text rlike 'token = \"[0-9a-f]{40}'").count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) > 100 and all(len(r.token_bytes) == 4 * r.n_tokens for r in got)


def test_masks_stay_out_of_the_candidates(spark):
    df = spark.createDataFrame([(1, f"password={secrets.MASK}", "s")], "doc_id long, text string, source string")
    assert secrets.report(df).count() == 0


def test_queries_with_sql(spark):
    con = database(SF)
    for name, sql in queries.ORACLE_SQL.items():
        assert not differences(queries.QUERIES[name](spark, SF), con, sql), name


def test_every_query_covers_its_table(spark):
    n = {t: table(spark, SF, t).count() for t in ("documents", "pages")}
    for name, f in queries.QUERIES.items():
        if name not in ("op2_feistel_shards", "op9_secret_forest"):
            assert f(spark, SF).count() == n["pages" if name.startswith(("op6", "op8")) else "documents"], name


def tables(spark, folder, rows, schema="doc_id long, text string, lang string, source string, n_chars long, masked string, _size int, c0 int, root string, fp long"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long text, columns with the operators' own names."""
    words = " ".join(f"word{i} of text" for i in range(60))
    long = " ".join(f"long{i}" for i in range(150_000))
    more = ("m", 1, 2, "r", 3)
    rows = [(None, None, None, None, None, None, None, None, None, None), (1, words, "en", "s", 9, *more), (1, words, "en", "s", 9, *more), (None, words + " and an end", "en", None, 9, *more), (2, "", "en", "s", 0, *more), (3, long, "en", "s", 9, *more), (4, f"{words[::-1]} password=9f8a7c6b5d4e3f2a1b", None, "t", None, *more)]
    folder = tables(spark, tmp_path, rows)
    docs, columns = table(spark, folder, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    kept = {r.doc_id for r in docs.collect()}
    # the copy without an id is near the first text, whose id stays
    assert kept <= {1, 3, 4} and not docs.where("text is null or text rlike '9f8a7c6b5d'").count()
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == kept


def test_run_over_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).collect() == []


def test_run_equals_plain_versions_of_its_stages(spark):
    docs = table(spark, SF, "documents")
    judged = {r.doc_id: r.kept for r in quality.judged(docs, quality.fit(docs, table(spark, SF, "labels"))).collect()}
    rows = sorted((r for r in docs.collect() if judged[r.doc_id]), key=lambda r: r.doc_id)
    sets = [set(simhash.shingles(r.text, 5)) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    mask = lambda m: m.group().replace(m.group(1) or m.group(2) or m.group(), secrets.MASK)
    kept = [(r.doc_id, KEY.sub(mask, r.text), r.source) for r in rows]
    con = duckdb.connect()
    con.register("kept", pd.DataFrame(kept, columns=["doc_id", "text", "source"]))
    copies = dict(con.execute(f"WITH {mixing.mix_sql('kept')} SELECT doc_id, copies FROM mixed").fetchall())
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = materialise.encoder(f.read(), public_tokenizers.PATTERN)
    ids = {doc: np.array(enc.encode_ordinary(text), dtype="<u4") for doc, text, _ in kept}
    want = sorted((doc, len(x), hashlib.sha256(x.tobytes()).hexdigest()) for doc, x in ids.items() for _ in range(copies[doc]))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want
