"""Columns of a table may have the names that operators use for their own."""

from docquarry.llm import mixing, quality, secrets, simhash


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "n_chars", "_size", "_copies", "masked", "is_null", "text_hash", "a.b", "_target", "c0", "kept"]
    words = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, words + " password=9f8a7c6b5d4e3f2a1b", "s", 9, *range(9)), (2, words, "s", 9, *range(9))], names)
    trees = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    for got in (quality.keep(df, trees), simhash.one_of_each(df), secrets.redacted(df, count_col="n_chars"), mixing.emitted(df)):
        assert got.columns == names
        assert all(tuple(r)[4:] == tuple(range(9)) for r in got.collect())
