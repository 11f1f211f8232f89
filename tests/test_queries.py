"""Every query gives the rows of its SQL, over the given tables and, where it has tables derived from them, over the fixtures that
show the edges of each rule."""

import pytest
from pyspark.sql import functions as F

from docquarry import derived, fixtures, queries
from docquarry.operators import layout
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
DERIVED = sorted(name for name, sql in queries.ORACLE.items() if any(derived.sql(n) in sql for n in derived.DUCK))


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF)


def on_fixtures(sql: str) -> str:
    sql = sql.replace(queries.ELEMENTS, fixtures.values("elements"))
    for n in derived.DUCK:
        sql = sql.replace(derived.sql(n), fixtures.values(n))
    return sql


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert not oracle.differences(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


@pytest.mark.parametrize("name", DERIVED)
def test_query_equals_sql_on_the_fixtures(spark, con, name):
    assert not oracle.differences(queries.QUERIES[name](spark, queries.FIXTURES), con, on_fixtures(queries.ORACLE[name]))


def test_every_query_has_sql_and_reads_a_given_table():
    assert set(queries.QUERIES) == set(queries.ORACLE) and len(DERIVED) == 41
    given = [t for t in oracle.TABLES if t in ("documents", "pages", "conversations", "labels", "embeddings", "benchmark")]
    assert all(any(f"FROM {t}" in sql or f"JOIN {t}" in sql for t in given) for sql in queries.ORACLE.values())


@pytest.mark.parametrize("name", sorted(derived.DUCK))
def test_derived_tables_are_the_same_in_both_engines(spark, con, name):
    rows = derived.frame(spark, SF, name)
    assert not oracle.differences(rows, con, f"SELECT * FROM {derived.sql(name)}") and rows.columns == [c for c, _ in fixtures.columns(name)]


def test_section_paths_of_a_long_part(spark):
    """A path has every title since the last of rank 1, however many there are."""
    rows = spark.range(3000).select(F.lit("d").alias("doc"), F.col("id").alias("ord"), F.when(F.col("id") == 1500, 1).when(F.col("id") % 500 == 0, 2).alias("rank")).withColumn("title", F.when(F.col("rank").isNotNull(), F.concat(F.lit("t"), "ord")))
    got = {r.ord: r.section for r in layout.section_path(rows, ["ord"]).collect()}
    assert got[499] == "Introduction > t0" and got[1499] == "Introduction > t0 > t500 > t1000" and got[1500] == "t1500" and got[2999] == "t1500 > t2000 > t2500"
