import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import forest_dedup, simhash
from docquarry.llm.shared import table, written
from tests import oracle

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words)} if 0 < len(words) < 3 else {b" ".join(words[i : i + 3]) for i in range(len(words) - 2)}


def plain(rows):
    """Rows of near_duplicates() by comparing all pairs, for ids that may be null or repeated."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_copies(seed, groups=12, copies=9, words=60, edits=3):
    """Groups of texts around one each, some of them just not similar, in an order of ids that says nothing."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        own = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(copies):
            new = list(own)
            for _ in range(rng.randint(0, edits)):
                new[rng.randrange(words)] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(new))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_pairs(spark, seed):
    rows = near_copies(seed)
    want = plain(rows)
    assert len({r[2] for r in want}) > 12 and found(forest_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want


def test_the_rest_is_exact_without_any_neighbour(spark, monkeypatch):
    """What the forest doesn't find, however little that is, the comparison after it does."""
    monkeypatch.setattr(forest_dedup, "LEAST", forest_dedup.DEPTH + 1)
    rows = near_copies(3, groups=5)
    assert found(forest_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_equals_its_sql(spark):
    sf = f"{oracle.DATA}/sf0.001"
    assert not oracle.differences(forest_dedup.near_duplicates(table(spark, sf, "documents")), oracle.database(sf), forest_dedup.NEAR_SQL)


def test_odd_tables(spark):
    """Nulls, empty and very long texts, few words, repeated rows, ties, clashing columns."""
    long = " ".join(f"v{i % 70_000}" for i in range(150_000))
    rows = [(None, "one two three four"), (9, "ONE two\tthree  four"), (5, None), (6, ""), (7, " \n "), (8, "One Two"), (3, "one two"), (2, "two one"), (10, long), (11, long + " end"), (11, long + " end"), (None, None), (12, "alone with words of its own")]
    df = spark.createDataFrame([(*r, "f", 1, "k") for r in rows], f"{SCHEMA}, fp string, size int, component_id string")
    got = forest_dedup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found(got) == plain(rows)
    assert forest_dedup.near_duplicates(df.limit(0)).count() == 0 and forest_dedup.near_duplicates(df.where("text is null")).count() == 2


def test_a_third_of_all_rows_in_one_group(spark):
    rng = random.Random(5)
    own = [f"w{i}" for i in range(80)]
    rows = [(1000 + i, " ".join(own)) for i in range(200)]
    for i in range(200):
        new = list(own)
        new[rng.randrange(80)] = f"x{i}"
        rows.append((2000 + i, " ".join(new)))
    rows += [(i, " ".join(f"y{rng.randrange(9000)}" for _ in range(30))) for i in range(100)]
    got = found(forest_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {r[2] for r in got if r[0] >= 1000} == {1000} and all(r[3] for r in got if r[0] < 1000)


def test_neighbours_of_sparse_regions_are_nearly_all_similar_pairs(spark):
    rows = near_copies(7, groups=150, copies=3, edits=2)
    sets = [simhash.hashed([t], 3, once=True)[0] for _, t in rows]
    sizes = np.array([len(s) for s in sets])
    signed = forest_dedup.signatures(np.concatenate(sets), sizes)
    nodes = written(spark.createDataFrame([(i, x.tobytes(), int(n)) for i, (x, n) in enumerate(zip(signed, sizes, strict=True))], "fp long, signature binary, size int"), "nodes")
    met = {tuple(r) for r in forest_dedup.Forest().pairs(nodes).collect()}
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (c := len(set(sets[i]) & set(sets[j]))) and 100 * c >= 85 * (sizes[i] + sizes[j] - c)]
    assert len(near) > 150 and sum(p in met for p in near) >= 0.99 * len(near) and len(met) < 20 * len(near)


def test_pairs_across_ranges_are_met(spark):
    """Orders cut into many ranges give the same pairs as uncut ones."""
    rows = near_copies(8, groups=40, copies=2, edits=1)
    sets = [simhash.hashed([t], 3, once=True)[0] for _, t in rows]
    signed = forest_dedup.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    nodes = written(spark.createDataFrame([(i, x.tobytes(), len(s)) for i, (x, s) in enumerate(zip(signed, sets, strict=True))], "fp long, signature binary, size int"), "nodes")
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({tuple(r) for r in forest_dedup.Forest().pairs(nodes).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got[0] and got[0] == got[1]


def test_texts_of_common_sentences_meet_by_their_rare_shingles(spark, monkeypatch):
    """Ten sentences out of 200 each: no pair is similar, and few share a key, as shingles across sentences come first."""
    rng = random.Random(1)
    pool = [" ".join(f"s{i}w{j}" for j in range(10)) for i in range(200)]
    met = {}
    across = simhash._across
    monkeypatch.setattr(simhash, "_across", lambda many, nodes, similarity: met.update(n=many.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]) or across(many, nodes, similarity))
    for n in (500, 1000):
        rows = [(i, " ".join(rng.choices(pool, k=10))) for i in range(n)]
        groups = simhash.similar_groups(spark.createDataFrame(rows, SCHEMA))
        assert groups.select("root").distinct().count() == n
        met[n] = met["n"] or 0
    assert met[1000] < 20_000
