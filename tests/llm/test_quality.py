import re
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import boosting, quality
from docquarry.llm.shared import table
from tests.oracle import DATA


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = Counter(zip(words, words[1:], words[2:]))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if threes[tuple(words[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, sum(again)


def test_base_counts_equal_brute_force():
    texts = [None, "", " \n ", "#*", "a b c a b c", "x\nx\n\n \nx", "a\x0bb\xa0c\x85d", "é è é è é è é", "one " * 200, "a b a b a b", "l1\nl1 \nl1\r"]
    base, _ = quality.statistics(texts)
    assert [tuple(r) for r in base.tolist()] == [plain(t) for t in texts]


def test_statistics_of_all_documents(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents").collect()
    base, more = quality.statistics([r.text for r in docs])
    assert [tuple(r) for r in base.tolist()] == [plain(r.text) for r in docs] and np.isfinite(more).all()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, f"{DATA}/sf0.01", "documents"), table(spark, f"{DATA}/sf0.01", "labels")
    fitted = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judged(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert len(got) > 100 and np.mean([r.kept == bool(r.quality) for r in got]) > 0.97


def test_scores_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = ((x[:, 0] + 0.4 * np.sin(12 * x[:, 0]) + 0.2 * rng.random(3000)) > 0.6).astype(float)
    grid = np.stack([np.linspace(0, 1, 500), np.full(500, 0.5)], axis=1)
    assert (np.diff(boosting.fit(x, y, [1, 0]).score(grid)) >= -1e-12).all()
    assert (np.diff(boosting.fit(x, y, [-1, 0]).score(grid)) <= 1e-12).all()
    assert (np.diff(boosting.fit(x, y, [0, 0]).score(grid)) < 0).any()


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = (x[:, 1] > 0.5).astype(float)
    t = boosting.fit(x, y, [0, 0, 0])

    def walk(row):
        total = t.base
        for node in t.root:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return total

    assert t.score(x) == pytest.approx([walk(r) for r in x])
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(x).std() == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, True), (None, "word " * 80, False), (2, "", True), (2, " ".join(f"w{i}" for i in range(60)), True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(None, 1), (5, None), (9, 0)], "doc_id long, quality int")
    trees = quality.fit(docs, labels)
    got = quality.judged(docs, trees).collect()
    assert sorted(r.kept for r in got) == [False, False, False, True]
    kept = quality.keep(docs, trees)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert quality.judged(docs.limit(0), trees).count() == 0


def test_many_rows_of_one_labelled_id_and_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, "good words of text " * 20 + str(i)) for i in range(300)] + [(2, long), (2, long), (3, "# * # " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    trees = quality.fit(docs, labels, most=50)
    got = quality.judged(docs, trees).where("doc_id = 2").collect()
    assert len(got) == 2 and got[0] == got[1]
    assert (got[0].n_words, got[0].word_chars, got[0].n_symbols, got[0].n_dup_lines, got[0].n_repeat_words) == plain(long)


def test_the_sample_of_labels_does_not_follow_the_partitions(spark):
    docs, labels = table(spark, f"{DATA}/sf0.001", "documents"), table(spark, f"{DATA}/sf0.001", "labels")
    a, b = quality.fit(docs, labels, most=30), quality.fit(docs.repartition(5), labels, most=30)
    assert a.base == b.base and (a.value == b.value).all()
