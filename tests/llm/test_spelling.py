import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import spelling
from docquarry.llm.shared import table
from tests import oracle


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    """Rows of variants() by loops over all words and all pairs of them."""
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v), default=None) for w, vs in by.items()}
    form = {w: v if v is not None and words[v] >= 2 * words[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(by[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, n=200, letters="abeéÉÿ×"):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=40)) + "\tQueen Queem QUEEN-queens") for i in range(n)]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 32), (2, 1), (3, 4)])
def test_equals_loops_over_all_pairs(spark, monkeypatch, seed, crowd):
    """Also when nearly every bucket is split by shapes."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = corpus(seed)
    want = plain(rows)
    assert any(r[1] for r in want) and found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_equals_its_sql(spark):
    sf = f"{oracle.DATA}/sf0.001"
    assert not oracle.differences(spelling.variants(table(spark, sf, "documents")), oracle.database(sf), spelling.VARIANTS_SQL)


def test_nothing_passes_through_the_driver(spark, monkeypatch):
    """No join broadcasts a table, however small Spark takes it to be: they all grow with the vocabulary."""
    frames, written = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, *a: frames.append(df) or written(df, *a))
    rows = corpus(1)
    frames.append(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found(frames[-1]) == plain(rows)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in frames]
    assert sum("Join" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_odd_tables(spark):
    """Nulls, empty and very long texts, texts without words, repeated rows, clashing columns."""
    long = "a" * 300_000 + " " + "apples apple " * 20_000
    rows = [(None, "apples"), (1, None), (2, ""), (3, "12 34"), (4, long), (4, long), (5, "applés" * 1), (6, "applés"), (7, "applés"), (8, "x" * 9 + " ÀÉÎ")]
    df = spark.createDataFrame([(*r, "w", 5, "k") for r in rows], "doc_id long, text string, word string, n int, key string")
    assert found(spelling.variants(df)) == plain(rows)
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.where("doc_id < 4")).count() == 0


def test_ties_take_the_first_word(spark):
    words = spark.createDataFrame([("stone", 4), ("stony", 9), ("stona", 9), ("storm", 2), ("stoma", 18), ("abcde", 1)], "word string, n long")
    assert {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.grouped(words).collect()} == {
        "stone": ("stona", "stoma", 2, 9), "stony": (None, "stony", 2, None), "stona": ("stoma", "stoma", 3, 18), "storm": (None, "storm", 0, None), "stoma": (None, "stoma", 1, None), "abcde": (None, "abcde", 0, None),
    }


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["aaaaaa", "baaaaa", "bbaaaa", "bbbaaa", "bbbbaa", "bbbbba", "bbbbbb"]
    got = spelling.grouped(spark.createDataFrame([(w, 2**i) for i, w in enumerate(chain)], "word string, n long"))
    assert {(r.word, r.root) for r in got.collect()} == {(w, chain[-1]) for w in chain}


_WORDS = st.text(alphabet="abcdeqzxéßþ÷", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(_WORDS, st.integers(0, 8), st.sampled_from("abqzéþ"), st.sampled_from(("delete", "insert", "replace")))
def test_one_edit_leaves_a_key_of_each_level_equal(word, i, letter, kind):
    i %= len(word)
    other = word[:i] + {"delete": "", "insert": letter + word[i], "replace": letter}[kind] + word[i + 1 :]
    if other == word:
        return
    short, long = sorted((word, other), key=len)
    same = len(short) == len(long)
    roles = (spelling.REPLACED, spelling.REPLACED) if same else (spelling.SHORT, spelling.LONG)
    a, b = ({k[1:] for k in spelling.first_keys(w) if k[0] == role} for w, role in zip((short, long), roles, strict=True))
    for level in range(4):
        shared = a & b
        assert shared
        if level == 3:
            break
        paths = {p for p, _ in shared}
        a, b = ({k[1:] for p in paths for k in spelling.next_keys(w, role, p)} for w, role in zip((short, long), roles, strict=True))


def test_each_letter_has_a_bit_and_a_band_in_each_dealing():
    assert len(set(spelling.LETTERS)) == len(spelling.LETTERS) == 90
    assert all(set(d.values()) == {0, 1, 2} for d in spelling.DEALINGS)
    for a, b in itertools.combinations(spelling.OFTEN[:9], 2):
        assert sum(d[a] == d[b] for d in spelling.DEALINGS) == 1
    assert spelling.mask("abba") == 0 and spelling.mask("abc").bit_count() == 3
