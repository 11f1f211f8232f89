import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import graph, simhash
from docquarry.llm.shared import table
from tests.oracle import DATA


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                p[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints_equal_brute_force():
    values = [None, "", "one", "two words", "a b c", "A B C", "x " * 2000, "é\x0bü\x85 z  q", "w " * 255 + "v"]
    assert [int(x) & (2**64 - 1) for x in simhash.packed(simhash.sketch(values, 3))[:, 0]] == [plain(v) for v in values]


def test_shingle_hash_is_that_of_the_engine(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b ü"))).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("a b ü".encode(), simhash.SEED)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not m & diff for m in masks)


@pytest.mark.parametrize("pairwise", [1, 64])
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_join_all_within_the_radius(spark, monkeypatch, pairwise, radius):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(25)})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    hung = graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius)).collect()
    root = {r.a: r.b for r in hung}
    got = [root.get(v, v) for v in signed]
    want = roots(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= radius)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(got)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(8, 40)] + [(7, 7), (3, 2), (2, 3)]
    got = {(r.a, r.b) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(101, 131)} | {(k, 7) for k in range(8, 40)} | {(3, 2)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_equal_brute_force(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    rows = docs.orderBy("doc_id").collect()
    fps = [plain(r.text) for r in rows]
    want = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = simhash.near_groups(docs).orderBy("doc_id").collect()
    assert [(r.fingerprint, r.component_id) for r in got] == [(f"{f:016x}", rows[w].doc_id) for f, w in zip(fps, want, strict=True)]


def test_odd_tables(spark):
    rows = [(5, None), (4, ""), (9, " "), (None, "alone with a null id"), (3, "twice here"), (3, "twice here"), (None, "twice here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in simhash.near_groups(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (4, 4), (5, 4), (9, 4)]
    assert simhash.near_groups(df.limit(0)).count() == 0
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [(-1, "alone with a null id"), (3, "twice here"), (4, "")]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingles(t, 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(800)]
    base = [rng.choices(words, k=rng.randint(60, 400)) for _ in range(60)]
    rows, copies = [], []
    for i, ws in enumerate(base):
        rows.append((i, " ".join(ws)))
    for i, ws in enumerate(base[:40]):
        new = list(ws)
        for _ in range(max(1, len(ws) // 70)):
            new[rng.randrange(len(new))] = rng.choice(words)
        rows.append((1000 + i, " ".join(new)))
        copies.append(1000 + i)
    text = dict(rows)
    sure = [c for c in copies if jaccard(text[c], text[c - 1000]) >= 0.8]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(sure) > 25
    missed = [c for c in sure if c in kept]
    assert len(missed) <= 1 and not [c for c in copies if c not in sure and c not in kept]


def test_a_bucket_of_many_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i] + ["new"] + words[i + 1 :])) for i in range(150)]
    assert [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 400, 3000])
def test_odd_sketches_never_exceed_the_difference(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for other in (x, x[: n * 8 // 9], np.concatenate([x[n // 9 :], rng.integers(0, 2**63, n // 8 + 1).astype(np.uint64)]), rng.integers(0, 2**63, max(1, n * 5 // 4)).astype(np.uint64)):
        y = np.unique(other)
        d = simhash.differing(simhash.odd_sketch(x), simhash.odd_sketch(y))
        assert d <= len(np.setxor1d(x, y)) and d == simhash.differing(simhash.odd_sketch(y), simhash.odd_sketch(x)) and (d or len(x) != len(y) or n < 5 or (x == y).all())


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_prefixes_of_similar_sets_meet(similarity):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 10_000, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - int(rng.integers(0, len(x) // 6 + 1))], rng.integers(0, 10_000, int(rng.integers(0, len(x) // 6 + 1))).astype(np.uint64)]))
        if len(np.intersect1d(x, y)) < similarity * len(np.union1d(x, y)):
            continue
        common = np.unique(rng.integers(0, 10_000, 500).astype(np.uint64))
        (a, la), (b, lb) = (simhash.prefix(z, similarity, simhash.known(z, common, np.arange(len(common)) % 7 + 1)) for z in (x, y))
        met = set(a.tolist()) & set(b.tolist())
        assert any(k in a[:la].tolist() or k in b[:lb].tolist() for k in met)


def grouped(spark, rows, **options):
    got = {r.id0: r.root for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    want = roots(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    return [(got[rows[i][0]] == got[rows[j][0]], want[i] == want[j]) for i in range(len(rows)) for j in range(i)]


def near_pairs(n, seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(800)]
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(80, 200))
        new = list(base)
        for x in rng.sample(range(len(new)), len(new) // 55):
            new[x] = rng.choice(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(new))]
    return rows


def test_pairs_among_strangers_of_the_same_words_are_found(spark):
    # the same passage opens all texts, so each meets each
    passage = " ".join(f"p{i}" for i in range(60))
    pairs = grouped(spark, [(i, f"{passage} {t}") for i, t in near_pairs(40)])
    assert sum(w for _, w in pairs) > 20 and all(g == w for g, w in pairs)


def test_pairs_just_below_the_similarity_stay_apart(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(800)]
    base = [rng.choices(words, k=400) for _ in range(400)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(400 + i, " ".join("changed" if x % 40 == 20 and x < 360 else w for x, w in enumerate(b))) for i, b in enumerate(base)]
    assert all(0.79 < jaccard(rows[i][1], rows[400 + i][1]) < 0.8 for i in range(400))
    # pairs with equal or nearly equal fingerprints
    bits = simhash.sketch([t for _, t in rows], 5, once=True)
    close = sorted(range(400), key=lambda i: (bits[i] != bits[400 + i]).sum())[:40]
    assert not any(g for g, _ in grouped(spark, [rows[j] for i in close for j in (i, 400 + i)]))


def test_equal_fingerprints_are_no_class(spark, monkeypatch):
    majority = simhash.majority
    monkeypatch.setattr(simhash, "majority", lambda h, counts: majority(h, counts) & False)
    assert all(g == w for g, w in grouped(spark, near_pairs(6)))


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize("few", [0, 500_000])
def test_groups_equal_brute_force_whatever_joins_first(spark, monkeypatch, rounds, few):
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "BROADCAST", few)
    monkeypatch.setattr(simhash, "KEYS", few)
    pairs = grouped(spark, near_pairs(30, seed=rounds), radius=0 if rounds else 2)
    assert sum(w for _, w in pairs) > 15 and all(g == w for g, w in pairs)


def test_copies_around_a_text_are_one_group_in_few_rows(spark, monkeypatch):
    """Copies are near the text they come from and not near each other: compared with it, they need no pairs among themselves."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(220)]
    rows = [(0, " ".join(words))]
    for i in range(1, 120):
        new = list(words)
        for x in rng.sample(range(0, 220, 5), 4):
            new[x] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    compared, near = [], simhash._Sets.near
    monkeypatch.setattr(simhash._Sets, "near", lambda self, pairs: (compared.append(pairs.count()), near(self, pairs))[1])
    assert len({r.root for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 1
    assert sum(compared) < (simhash.HUBS + 1) * len(rows)


def test_of_rows_equal_in_id_and_text_the_least_stays(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, s, n) for s, n in (("s2", 1), ("s0", 5), (None, 3), ("s0", 4), ("s1", 1))] + [(2, "other words", "s9", 1)]
    left = {simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(p, "n")).orderBy("doc_id").collect()[0] for p in (1, 2, 3, 5)}
    assert len(left) == 1 and {r.n for r in left} == {4}


def test_all_similar_pairs_of_the_documents(spark):
    """Brute force over all pairs of texts that share a shingle, whatever their fingerprints."""
    docs = table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text").collect()
    sets = {r.doc_id: set(simhash.shingles(r.text, 5)) for r in docs}
    of = {}
    for i, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(i)
    met = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    want = {i: i for i in sets}
    empty = [i for i, s in sets.items() if not s]

    def find(i):
        while want[i] != i:
            i = want[i]
        return i

    for a, b in [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] + [(empty[0], x) for x in empty[1:]]:
        want[max(find(a), find(b))] = min(find(a), find(b))
    roots_ = {}
    for r in simhash.similar_groups(table(spark, f"{DATA}/sf0.01", "documents")).collect():
        roots_.setdefault(r.root, set()).add(r.id0)
    groups = {}
    for i in want:
        groups.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, roots_.values())) == sorted(map(sorted, groups.values()))
