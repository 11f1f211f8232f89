import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import digest
from docquarry.llm.shared import table
from tests.oracle import DATA


def texts(n=40, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.choice([3, 20, 80, 400, 2500]))) for _ in range(n)]


def plain_windows(text):
    data = (text or "").encode()
    led = (bytes(digest.LEAD) + data).ljust(digest.WIDTH, b"\0")
    return [led[i : i + digest.WIDTH] for i in range(len(led) - digest.WIDTH + 1)] if data else []


def plain_pairs(window):
    return sum(window[i] == window[j] for i in range(len(window)) for j in range(i))


def plain_hash(window):
    h, mask = 0x51ED270B, 2**64 - 1
    for k in range(0, digest.WIDTH, 8):
        h = ((h ^ int.from_bytes(window[k : k + 8], "little")) * 0x9E3779B97F4A7C15) & mask
        h ^= h >> 29
    h = (h * 0xBF58476D1CE4E5B9) & mask
    return h ^ (h >> 32)


def plain_features(text, rank):
    windows = plain_windows(text)
    places = [rank[plain_pairs(w)] for w in windows]
    named = {min(range(max(0, end + 1 - digest.NEAR), end + 1), key=lambda i: (places[i], i)) for end in range(len(windows))}
    return [plain_hash(w) for w in dict.fromkeys(windows[i] for i in sorted(named))]


def plain_chain(hashes):
    out = []
    for k in range(0, len(hashes), digest.FULL):
        some = hashes[k : k + digest.FULL]
        out.append(({(h >> 11 * i) % digest.BITS for h in some for i in range(digest.HASHES)}, len(some)))
    return out


def plain_likeness(a, b):
    if a and a == b:
        return 1.0
    short, other = sorted((a, b), key=lambda c: (len(c), sum(n for _, n in c)))
    if not short:
        return float(not other)
    total = 0
    for bits, n in short:
        best = 0
        for others, _ in other:
            mean = len(bits) * len(others) / digest.BITS
            chance = mean + 1.5 * mean**0.5
            best = max(best, min(1, max(0, (len(bits & others) - chance) / max(min(len(bits), len(others)) - chance, 1e-9))))
        total += n * best
    return total / sum(n for _, n in short)


def test_features_filters_and_likeness_equal_plain_loops():
    own = [*texts(12)[:8], "", None, "a", "ab", "short text", "é" * 30, "a" * 900, "buy now " * 70, texts(3)[1][:60]]
    own += [digest.edited(t or "", own[0]) for t in own]
    counts = [0] * (digest.PAIRS + 1)
    for t in own:
        for w in plain_windows(t):
            counts[plain_pairs(w)] += 1
    assert digest.census(own).tolist() == counts
    rank = digest.ranks(np.array(counts))
    assert [i for i, _ in sorted(enumerate(rank), key=lambda x: x[1])] == sorted(range(len(counts)), key=lambda i: (i >= digest.LOW, counts[i], i))
    hashes, owner = digest.features(own, rank)
    want = [plain_features(t, rank) for t in own]
    assert [hashes[owner == i].tolist() for i in range(len(own))] == want
    got, plain = digest.chains(own, rank), [plain_chain(h) for h in want]
    for c, p in zip(got, plain, strict=True):
        assert [(set(np.flatnonzero(np.unpackbits(f)).tolist()), n) for f, n in zip(*c, strict=True)] == p
    for i in range(len(own)):
        for j in range(i + 1):
            assert abs(digest.likeness(got[i], got[j]) - plain_likeness(plain[i], plain[j])) < 1e-9


def test_windows_of_many_blocks_equal_one(monkeypatch):
    own = [*texts(20), "é" * 3000]
    rank = digest.ranks(digest.census(own))
    want = digest.features(own, rank)
    monkeypatch.setattr(digest, "_BLOCK", 100)
    assert all((a == b).all() for a, b in zip(want, digest.features(own, rank), strict=True))


def test_likeness_of_copies_edits_and_strangers():
    own = texts()
    rank = digest.ranks(digest.census(own))
    chains = digest.chains(own, rank)
    assert [digest.printed(c) for c in digest.chains(own[::-1], rank)][::-1] == [digest.printed(c) for c in chains]
    assert all(digest.likeness(c, digest.read(digest.printed(c))) == 1.0 for c in chains)
    changed = digest.chains([digest.edited(t, own[0]) for t in own], rank)
    near = [digest.likeness(a, b) for a, b, t in zip(chains, changed, own, strict=True) if t != own[0]]
    far = [digest.likeness(a, b) for i, a in enumerate(chains) for b in chains[:i]]
    assert min(near) > 0.45 and np.mean(near) > 0.65 and np.mean(far) < 0.02 and np.quantile(far, 0.99) < 0.2


def test_compared_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(30))] + [(100, None), (101, ""), (102, "ab"), (None, "null id first"), (50, "same"), (50, "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = digest.compared(df).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: r[:2])
    want = [(t, hashlib.sha256(digest.edited(t, ordered[(k + 1) % len(ordered)][2]).encode()).hexdigest()) for k, (_, _, t) in enumerate(ordered)]
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted((len(t), h) for t, h in want)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {"0"}
    same = [r for r in got if r.doc_id == 50]
    assert same[0].fingerprint == same[1].fingerprint and max(r.near_next for r in same) == 1.0


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a single row of text")], "doc_id long, text string")
    assert digest.compared(df).first().near_next == 1.0
    assert digest.compared(df.limit(0)).count() == 0


def test_repeated_texts_have_features():
    own = ["a" * 1000, "=" * 1000, "ab" * 400, "buy now " * 80, "ha " * 300, "x", "é"]
    rank = digest.ranks(digest.census([*own, *texts()]))
    chains = digest.chains(own, rank)
    assert all(digest.printed(c) != "0" for c in chains)
    assert max(digest.likeness(a, b) for i, a in enumerate(chains) for b in chains[:i]) < 0.1
    cut = digest.chains([t[: len(t) * 3 // 4] for t in own[:5]], rank)
    assert all(digest.likeness(a, b) == 1 for a, b in zip(chains, cut, strict=False))


def test_filters_find_partners_at_any_place():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    whole = " ".join(rng.choices(words, k=170_000))
    rank = digest.ranks(digest.census([whole]))
    whole, start = digest.chains([whole, whole[: len(whole) // 4]], rank)
    assert len(start[0]) > 20 and digest.likeness(start, whole) > 0.95


def test_likeness_at_every_length():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    whole = " ".join(rng.choices(words, k=4000))
    rank = digest.ranks(digest.census([whole]))
    for a, b in ((500, 520), (505, 515), (31, 32), (470, 526), (500, 682), (24, 32), (300, 2000), (12, 16), (100, 20_000), (1000, 20_000)):
        x, y = digest.chains([whole[:a], whole[:b]], rank)
        assert digest.likeness(x, y) > 0.6 and digest.likeness(y, x) == digest.likeness(x, y), (a, b)
        assert digest.likeness(x, digest.read(digest.printed(y))) == digest.likeness(x, y)
    x, y = digest.chains([whole[:500], whole[:520]], rank)
    assert digest.likeness(x, y) > 0.8


def test_documents_are_near_their_edited_texts(spark):
    """At all lengths, doc 973 with an edited text of under 512 characters included."""
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    got = digest.compared(docs).select("doc_id", "n_chars", "near_edited", "near_next").collect()
    assert len(got) == docs.count() and next(r.near_edited for r in got if r.doc_id == 973) > 0.5
    assert min(r.near_edited for r in got if r.n_chars >= 40) > 0.4 and np.quantile([r.near_next for r in got], 0.95) < 0.1


def test_hot_ids_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(digest, "ROWS", 10)
    rows = [(None, f"null {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(50)] + [(i, f"text {i}") for i in range(20)] + [(7, "same")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seq = digest.in_sequence(df)
    assert seq.select(F.spark_partition_id().alias("p"), "bucket").distinct().count() > 10
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = sorted((i is not None, i or 0, len(t), hashlib.sha256(digest.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in digest.compared(df).collect()) == want


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "many words of one long text " * 100_000), (2, "é" * 2_000_000), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in digest.compared(df).collect()}
    assert got[1].n_chars == 2_800_000 and got[1].near_edited > 0.5 and got[3].near_next == 0
