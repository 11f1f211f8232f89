import zlib

import pytest

from docquarry.llm import sharding


def docs(spark, n=400):
    return spark.createDataFrame([(i, "é" * (i * 7919 % 300)) for i in range(n)], "doc_id long, text string")


def test_shards_are_even_and_places_gapless(spark, tmp_path):
    got = sharding.sharded(docs(spark), path=str(tmp_path / "m")).collect()
    by = {s: [r for r in got if r.shard == s] for s in range(8)}
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) < 600 and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    for r in got:
        text = ("é" * (r.doc_id * 7919 % 300)).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)


def test_the_edited_map_moves_rows_into_the_new_shard_only(spark, tmp_path):
    got = sharding.sharded(docs(spark), path=str(tmp_path / "m")).collect()
    assert {r.moved_shard for r in got if r.moved_shard != r.shard} == {8}
    first, second = (sharding.load_map(spark, str(tmp_path / "m"), v).collect() for v in (1, 2))
    assert len(first) == len(second) == sharding.SLOTS and sharding.load_map(spark, str(tmp_path / "m")).where("shard = 8").count() > 0


def test_a_slot_stays_with_its_id(spark):
    a = {(r.doc_id, r.vslot) for r in sharding.digests(docs(spark)).collect()}
    assert a == {(r.doc_id, r.vslot) for r in sharding.digests(docs(spark).repartition(7)).collect()}


def test_rebalancing_only_moves_from_above_the_mean():
    sizes = {k: 10 for k in range(100)}
    now = [0] * 70 + [1] * 20 + [2] * 10
    new = sharding.rebalanced(now, sizes, 3)
    have = [sum(new[k] == s for k in sizes) for s in range(3)]
    assert max(have) - min(have) <= 2 and all(a == 0 for a, b in zip(now, new, strict=True) if a != b)
    assert sharding.rebalanced(new, sizes, 3) == new


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "same")] * 500 + [(2, "x"), (2, ""), (None, "y"), (None, "y")], [(None, None)] * 500, [(1, "same")] * 5000 + [(i, "other") for i in range(100)], [(7, "long " * 400_000), (8, "long " * 400_000)]])
def test_odd_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(df, path=str(tmp_path / "m")).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(t or "") + 1) for i, t in rows)
    for s in {r.shard for r in got}:
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    have = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    if len(rows) >= 500:
        assert max(have) - min(have) <= 2 * max(r.size for r in got)


def test_slots_equal_a_plain_count(spark, tmp_path):
    """Slots by Spark's own hash of one row at a time; the map and the places by plain loops."""
    rows = [(i, "é" * (i * 31 % 50)) for i in range(200)] + [(5, "twice")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = [r.h for r in df.selectExpr("xxhash64(doc_id, coalesce(text, '')) h").collect()]
    seen, keys = {}, []
    for h in hashes:
        keys.append((h, seen.get(h, 0)))
        seen[h] = seen.get(h, 0) + 1
    again = {(r.h, r.copy): r.x for r in spark.createDataFrame(keys, "h long, copy long").selectExpr("h", "copy", "xxhash64(h, copy) x").collect()}
    vslots = [(h if not c else again[h, c]) % sharding.SLOTS for h, c in keys]
    size = [len((t or "").encode()) + 1 for _, t in rows]
    held = {}
    for v, n in zip(vslots, size, strict=True):
        held[v] = held.get(v, 0) + n
    of, have = {}, [0] * 8
    for v in sorted(held, key=lambda k: (-held[k], k)):
        of[v] = have.index(min(have))
        have[of[v]] += held[v]
    want = sorted((i is not None, i or 0, n, v, of[v]) for (i, _), n, v in zip(rows, size, vslots, strict=True))
    got = sharding.sharded(df, path=str(tmp_path / "m")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.vslot, r.shard) for r in got) == want
