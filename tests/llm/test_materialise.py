import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from docquarry.llm import materialise as m

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_a_permutation_for_every_size_and_key(n):
    for key in (1, 99):
        assert sorted(m.permuted(np.arange(n), n, key)) == list(range(n))
    assert n < 10 or list(m.permuted(np.arange(n), n, 1)) != list(m.permuted(np.arange(n), n, 2))


def docs(spark):
    rows = [(i, f"document {i} " + "some words again " * (i * 37 % 400)) for i in range(60)] + [(None, "null id"), (7, None), (7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")


def test_slots_have_no_gaps_and_hold_all_ids(spark, tmp_path):
    df = docs(spark)
    with open(PATH, "rb") as f:
        enc = m.encoder(f.read(), P.PATTERN)
    n = m.write(df, str(tmp_path / "a"), PATH, P.PATTERN)
    got = m.read(spark, str(tmp_path / "a")).collect()
    assert sorted(r.slot for r in got) == list(range(n)) == list(range(len(got)))
    want = []
    for doc, text in df.collect():
        ids = enc.encode_ordinary(text or "")
        want += [(doc is None, doc or 0, k, hashlib.sha256(np.array(ids[512 * k : 512 * k + 512], "<u4").tobytes()).hexdigest()) for k in range(max(1, -(-len(ids) // 512)))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.part, r.ids_sha256) for r in got) == sorted(want)


def test_reading_resumes_at_any_slot(spark, tmp_path):
    n = m.write(docs(spark), str(tmp_path / "a"), PATH, P.PATTERN)
    every = {r.slot: r.ids_sha256 for r in m.read(spark, str(tmp_path / "a")).collect()}
    for start in (0, 1, n // 2, n - 1, n):
        assert {r.slot: r.ids_sha256 for r in m.read(spark, str(tmp_path / "a"), start).collect()} == {k: v for k, v in every.items() if k >= start}


def plain_slot(number, n, key):
    """The Feistel network on one Python integer."""
    half, mask = ((max(n, 2) - 1).bit_length() + 1) // 2, 2**64 - 1
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for i in range(m.ROUNDS):
            h = (((right + key + i * 0x9E3779B97F4A7C15) & mask) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
            left, right = right, left ^ ((h ^ h >> 31) & ((1 << half) - 1))
        number = left << half | right
        if number < n:
            return number


def test_slots_are_the_permutation_of_the_numbers(spark, tmp_path):
    """Numbers by a plain sort of all rows, slots by a network on one integer at a time."""
    df = docs(spark)
    with open(PATH, "rb") as f:
        enc = m.encoder(f.read(), P.PATTERN)
    rows = []
    for r in df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").selectExpr("*", "pmod(xxhash64(doc_id is not null, coalesce(doc_id, 0), h), 256) lot").collect():
        ids = enc.encode_ordinary(r.text)
        rows.append((r.lot, r.doc_id is not None, r.doc_id or 0, r.h, [ids[i : i + 512] for i in range(0, max(1, len(ids)), 512)]))
    rows.sort(key=lambda r: (*r[:4], len(r[4])))
    every = [(doc if given else None, k, hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for _, given, doc, _, parts in rows for k, x in enumerate(parts)]
    want = {plain_slot(i, len(every), 77): x for i, x in enumerate(every)}
    assert m.write(df, str(tmp_path / "a"), PATH, P.PATTERN, 77) == len(every)
    assert {r.slot: (r.doc_id, r.part, r.ids_sha256) for r in m.read(spark, str(tmp_path / "a")).collect()} == want


def test_the_order_follows_the_rows_and_the_key_only(spark, tmp_path):
    order = []
    docs(spark).repartition(9).write.parquet(str(tmp_path / "many"))
    for k, (key, size, parts) in enumerate([(5, "128m", "4"), (5, "2k", "7"), (5, "2k", "1"), (6, "2k", "4")]):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.read.parquet(str(tmp_path / "many"))
        m.write(df.repartition(3) if k == 2 else df, str(tmp_path / str(k)), PATH, P.PATTERN, key)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        order.append([(r.doc_id, r.part, r.ids_sha256) for r in m.read(spark, str(tmp_path / str(k))).orderBy("slot").collect()])
    assert order[0] == order[1] == order[2] != order[3] and sorted(map(str, order[0])) == sorted(map(str, order[3]))


def test_equal_rows_clashing_names_and_a_very_long_text(spark, tmp_path):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(7, "same " * 700, 1, "h")] * 40 + [(None, None, 2, "x")] * 30 + [(8, long, 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, h string").repartition(5)
    got = m.materialised(df, PATH, P.PATTERN, path=str(tmp_path / "a")).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    same = [r for r in got if r.doc_id == 7]
    assert len({(r.part, r.ids_sha256) for r in same}) * 40 == len(same) and sum(r.doc_id is None for r in got) == 30
    with open(PATH, "rb") as f:
        ids = m.encoder(f.read(), P.PATTERN).encode_ordinary(long)
    parts = {r.part: r.ids_sha256 for r in got if r.doc_id == 8}
    assert parts == {k: hashlib.sha256(np.array(ids[512 * k : 512 * k + 512], "<u4").tobytes()).hexdigest() for k in range(-(-len(ids) // 512))}


def test_records_lie_where_the_manifest_says(spark, tmp_path):
    n = m.write(docs(spark), str(tmp_path / "a"), PATH, P.PATTERN)
    each = spark.read.parquet(str(tmp_path / "a" / "manifest")).first().each
    assert sum(f.stat().st_size - m.HEADER_BYTES - 1 for f in (tmp_path / "a" / "shards").glob("range=*/part-*")) == n * m.STRIDE
    for r in m.read(spark, str(tmp_path / "a")).collect():
        number, k = map(int, r.shard.split("-"))
        assert number == r.slot // each and r.byte_offset == m.HEADER_BYTES + m.STRIDE * (r.slot % each - k * m.PER_SHARD)


def test_empty_table(spark, tmp_path):
    assert m.materialised(docs(spark).limit(0), PATH, P.PATTERN, path=str(tmp_path / "e")).count() == 0


def test_a_broken_shard_is_refused():
    with pytest.raises(ValueError):
        m.records(b"x" * 200, 1)
