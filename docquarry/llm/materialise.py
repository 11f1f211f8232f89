"""Training-order materialisation: every token sequence at the slot that a keyed permutation gives it, in shards of fixed stride.

Every text is encoded once, into a table in the shared folder. It is cut into sequences of LENGTH ids, the last one padded
when it is written; a text without ids gives one empty sequence. Sequences are numbered from 0 to M-1 by the data alone:
by a hash of the document's id and text, by both, by the copy's number among equal rows, and by the place in the text. A
keyed Feistel network permutes the smallest power of four from M numbers on, and a number that leaves 0..M-1 is sent
through again until it is back (cycle-walking). What comes out is the sequence's global slot. So the order depends on
the rows and the key only, not on files, splits or settings, and slots have no gaps.

Equal ranges of slots are dealt to tasks by number; ids are shuffled packed and without padding, and in WAVES of ranges, each
of which reads the table again and whose shuffle files go before the next, so that they need little disk. A task sorts its sequences by slot
and writes them to shards of PER_SHARD records of STRIDE bytes after a header, through Spark's text writer (a newline ends
the file), to any store that Spark writes to. All ranges but the last are full, so where a slot lies follows by
arithmetic from one row of the manifest, and a reader that resumes at a slot opens the ranges from there on only.

Null texts count as empty, null ids are kept, repeated rows are rows of their own (which of them has which number doesn't
show), an empty table gives no shards, and a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import arrow_batches, delete, release, scratch, written

LENGTH, PER_SHARD, ROUNDS = 512, 8192, 4
#: A record: whether the document's id is given, the id, the sequence's number in the document, its ids in use, all ids.
RECORD = np.dtype([("given", "<u2"), ("used", "<u2"), ("part", "<u4"), ("doc", "<i8"), ("ids", "<u2", LENGTH)])
STRIDE = RECORD.itemsize
#: Records of a range at least, if there are so many, and rows that are numbered together at most on average.
RANGE, LOT = 16 * PER_SHARD, 500_000
#: Waves in which ranges are written.
WAVES = 6
#: Buckets that Spark allows a table.
MOST_BUCKETS = 100_000
#: Bytes of a record before its ids; in a shuffle only the packed ids in use follow.
FRONT = RECORD.fields["ids"][1]
#: Of a shard: magic, range, index of its first record in the range, records, stride.
HEADER = ">8sQQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"TOKSHRD1"


def _round(x: np.ndarray, key: int, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x + np.uint64((key + i * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n under a key: a Feistel network of ROUNDS rounds, with cycle-walking."""
    half = ((max(n, 2) - 1).bit_length() + 1) // 2
    mask = np.uint64((1 << half) - 1)
    x = np.asarray(numbers, dtype=np.uint64).copy()
    out = np.ones(len(x), dtype=bool)
    while out.any():
        left, right = x[out] >> np.uint64(half), x[out] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, i) & mask)
        x[out] = left << np.uint64(half) | right
        out &= x >= n
    return x.astype(np.int64)


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


_encoders: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The worker's encoder of a rank file; it stays for further tasks."""
    key = hashlib.sha1(ranks).hexdigest(), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _encoder(ranks, pattern)
    return _encoders[key]


def encoded(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """df: doc, text. Per row: given, doc, h (hash of the text), n (sequences), size (ids), parts (each sequence's ids as
    unsigned 16-bit integers, in a zstd frame), task and nth, the row's number among those of its task equal in doc, h and n."""
    spark: SparkSession = df.sparkSession
    arrow_batches(spark)
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        enc, task, seen = encoder(sent.value, pattern), TaskContext.get().partitionId(), {}
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            given, docs, hashes, texts = (c.to_pylist() for c in b.columns)
            ids = [enc.encode_to_numpy(t, disallowed_special=()) for t in texts]
            if any(len(x) and x.max() > 65535 for x in ids):
                raise ValueError("ids must be below 65536")
            n = [max(1, -(-len(x) // LENGTH)) for x in ids]
            nth = []
            for k in zip(given, docs, hashes, n, strict=True):
                nth.append(seen.get(k, 0))
                seen[k] = nth[-1] + 1
            parts = [[pack(y[i : i + 2 * LENGTH]) for i in range(0, max(1, len(y)), 2 * LENGTH)] for y in (x.astype("<u2").tobytes() for x in ids)]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array(parts, pa.list_(pa.binary())), pa.array([task] * len(n), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["given", "doc", "h", "n", "size", "parts", "task", "nth"])

    own = df.select(F.col("doc").isNotNull().alias("given"), F.coalesce("doc", F.lit(0).cast("long")).alias("doc"), F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(run, "given boolean, doc long, h long, n int, size long, parts array<binary>, task int, nth long")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Of rows of encoded(): given, doc, h, n, task and start, the number of the first sequence of the first such row of the
    task, for all that differ in these; and the number of all sequences.

    Equal rows are counted by task and numbered from these counts, so a group of any size stays spread. Of each lot only
    its sequences are summed on the driver; there is one lot for LOT rows or so."""
    key = ["given", "doc", "h", "n"]
    lots = 1 << max(8, (rows.select("n").count() // LOT).bit_length())
    lot = F.pmod(F.xxhash64("given", "doc", "h"), F.lit(lots)).cast("int").alias("lot")
    counted = rows.groupBy(*key, "task").agg(F.count(F.lit(1)).alias("copies")).select("*", lot)
    before = Window.partitionBy("lot").orderBy(*key, "task").rowsBetween(Window.unboundedPreceding, -1)
    counted = written(counted.withColumn("at", F.coalesce(F.sum(F.col("copies") * F.col("n")).over(before), F.lit(0))), "counted")
    held = {r.lot: r.n for r in counted.groupBy("lot").agg(F.sum(F.col("copies") * F.col("n")).alias("n")).collect()}
    offsets = np.cumsum([0, *(held.get(k, 0) for k in range(lots))])
    begun = rows.sparkSession.createDataFrame([(k, int(offsets[k])) for k in range(lots)], "lot int, begin long")
    return counted.join(F.broadcast(begun), "lot").select(*key, "task", (F.col("begin") + F.col("at")).alias("start")), int(offsets[-1])


def write(df: DataFrame, path: str, ranks_path: str, pattern: str, key: int = 20240607, *, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the shards of df's texts to the folder `path`; returns the number of sequences. Ids must be below 65536."""
    spark: SparkSession = df.sparkSession
    own = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # bucketed by the task that wrote it, each task's rows stay in its one file, and their numbers come to them
    name, place = f"docquarry_{uuid.uuid4().hex}", scratch(spark, "encoded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded(own, ranks_path, pattern).write.bucketBy(min(parts, MOST_BUCKETS), "task").format("parquet").option("path", place).saveAsTable(name)
    together = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(together)
    try:
        spark.conf.set(together, "false")  # the task alone says where its rows are
        return _packed(spark.table(name), path, key, parts)
    finally:
        spark.conf.set(together, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, place)


def _packed(rows: DataFrame, path: str, key: int, parts: int) -> int:
    """Number the rows of encoded(), permute their sequences and write the shards."""
    spark = rows.sparkSession
    starts, total = numbered(rows)
    rows = rows.join(starts.hint("shuffle_hash"), ["task", "given", "doc", "h", "n"]).select("given", "doc", "n", "size", "parts", (F.col("start") + F.col("nth") * F.col("n")).alias("first"))
    parts = max(parts, -(-total // RANGE))
    each = max(1, -(-total // parts))

    def cut(low: int, high: int):
        """The sequences in the ranges from low to high."""

        def run(batches):
            for b in batches:
                given, docs, n, size, first = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                slots = permuted(np.repeat(first, n) + part, total, key)
                here = (slots >= low * each) & (slots < high * each)
                front = np.zeros(len(part), dtype=[(c, RECORD[c]) for c in ("given", "used", "part", "doc")])
                front["given"], front["doc"], front["part"] = np.repeat(given, n), np.repeat(docs, n), part
                front["used"] = np.clip(np.repeat(size, n) - LENGTH * part, 0, LENGTH)
                heads = front[here].tobytes()
                packed = b.column(4).flatten().filter(pa.array(here)).to_pylist()
                data = [heads[FRONT * k : FRONT * (k + 1)] + x for k, x in enumerate(packed)]
                yield pa.RecordBatch.from_arrays([pa.array(slots[here]), pa.array(data, pa.binary())], names=["slot", "data"])

        return run

    def pack(low: int):
        """Shards of the range that a task has, the first of which is low."""

        def run(batches):
            held, done, number = [], 0, low + TaskContext.get().partitionId()
            unpack = zstandard.ZstdDecompressor().decompress
            for b in batches:
                for slot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if slot != number * each + done + len(held):
                        raise RuntimeError("a slot is missing or taken twice")
                    held.append((data[:FRONT] + unpack(data[FRONT:])).ljust(STRIDE, b"\0"))
                    if len(held) == PER_SHARD:
                        yield shard(number, done, held)
                        held, done = [], done + PER_SHARD
            if held:
                yield shard(number, done, held)

        return run

    def shard(number: int, first: int, held: list) -> pa.RecordBatch:
        head = struct.pack(HEADER, MAGIC, number, first, len(held), STRIDE)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([b"".join([head, *held])], pa.binary())], names=["range", "value"])

    for low, high in itertools.pairwise([parts * i // WAVES for i in range(WAVES + 1)]):
        if low == high:
            continue
        placed = rows.mapInArrow(cut(low, high), "slot long, data binary")
        dealt = placed.repartitionById(high - low, F.floor(F.col("slot") / each).cast("int") - low).sortWithinPartitions("slot")
        files = dealt.mapInArrow(pack(low), "range int, value binary").select("range", F.col("value").cast("string").alias("value"))
        files.write.mode("append").partitionBy("range").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{path}/shards")
        release(spark)
    spark.createDataFrame([(total, each, PER_SHARD, STRIDE)], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return total


#: The manifest: sequences, slots of a range, records of a shard, bytes of a record.
MANIFEST = "total long, each long, per_shard int, stride int"


def records(data: bytes, each: int, start: int = 0) -> tuple[int, int, np.ndarray]:
    """Of a shard in ranges of `each` slots: the slot of its first record from slot `start` on, that record's byte offset,
    and the records from there."""
    if len(data) < HEADER_BYTES:
        raise ValueError("not a whole shard")
    magic, number, index, n, stride = struct.unpack_from(HEADER, data)
    if magic != MAGIC or stride != STRIDE or len(data) < HEADER_BYTES + n * stride:
        raise ValueError("not a whole shard")
    slot = number * each + index
    skip = min(n, max(0, start - slot))
    return slot + skip, HEADER_BYTES + skip * stride, np.frombuffer(data, dtype=RECORD, count=n - skip, offset=HEADER_BYTES + skip * stride)


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """The sequences of the shards in a folder from slot `start` on: slot, shard (its range and number in it), byte_offset,
    doc_id, part, n_tokens, ids_sha256 (of the ids in use as little-endian unsigned 32-bit integers)."""
    arrow_batches(spark, rows=1)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
    each = manifest.each

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer().to_pybytes()
                slot, offset, got = records(data, each, start)
                _, number, index, _, _ = struct.unpack_from(HEADER, data)
                slots = slot + np.arange(len(got))
                sums = [hashlib.sha256(r["ids"][: r["used"]].astype("<u4").tobytes()).hexdigest() for r in got]
                docs = pa.array(got["doc"], pa.int64(), mask=got["given"] == 0)
                cols = [pa.array(slots), pa.array([f"{number}-{index // PER_SHARD}"] * len(got), pa.string()), pa.array(offset + STRIDE * np.arange(len(got))), docs, pa.array(got["part"].astype(np.int64)), pa.array(got["used"].astype(np.int32)), pa.array(sums, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids_sha256"])

    schema = "slot long, shard string, byte_offset long, doc_id long, part long, n_tokens int, ids_sha256 string"
    if start >= manifest.total:
        return spark.createDataFrame([], schema)
    # a column of the folders' names, so ranges before the start are not opened
    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("range") >= start // each)
    return files.select("content").mapInArrow(run, schema)


def materialised(df: DataFrame, ranks_path: str, pattern: str, key: int = 20240607, path: str | None = None, **columns: str) -> DataFrame:
    """Write df's sequences in training order and read them back. An empty table gives no shards and no rows."""
    path = path or scratch(df.sparkSession, "shards")
    write(df, path, ranks_path, pattern, key, **columns)
    return read(df.sparkSession, path)
