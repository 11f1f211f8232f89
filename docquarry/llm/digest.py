"""Improbable-feature digests: rare byte windows in chained Bloom filters.

One rule holds for texts of every length. LEAD zero bytes are put before a text (and zeros after one that is still
shorter than a window), so that its first few bytes have windows of their own. A window of WIDTH bytes starts at every
byte. A window's entropy is the collision entropy of its bytes, -log2 of the chance that two places hold the same byte,
and follows from its count of equal pairs. How often each count comes is summed over all windows of all documents; a
window is the rarer, the rarer its count. Windows of very low entropy (runs of few characters) rank last, so they are
named only among their like. Each window names the rarest of the NEAR windows up to and with itself (of fewer at a text's
start), so what a text's start names doesn't depend on what follows. The windows named are the features, equal ones once.

Features fill Bloom filters of BITS bits with HASHES bits each, FULL different features a filter; the chain of filters is
the fingerprint. Two filters' likeness is their common bits, less what chance explains, against the most they could
share; each filter of the shorter chain counts, by its features, with its best partner among all of the other.

Null texts count as empty, and empty texts alone have the fingerprint "0". Equal fingerprints have likeness 1, and "0" has
likeness 0 to others. Repeated texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import arrow_batches

WIDTH, LEAD, NEAR = 16, 12, 64
BITS, HASHES, FULL = 2048, 5, 160
#: Equal pairs of a window: all of them, and from how many on its entropy is very low (under 2 bits).
PAIRS = WIDTH * (WIDTH - 1) // 2
LOW = (WIDTH * WIDTH // 4 - WIDTH) // 2
#: Rows and bytes that a range of ids has about; a single id with more rows is cut by the texts' hashes.
ROWS, BYTES = 50_000, 128 << 20
_BLOCK = 1 << 15

Chain = tuple[np.ndarray, np.ndarray]


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """Pairs of equal bytes in the window at each byte.

    From one window to the next the pairs of the first byte go and those of the new one come; in blocks."""
    out = np.zeros(max(0, len(data) - WIDTH + 1), dtype=np.int32)
    for b in range(0, len(out), _BLOCK):
        x = data[b : b + _BLOCK + WIDTH - 1]
        ahead, behind = np.zeros(len(x), dtype=np.uint8), np.zeros(len(x), dtype=np.uint8)
        for d in range(1, WIDTH):
            same = (x[d:] == x[:-d]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        out[b] = behind[:WIDTH].sum(dtype=np.int32)
        out[b + 1 : b + _BLOCK] = out[b] + np.cumsum(behind[WIDTH:].astype(np.int32) - ahead[: len(x) - WIDTH])
    return out


def _windows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts that have any, each led and filled up; where windows start in them, and the text of each window."""
    raw = [(t or "").encode() for t in texts]
    own = [i for i, r in enumerate(raw) if r]
    led = [np.frombuffer((bytes(LEAD) + raw[i]).ljust(WIDTH, b"\0"), dtype=np.uint8) for i in own]
    n = np.array([len(x) - WIDTH + 1 for x in led], dtype=np.int64)
    first = np.cumsum([0, *(len(x) for x in led[:-1])]) if led else np.zeros(0, np.int64)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.concatenate([np.zeros(0, np.uint8), *led]), at, np.repeat(np.array(own, dtype=np.int64), n)


def census(texts: list) -> np.ndarray:
    """How many windows of the texts have each count of equal pairs."""
    data, at, _ = _windows(texts)
    return np.bincount(equal_pairs(data)[at], minlength=PAIRS + 1)


def named(place: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The windows that are the rarest (the first of equals) of the NEAR up to some window of their text. place: each
    window's rank, of: its text, in order. In blocks."""
    gap, none = NEAR - 1, 1 << 30
    if not len(of):
        return of
    texts = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
    spot = np.arange(len(place)) + gap * (texts + 1)
    wide = np.full(int(spot[-1]) + 1, none, dtype=np.int64)
    wide[spot] = place
    rarest = np.zeros(len(wide), dtype=bool)
    for b in range(0, len(wide) - gap, _BLOCK):
        row = wide[b : b + _BLOCK + gap]
        least = (row << 32) + np.arange(len(row))
        w = 1
        while w < NEAR:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        rarest[b + (least[row[gap:] < none] & (2**32 - 1))] = True
    return np.flatnonzero(rarest[spot])


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each count of equal pairs, the rarest first; those of low entropy last."""
    order = np.lexsort((np.arange(PAIRS + 1), counts, np.arange(PAIRS + 1) >= LOW))
    out = np.empty(PAIRS + 1, dtype=np.int64)
    out[order] = np.arange(PAIRS + 1)
    return out


def _hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each start."""
    rows = np.ascontiguousarray(data[at[:, None] + np.arange(WIDTH)]).view("<u8").reshape(-1, WIDTH // 8)
    h = np.full(len(rows), 0x51ED270B, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for col in rows.T:
            h = (h ^ col) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def features(texts: list, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different features of all texts, in the order of their first places, and the text of each."""
    data, at, of = _windows(texts)
    some = named(rank[equal_pairs(data)[at]], of)
    h, o = _hashed(data, at[some]), of[some]
    order = np.lexsort((h, o))
    new = np.ones(len(some), dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (o[order[1:]] != o[order[:-1]])
    take = np.sort(order[new])
    return h[take], o[take]


def chains(texts: list, rank: np.ndarray) -> list[Chain]:
    """For each text its chain: filters (rows of bytes) and how many features each holds."""
    h, owner = features(texts, rank)
    n = np.bincount(owner, minlength=len(texts))
    within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    filters = (n + FULL - 1) // FULL
    begin = np.cumsum(filters) - filters
    row = begin[owner] + within // FULL
    bits = np.zeros((int(filters.sum()), BITS), dtype=bool)
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = True
    made, held = np.packbits(bits, axis=1), np.bincount(row, minlength=len(bits))
    return [(made[b : b + f], held[b : b + f]) for b, f in zip(begin, filters, strict=True)]


def printed(chain: Chain) -> str:
    """The fingerprint as text: filters, features of the last one, and all bits in base 64."""
    f, held = chain
    return f"{len(f)}:{held[-1]}:{base64.b64encode(f.tobytes()).decode()}" if len(f) else "0"


def read(fingerprint: str) -> Chain:
    """The chain that a fingerprint prints."""
    if fingerprint == "0":
        return np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64)
    n, last, data = fingerprint.split(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), -1), np.array([FULL] * (int(n) - 1) + [int(last)])


def likeness(a: Chain, b: Chain) -> float:
    """Likeness of two chains, 0 to 1."""
    (f, m), (g, n) = (a, b) if (len(a[0]), a[1].sum()) <= (len(b[0]), b[1].sum()) else (b, a)
    if f.shape == g.shape and (f == g).all():
        return 1.0
    if not len(f):
        return 0.0
    f, g = np.ascontiguousarray(f).view("<u8"), np.ascontiguousarray(g).view("<u8")
    size_f, size_g = np.bitwise_count(f).sum(axis=1, dtype=np.int64), np.bitwise_count(g).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(f)):
        common = np.bitwise_count(f[i] & g).sum(axis=1, dtype=np.int64)
        most = np.minimum(size_f[i], size_g)
        mean = size_f[i] * size_g / BITS
        chance = mean + 1.5 * np.sqrt(mean)
        total += m[i] * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return min(1.0, float(total / m.sum()))


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the counts of equal pairs, from all windows of all texts: one row for each count reaches the driver."""
    arrow_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(PAIRS + 1, dtype=np.int64)
        for b in batches:
            total += census(b.column(0).to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["pairs", "n"])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(run, "pairs int, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(PAIRS + 1, dtype=np.int64)
    for r in rows:
        counts[r.pairs] = r.n
    return ranks(counts)


def fingerprints(df: DataFrame, rank: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint."""
    arrow_batches(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([printed(c) for c in chains(b.column(1).to_pylist(), rank)], pa.string())], names=["id", "fingerprint"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def in_sequence(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of the id, each followed by the row that comes next: bucket, late (1 for that row), id, text.

    Order: id (null first), then the text's hash. Ranges come from approximate quantiles of the id and hold about BYTES; an
    id of more than ROWS rows, null included, has ranges of its own, cut by the texts' hashes. Of each range only its first
    key reaches the driver. The row after the last is the first of all. Within a partition rows are sorted."""
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    own = own.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))))
    total = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.bytes // BYTES))
    cuts = own.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    # at most 10,000 places have so many rows
    lot = max(ROWS, total.n // 10_000)
    many = {r.place: -(-r["count"] // lot) for r in own.groupBy("place").count().where(F.col("count") > lot).collect()}
    splits = sorted(({c for c in cuts} | {x for p in many for x in (p, math.nextafter(p, math.inf))}) - {-math.inf, math.inf})
    # a binary search for each row, however many ranges there are
    ranges = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="place", outputCol="range") if splits else None
    own = (ranges.transform(own) if ranges else own.withColumn("range", F.lit(0.0))).withColumn("range", F.col("range").cast("int"))
    slices = spark.createDataFrame([(int(np.searchsorted(splits, p, side="right")), k) for p, k in many.items()], "range int, slices int")
    part = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.coalesce("slices", F.lit(1)))
    own = own.join(F.broadcast(slices), "range", "left").withColumn("slice", F.least(part, F.coalesce("slices", F.lit(1)) - 1).cast("int"))
    key = F.struct(F.col("id").isNotNull().alias("given"), F.col("id"), F.col("h"))
    firsts = sorted((r.range, r.slice, r.k) for r in own.groupBy("range", "slice").agg(F.min(key).alias("k")).collect())
    # the first row of each range also goes to the range before it; one row for each range
    kind = own.schema["id"].dataType.simpleString()
    ahead = spark.createDataFrame([(r, s, i, k.id, k.h, (i - 1) % len(firsts)) for i, (r, s, k) in enumerate(firsts)], f"range int, slice int, bucket int, first_id {kind}, first_h long, before int")
    own = own.join(F.broadcast(ahead), ["range", "slice"])
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    copies = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")), F.when(is_first, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("late")))))
    return own.select(F.explode(copies).alias("x"), "id", "h", "text").select("x.bucket", "x.late", "id", "h", "text").repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "late", "id", "h").select("bucket", "late", "id", "text")


def edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by as many (or all) of the next one's first."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compared(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see edited()).

    Rows with equal ids follow each other by their texts' hashes; a single row is followed by itself."""
    rank = rarity(df, text_col)
    rows = in_sequence(df, id_col=id_col, text_col=text_col)
    arrow_batches(df.sparkSession)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = rows.schema["id"].dataType

    def run(batches):
        last = None
        for b in batches:
            late, ids, texts = (b.column(i).to_pylist() for i in (1, 2, 3))
            seq = ([last] if last else []) + list(zip(late, ids, texts, chains(texts, rank), strict=True))
            last = seq[-1] if seq else last
            pairs = [(x, y) for x, y in zip(seq, seq[1:]) if not x[0]]
            changed = [edited(x[2], y[2]) for x, y in pairs]
            new = chains(changed, rank)
            cols = [[x[1] for x, _ in pairs], [len(x[2]) for x, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [printed(x[3]) for x, _ in pairs], [printed(c) for c in new], [likeness(x[3], c) for (x, _), c in zip(pairs, new, strict=True)], [likeness(x[3], y[3]) for x, y in pairs]]
            types = [b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
