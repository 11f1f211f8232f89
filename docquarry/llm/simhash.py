"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A fingerprint's bit is set if more than half of a text's shingle hashes have it. Pairs are sought in tables: a table's
mask keeps some bits, and two fingerprints meet where the kept bits agree.

Within a small radius r the masks cover every pair: position i gets a non-zero vector m(i) of r + 1 bits, and the mask
of a non-zero vector v keeps the positions with an odd inner product of m(i) and v. The at most r positions in which a
pair differs put at most r linear conditions on v, so some v satisfies them all, and its mask keeps none of them.

Jaccard similarities of 0.8 lie outside such a radius (10 of 64 bits on average, which would take 2047 tables and still
miss half of the pairs). So similar_groups() joins by the covering masks what is within their radius, and then compares,
by a prefix-filter join of the shingle sets, every pair that can be as similar and is not joined yet. No pair is left to
chance, and none is linked without its sets having been compared.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.graph import components
from docquarry.llm.shared import arrow_batches, forget, release, renamed, written

#: Seed of the shingle hash, which is also the seed of Spark's xxhash64.
SEED = 42
#: A bucket up to this size is compared pair by pair, a larger one by way of its members' neighbours.
PAIRWISE = 64
#: Parts that the documents of a fingerprint are dealt to when they get their component.
SALTS = 16
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, k: int) -> list[bytes]:
    """Runs of k words of the text, A-Z lower-cased, joined by spaces; fewer words: all of them; none: none.

    bytes.lower and bytes.split know ASCII only: they split at 20 and 09 to 0D."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits (one row of 64 for each text, lowest bit first) set in over half of a text's hashes; counts: hashes of each text.

    Eight bits of a hash at a time are added as bytes of one integer, over at most 255 hashes."""
    bits = np.zeros((len(counts), 64), dtype=bool)
    full = np.flatnonzero(counts)
    if not len(full):
        return bits
    some = counts[full]
    parts = (some + 254) // 255
    first = np.concatenate(([0], np.cumsum(some)[:-1]))
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + 255 * within
    groups = np.cumsum(parts) - parts
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        set_in = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        bits[full, k::8] = 2 * set_in > some[:, None]
    return bits


def hashed(texts: list, k: int, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles of k words (once: each different one once), and how many each text has."""
    runs = [set(shingles(t, k)) if once else shingles(t, k) for t in texts]
    counts = np.array([len(r) for r in runs], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for r in runs for s in r), dtype=np.uint64, count=int(counts.sum())), counts


def sketch(texts: list, k: int, once: bool = False) -> np.ndarray:
    """Fingerprint bits of each text, 64 a row, over its shingles of k words (once: each different one once)."""
    return majority(*hashed(texts, k, once))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as signed 64-bit integers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def fingerprints(df: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fp, the 64-bit fingerprint as a signed integer (0 for a text without words)."""
    arrow_batches(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(sketch(b.column(1).to_pylist(), k))[:, 0] if b.num_rows else [], pa.int64())], names=["id", "fp"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of 64 bits, as signed integers."""
    n = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - 2**64 if m >> 63 else m for m in masks]


def changes(mask: int, n: int) -> list[int]:
    """Every change of up to n bits outside the mask, as signed integers."""
    free = [i for i in range(64) if not mask >> i & 1]
    found = [sum(1 << i for i in x) for k in range(n + 1) for x in itertools.combinations(free, k)]
    return [x - 2**64 if x >> 63 else x for x in found]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes: fp, all different. Returns a, b: edges that connect every pair of fingerprints with up to `radius` differing bits.

    A bucket of up to PAIRWISE members is compared pair by pair. In a larger one each member names itself and all that
    radius / 2 flips of bits outside the mask make of it: two members differ in at most radius bits just if they name
    the same value, and all who name a value are linked to the smallest of them. That is as many rows as there are
    members, times the names of one, and never all pairs."""
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))
    rows = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = written(rows.join(shared, ["t", "key"]), "buckets")
    few, many = near.where(F.col("n") <= PAIRWISE), near.where(F.col("n") > PAIRWISE)
    pairs = few.select("t", "key", F.col("fp").alias("a")).join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    flips = F.array(*(F.array(*(F.lit(x).cast("long") for x in changes(m, radius // 2))) for m in masks))
    many = many.select("t", "fp", F.explode(F.get(flips, F.col("t"))).alias("flip"))
    named = many.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
    least = named.groupBy("t", "name").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hubs = named.join(least, ["t", "name"]).where(F.col("fp") != F.col("b")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(hubs).distinct()


def near_groups(df: DataFrame, *, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over
    fingerprints with up to `radius` (0, 2 or 4) differing bits, the row's own included.

    Null and empty texts have fingerprint zero, linked like any other. A null id is never a component_id unless its
    component has no other. Repeated rows stay. An empty table gives an empty result."""
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = written(fingerprints(own, k=k, id_col="id"), "simhash")
    nodes = written(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    hung = components(links(nodes.select("fp"), radius))
    members = hung.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(hung.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    members = written(members.join(nodes, "fp").select("fp", "root", "least"), "members")
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(roots, "root").select("fp", "component_id")
    # a fingerprint of one document that is linked to no other needs no join; those of many documents meet in SALTS places
    alone = nodes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    classes = linked.unionByName(alone).withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    rows = docs.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    found = rows.join(classes.withColumn("met", F.lit(True)), ["fp", "salt"], "left")
    return found.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


#: Keys of shingles, and keys of rows, that a broadcast may carry (8 and 24 bytes each).
KEYS, BROADCAST = 100_000, 500_000
#: The share of all shingles, by hash, that are counted in every text; how often one must come to be known as common; and how
#: many are known at most. Common shingles come last in prefixes: the cost depends on it, not the groups.
COUNTED, OFTEN, COMMON = 0.3, 8, 500_000
#: Rounds, at most, in which the texts of keys that CROWD texts or more have are compared with the NEAREST of HUBS of such a
#: key. What is left is compared pair by pair, so groups don't depend on these.
ROUNDS, CROWD, HUBS, NEAREST = 2, 48, 6, 2
#: Hubs may fall behind the first by a thousand times this share in how often their shingles come.
SPREAD = 5e-5


def known(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each hash comes, 0 for those that aren't common. common: in ascending order, with their counts."""
    if not len(common):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, counts[at], 0)


def prefix(hashes: np.ndarray, similarity: float, often: np.ndarray) -> tuple[np.ndarray, int]:
    """The hashes of a set (all different) that come first in the order of how often each comes, and how many of them lead.

    Two sets as similar as asked have at least ceil(similarity * n) hashes in common, n being the size of either. In one
    order of all hashes their first common one is thus among the n - ceil(similarity * n) + 1 first of both, and among
    the n - ceil(2 * similarity / (1 + similarity) * n) + 1 first, which lead, of the smaller set."""
    n = len(hashes)
    if not n:
        return hashes, 0
    least = lambda share: int(np.ceil(share * n - 1e-9))
    return hashes[np.lexsort((hashes, often))][: n - least(similarity) + 1], n - least(2 * similarity / (1 + similarity)) + 1


#: Hashes below this are counted in all texts, those above in texts whose prefix would else reach there.
_COUNTED_BELOW = np.uint64(int(COUNTED * 2**64))


def _common(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes of shingles (h, each text's different ones) those that come often, in ascending order, and how often each does.

    At most COMMON reach the driver: those counted most, by quarters of a power of two."""
    level = F.floor(F.log2("n") * 4).cast("int").alias("level")
    often = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = written(often.select("h", "n", level), "often")
    least, held = None, 0
    for r in sorted(often.groupBy("level").count().collect(), key=lambda r: -r.level):
        held += r["count"]
        if held > COMMON:
            break
        least = r.level
    found = often.where(F.col("level") >= F.lit(least)).select("h", "n").toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _low_hashes(own: DataFrame, k: int) -> DataFrame:
    """h: of all texts the different hashes of shingles that are counted in all."""

    def run(batches):
        for b in batches:
            h, sizes = hashed(b.column(0).to_pylist(), k, once=True)
            sets = [np.unique(x[x < _COUNTED_BELOW]) for x in np.split(h, np.cumsum(sizes)[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    return own.select("text").mapInArrow(run, "h long")


def odd_sketch(hashes: np.ndarray) -> bytes:
    """For a set of n hashes, a power of two of at least n (and 64) bits: each tells whether an odd number of hashes end in its place."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """At least so many elements are in one only of the two sets with these odd sketches: a place that differs has one."""
    (n, v), (m, w) = ((len(z), int.from_bytes(z, "little")) for z in sorted((x, y), key=len))
    while m > n:
        m //= 2
        w = w >> 8 * m ^ w & (1 << 8 * m) - 1
    return (v ^ w).bit_count()


def odd_words(hashes: np.ndarray) -> np.ndarray:
    """odd_sketch() of 512 bits whatever the size of the set, as signed 64-bit integers."""
    return np.packbits(np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1, bitorder="little").view("<i8")


def _across(many: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of different components that shares a key and can be as similar as asked by sizes and odd words.

    many: key, fp, size, leads, root. Of each key the texts outside its largest component meet all others, so members of that
    are never paired with each other, and what cannot be similar is dropped within the join."""
    blocks = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("roots"))
    blocks = blocks.where("roots > 1").select("key", F.col("x.root").alias("major"))
    rows = written(many.join(blocks, "key").join(nodes.select("fp", "words"), "fp").withColumn("major", F.col("root") == F.col("major")), "across")
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("fp", "size", "leads", "root", "major", "words")))
    near = lambda small, large: F.col(small) >= similarity * F.col(large) - 1e-9
    differ = sum((F.bit_count(F.col("words_a")[i].bitwiseXOR(F.col("words_b")[i])) for i in range(8)), F.lit(0))
    fits = F.expr("root_a <> root_b and (major_b or root_a < root_b)") & F.expr("(leads_a or size_a > size_b) and (leads_b or size_b > size_a)")
    fits &= near("size_a", "size_b") & near("size_b", "size_a") & (differ <= F.floor((1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-9))
    a, b = side(rows.where("not major"), "a"), side(rows, "b").withColumnRenamed("key", "key_b")
    return a.join(b, (F.col("key") == F.col("key_b")) & fits).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _label(hung: DataFrame, c: str) -> DataFrame:
    """Roots of components() under the name of the column they are joined to."""
    return hung.select(F.col("a").alias(c), F.col("b").alias(f"{c}_root"))


def _covered(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of fp that connect all whose 64-bit fingerprints differ in up to `radius` bits, by the covering masks."""
    words = written(nodes.groupBy("word").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")), "words")
    same = nodes.join(words.where("n > 1").select("word", "least"), "word").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    least = lambda c, x: words.select(F.col("word").alias(c), F.col("least").alias(x))
    linked = links(words.select(F.col("word").alias("fp")), radius).toDF("u", "v")
    return same.unionByName(linked.join(least("u", "a"), "u").join(least("v", "b"), "v").select("a", "b"))


def _contested(docs: DataFrame) -> DataFrame:
    """key, fp, size, weight and leads of every prefix key that several texts have and that leads in one."""
    rows = docs.select("fp", "size", "weight", "lead", F.posexplode("prefix").alias("at", "key")).select("key", "fp", "size", "weight", (F.col("at") < F.col("lead")).alias("leads"))
    # nearly all keys are of one text only, and go here
    keys = rows.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.max("leads").alias("leads")).where("least <> most and leads").select("key")
    keys = written(keys, "keys")
    return written(rows.join(F.broadcast(keys) if keys.count() <= KEYS else keys, "key").dropDuplicates(["key", "fp"]), "contested")


def _with_hubs(many: DataFrame, hung: DataFrame, similarity: float, i: int) -> DataFrame:
    """Pairs (a, b) of each text with HUBS texts of other components that share a key of CROWD texts or more with it.

    A text takes one such key only: in round 0 the fullest, later that of the least hash. The first hub of a key is the text
    whose shingles come most often on average, to which copies of one text are all near if to any; the others come close to
    it in that, and differ from round to round."""
    rows = many.join(_label(hung, "fp"), "fp", "left").select("key", "fp", "size", "weight", F.coalesce("fp_root", "fp").alias("root"))
    rows = written(rows, "rows")
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("n") >= CROWD) & (F.col("low") != F.col("high")))
    rows = written(rows.join(crowded.select("key", "n"), "key"), "crowded")
    by = [F.col("weight") * (1 + SPREAD * F.pmod(F.xxhash64("fp", F.lit(HUBS * i + j)), F.lit(1000)) * int(i + j > 0)) for j in range(HUBS)]
    hubs = rows.groupBy("key").agg(*(F.max(F.struct(o.alias("by"), "fp", "root", "size")).alias(f"hub{j}") for j, o in enumerate(by)))
    taken = rows.groupBy("fp").agg(F.max(F.struct((F.xxhash64("key", F.lit(i)) if i else F.col("n")).alias("by"), "key", "root", "size")).alias("x")).select("fp", "x.key", "x.root", "x.size")
    near = lambda small, large: small >= similarity * large - 1e-9
    fits = lambda h: (h["root"] != F.col("root")) & near(h["size"], F.col("size")) & near(F.col("size"), h["size"])
    met = taken.join(hubs, "key").select("fp", F.explode(F.filter(F.array(*(f"hub{j}" for j in range(HUBS))), fits)).alias("hub"))
    return met.select(F.col("fp").alias("a"), F.col("hub.fp").alias("b")).distinct()


class _Sets:
    """Compares shingle sets of candidate pairs, by their texts."""

    def __init__(self, nodes: DataFrame, own: DataFrame, k: int, similarity: float):
        self.nodes, self.own, self.k, self.similarity = nodes, own, k, similarity

    def near(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b: fp) whose sizes and odd sketches allow the similarity, with the least number of elements in which they
        differ by their sketches; written. Most pairs that only share a passage end here."""
        most = (1 - self.similarity) / (1 + self.similarity)
        side = lambda c, x: self.nodes.select(F.col("fp").alias(c), F.col("size").alias(f"{c}_size"), F.col("odd").alias(x))
        both = pairs.where("a <> b").distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").where(F.least("a_size", "b_size") >= self.similarity * F.greatest("a_size", "b_size") - 1e-9)

        def run(batches):
            for b in batches:
                sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
                allowed = np.floor(most * sizes + 1e-9)
                found = np.array([differing(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["a", "b", "apart"]).filter(pa.array(found <= allowed))

        return written(both.select("a", "b", "a_size", "b_size", "x", "y").mapInArrow(run, "a long, b long, apart long"), "near")

    def similar(self, pairs: DataFrame, nearest: int | None = None) -> DataFrame:
        """The pairs whose sets are as similar as asked; nearest: of each a only so many b are compared, by the odd sketches (an
        a may have few b then, as it has hubs)."""
        pairs = self.near(pairs)
        if nearest:
            best = F.slice(F.array_sort(F.collect_list(F.struct("apart", "b"))), 1, nearest)
            pairs = pairs.groupBy("a").agg(best.alias("x")).select("a", F.explode("x.b").alias("b"))
        used = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        row = ["is_null", "id0", "text_hash"]
        texts = written(self.nodes.select("fp", *row).join(used, "fp"), "used")
        few = texts.count() <= BROADCAST
        found = self.own.join(F.broadcast(texts) if few else texts, row).select("fp", "text")
        k = self.k

        def run(batches):
            for b in batches:
                sets = [np.unique(hashed([t], k, once=True)[0]).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "set"])

        # of a row that is repeated each task sends one at most
        sets = written(found.mapInArrow(run, "fp long, set array<long>").groupBy("fp").agg(F.first("set").alias("set")), "sets")
        side = lambda c, x: sets.select(F.col("fp").alias(c), F.col("set").alias(x))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = written(both.where(common >= self.similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "similar")
        for t in (texts, sets):
            forget(t.sparkSession, t)
        release(out.sparkSession)
        return out


class Covering:
    """First pairs of similar_groups(): fingerprints within `radius` (0, 2 or 4) differing bits, by the covering masks."""

    #: Columns that the sketch of a text gets for it, and how many of a text's pairs are compared (None: all).
    fields, nearest = {"word": "long"}, None

    def __init__(self, radius: int = 2):
        if radius not in (0, 2, 4):
            raise ValueError("radius must be 0, 2 or 4")
        self.radius = radius

    def columns(self, hashes: np.ndarray, sizes: np.ndarray) -> list:
        """The columns of a batch. hashes: of all its texts' shingles, each text's different ones; sizes: how many each has."""
        return [pa.array(packed(majority(hashes, sizes))[:, 0] if len(sizes) else [], pa.int64())]

    def pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of fp to compare."""
        return _covered(nodes.select("fp", "word"), self.radius)


def _prefixed(docs: DataFrame, similarity: float) -> DataFrame:
    """docs with weight, lead and prefix for the rows that have their whole set (`whole`, null for others): counts of the hashes
    above those counted in all texts are taken among these rows. Others don't reach there, so one order holds for all."""
    rest = docs.where("whole is not null")
    if not rest.head(1):
        return docs.drop("whole")
    common, counts = _common(rest.select(F.explode("whole").alias("h")))

    def run(batches):
        for b in batches:
            sets = [np.array(x, dtype=np.int64).view(np.uint64) for x in b.column("whole").to_pylist()]
            often = [known(x, common, counts) for x in sets]
            first = [prefix(x, similarity, o) for x, o in zip(sets, often, strict=True)]
            new = {"weight": pa.array([float(o.mean()) if len(o) else 0.0 for o in often], pa.float64()), "lead": pa.array([x for _, x in first], pa.int32()), "prefix": pa.array([x.view(np.int64) for x, _ in first], pa.list_(pa.int64()))}
            names = [n for n in b.schema.names if n != "whole"]
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names=names)

    kept = docs.drop("whole")
    return docs.where("whole is null").drop("whole").unionByName(written(rest.mapInArrow(run, kept.schema), "prefixed"))


def linked_sets(df: DataFrame, *, k: int, similarity: float, first, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links between all texts whose sets of k-word shingles have a Jaccard similarity of `similarity` or more.

    Returns docs, one row for each row of df (is_null, id0, text_hash: whether the id is null, the id or -1, the text's
    xxhash64; fp, the hash of the set; size, its elements), and hung: a and b, fp and the smallest fp of its component.

    `first` (see Covering) names the first pairs. Then all texts meet by prefix() of their sets: a pair as similar as asked
    shares a key there. In rounds the texts of keys that many components share are compared with a few of them, which
    joins groups of copies in a few rows for each text. At last every pair that shares a key and is not joined yet is
    compared. Pairs whose sizes or odd sketches rule the similarity out are dropped before, by bounds that lose none;
    each other pair is linked by the sets themselves only."""
    arrow_batches(df.sparkSession)
    key = [F.col(id_col).isNull().alias("is_null"), F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("id0")]
    own = df.select(*key, F.col(text_col).cast("string").alias("text"))
    own = own.select("is_null", "id0", F.xxhash64("text").alias("text_hash"), "text")
    common, counts = _common(_low_hashes(own, k))

    def run(batches):
        for b in batches:
            h, sizes = hashed(b.column(3).to_pylist(), k, once=True)
            sets = [np.unique(x) for x in np.split(h, np.cumsum(sizes)[:-1])] if b.num_rows else []
            often = [known(x, common, counts) for x in sets]
            start = [prefix(x, similarity, o) for x, o in zip(sets, often, strict=True)]
            whole = [x.view(np.int64) if len(p) and p.max() >= _COUNTED_BELOW else None for x, (p, _) in zip(sets, start, strict=True)]
            cols = [pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], pa.uint64()).view(pa.int64()), *first.columns(h, sizes), pa.array([odd_sketch(x) for x in sets], pa.binary()), pa.array([odd_words(x) for x in sets], pa.list_(pa.int64()))]
            cols += [pa.array([len(x) for x in sets], pa.int32()), pa.array([float(o.mean()) if len(o) else 0.0 for o in often], pa.float64()), pa.array([x for _, x in start], pa.int32()), pa.array([x.view(np.int64) for x, _ in start], pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["is_null", "id0", "text_hash", "fp", *first.fields, "odd", "words", "size", "weight", "lead", "prefix", "whole"])

    more = "".join(f", {c} {t}" for c, t in first.fields.items())
    sketches = own.mapInArrow(run, f"is_null boolean, id0 long, text_hash long, fp long{more}, odd binary, words array<long>, size int, weight double, lead int, prefix array<long>, whole array<long>")
    docs = _prefixed(written(sketches, "sketches"), similarity)
    # of texts with one set, the row with the smallest key stands for all
    least = docs.groupBy("fp").agg(F.min(F.struct("is_null", "id0", "text_hash", *first.fields, "size", "odd", "words")).alias("x"))
    nodes = written(least.select("fp", "x.*"), "nodes")
    sets = _Sets(nodes, own, k, similarity)
    edges = sets.similar(first.pairs(nodes), first.nearest)
    # texts with one label are linked, which is all that rounds need to know
    hung = components(edges) if first.nearest else edges.groupBy("a").agg(F.min("b").alias("b"))
    many = _contested(docs)
    release(df.sparkSession)
    for i in range(ROUNDS):
        found = sets.similar(_with_hubs(many, hung, similarity, i), NEAREST)
        if not found.head(1):
            break
        edges = edges.unionByName(found)
        hung = components(edges)
    rows = many.join(_label(hung, "fp"), "fp", "left").select("key", "fp", "size", "leads", F.coalesce("fp_root", "fp").alias("root"))
    hung = components(edges.unionByName(sets.similar(_across(written(rows, "rows"), nodes, similarity))))
    return docs.select("is_null", "id0", "text_hash", "fp", "size"), hung


def similar_groups(df: DataFrame, *, k: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts whose sets of k-word shingles have a Jaccard similarity of `similarity` or more.

    Returns one row for each different pair of id and text: is_null, id0, text_hash (the key of the row: whether the id
    is null, the id or -1, the text's xxhash64), n (rows that have it), and root, equal within a group. Texts with equal
    shingle sets are one class, those without words too. First, fingerprints within `radius` (0, 2 or 4) differing bits are
    found by the covering masks; linked_sets() says what follows."""
    docs, hung = linked_sets(df, k=k, similarity=similarity, first=Covering(radius), id_col=id_col, text_col=text_col)
    keys = docs.groupBy("is_null", "id0", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(hung.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("is_null", "id0", "text_hash", "n", F.coalesce("root", "fp").alias("root"))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without near duplicates: of each group of similar_groups() the row with the smallest id stays (a null id only
    if the group has no other; among equal ids the text with the smallest hash). All columns of df stay as they are.
    Texts without words are one group. Of rows equal in id and text the least stays, by all columns as JSON."""
    rows, c = renamed(df)
    groups = written(similar_groups(rows, id_col=c[id_col], text_col=c[text_col], **options), "groups")
    stays = groups.groupBy("root").agg(F.min(F.struct("is_null", "id0", "text_hash", "n")).alias("x")).select("x.*")
    stays = written(stays, "stays")
    names = ["is_null", "id0", "text_hash"]
    marked = rows.withColumns({"is_null": F.col(c[id_col]).isNull(), "id0": F.coalesce(F.col(c[id_col]), F.lit(-1)).cast("long"), "text_hash": F.xxhash64(F.col(c[text_col]).cast("string"))})
    out = marked.join(stays.where("n = 1").select(names), names, "left_semi").select(*c.values())
    if stays.where("n > 1").head(1):
        others = [c[x] for x in df.columns if x != text_col]
        again = marked.join(stays.where("n > 1").select(names), names, "left_semi")
        first = again.groupBy(*names).agg(F.min_by(F.struct(*c.values()), F.to_json(F.struct(*others), {"ignoreNullFields": "false"})).alias("x"))
        out = out.unionByName(first.select("x.*"))
    return out.toDF(*df.columns)
