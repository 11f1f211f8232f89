"""Near duplicates by an LSH forest over MinHash signatures.

Each of TREES trees orders all texts by a signature of DEPTH minima. Texts that share the first values of a signature stand
next to each other, so a text's neighbours in an order have the longest common prefixes with it, and are its candidates as far as
they share LEAST values. How deep a prefix must be follows from the region: in one of few texts all of them are within NEAR
places at the least depth, and in a crowded one only those with deeper prefixes are. No region is gathered, whatever its
size: orders are cut into ranges, each with the first NEAR rows of the next.

A signature may miss a pair, and a crowded region's neighbours are not all of its texts. So candidates that were confirmed on
the whole sets join what they can, and simhash.linked_sets() compares every other pair that can be as similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import simhash
from docquarry.llm.shared import arrow_batches, written

#: Orders, values of a signature, and values that neighbours must share at least. Two sets with a similarity of 0.85 share
#: two values in one of eight orders with a probability of 1 - (1 - 0.85^2)^8 = 0.99996.
TREES, DEPTH, LEAST = 8, 10, 2
#: Neighbours to either side, and how many of a text's neighbours are compared with it, those that differ least by odd sketches.
NEAR, NEAREST = 6, 3
#: Parts that the documents of a set are dealt to when they get their component.
SALTS = 16
_RANDOM = np.random.default_rng(20_240_612)
_FACTOR = _RANDOM.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signatures of TREES * DEPTH 16-bit values for each set: hashes of the minima of as many permutations of its elements.
    Zeros for an empty set. hashes: of all sets, one after the other; sizes: how many each has."""
    out = np.zeros((len(sizes), TREES * DEPTH), dtype=">u2")
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for j in range(TREES * DEPTH):
            out[full, j] = (np.minimum.reduceat(hashes * _FACTOR[j] + _SHIFT[j], starts) * _MIX) >> np.uint64(48)
    return out


def common_values(labels: np.ndarray, step: int) -> np.ndarray:
    """How many values each row of labels and the row `step` places later share from the first on."""
    return np.cumprod(labels[:-step] == labels[step:], axis=1).sum(axis=1)


class Forest:
    """First pairs of simhash.linked_sets(): neighbours in the orders of the forest."""

    fields, nearest = {"signature": "binary"}, NEAREST

    def columns(self, hashes: np.ndarray, sizes: np.ndarray) -> list:
        return [pa.array([x.tobytes() for x in signatures(hashes, sizes)], pa.binary())]

    def pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of fp that stand within NEAR places of each other in an order and share LEAST values or more there."""
        width = 2 * DEPTH
        trees = F.posexplode(F.array(*(F.substring("signature", 1 + t * width, width) for t in range(TREES)))).alias("tree", "label")
        rows = nodes.where("size > 0").select("fp", trees)
        order = ["tree", "label", "fp"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = written(rows.select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "orders")
        # the first rows of a range are also the last of the range before
        both = rows.unionByName(rows.where(F.col("at") < NEAR).withColumn("part", F.col("part") - 1)).drop("at")
        arranged = both.repartition("part").sortWithinPartitions("part", *order)

        def run(batches):
            held = None
            for b in batches:
                new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] + [np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=">u2").reshape(-1, DEPTH)]
                tree_part, fp, labels = new[0], new[1], new[2]
                old = 0 if held is None else len(held[0])
                if old:
                    tree_part, fp, labels = (np.concatenate((x, y)) for x, y in zip(held, new, strict=True))
                a, z = [], []
                for step in range(1, min(NEAR, len(fp) - 1) + 1):
                    near = (common_values(labels, step) >= LEAST) & (tree_part[:-step] == tree_part[step:])
                    # pairs within what is held have been found before
                    near &= np.arange(step, len(fp)) >= old
                    a.append(fp[:-step][near])
                    z.append(fp[step:][near])
                held = tree_part[-NEAR:], fp[-NEAR:], labels[-NEAR:]
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(z), pa.int64())], names=["a", "b"])

        arrow_batches(nodes.sparkSession, rows=10_000)
        one = (F.col("part").cast("long") * TREES + F.col("tree")).alias("place")
        found = written(arranged.select(one, "fp", "label").mapInArrow(run, "a long, b long").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "neighbours")
        arrow_batches(nodes.sparkSession)
        return found


def near_duplicates(df: DataFrame, *, k: int = 3, similarity: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_shingles (long), component_id, kept.

    n_shingles is the number of different k-word shingles, A-Z lower-cased (fewer words: the whole sequence is one). Texts
    are linked whose sets have a Jaccard similarity of `similarity` or more; component_id is the smallest id reachable over
    links, the row's own included, and kept says whether it is the row's own. Ids are integers.

    Texts without words, null ones too, are linked with nothing. A null id is never a component_id unless its component has no
    other. Repeated rows stay, each with the same result. Other columns don't matter. An empty table gives an empty result."""
    kind = df.schema[id_col].dataType
    docs, hung = simhash.linked_sets(df, k=k, similarity=similarity, first=Forest(), id_col=id_col, text_col=text_col)
    own = F.struct("is_null", "id0")
    sets = docs.where("size > 0").groupBy("fp").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n"))
    sets = sets.join(hung.select(F.col("a").alias("fp"), F.col("b").alias("other")), "fp", "left").withColumn("root", F.coalesce("other", "fp"))
    sets = written(sets.select("fp", "least", "n", "root"), "sets")
    roots = sets.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("rows")).where(F.col("rows") > 1).drop("rows")
    # a document without another of its component needs no join; those of one set meet in SALTS places
    classes = sets.join(roots, "root").select("fp", "component", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt"))
    rows = docs.withColumn("salt", F.pmod(F.xxhash64("id0", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    found = rows.join(classes, ["fp", "salt"], "left").withColumn("component", F.coalesce("component", own))
    given = lambda is_null, number: F.when(~is_null, number).cast(kind)
    return found.select(given(F.col("is_null"), F.col("id0")).alias(id_col), F.col("size").cast("long").alias("n_shingles"), given(F.col("component.is_null"), F.col("component.id0")).alias("component_id"), (F.col("component") == own).alias("kept"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: The same in DuckDB, for ids that are all different: shared shingles of all pairs of documents are counted.
NEAR_SQL = f"""WITH RECURSIVE
    words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach AS (SELECT doc_id, doc_id AS seen FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
