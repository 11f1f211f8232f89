"""Embedding of texts over Arrow batches, with retries and a fallback.

An embedder is a picklable object with a dimension and embed(list of texts, kind) that returns as many vectors; kind is
"document" or "query", for models that tell the two apart. Hashed is a local one that needs no model: signed word and
character counts, hashed into its dimension (our own addition).
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import SPACE
from docquarry.sources.files import cut

#: Texts whose places are summed at a time.
ROWS = 256
BATCH, TRIES, PAUSE, BETWEEN = 15, 3, 2.0, 0.5


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, 1e-10 at least."""
    vectors = np.asarray(vectors, dtype=np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)


class Hashed:
    """Words and their runs of three characters, hashed with signs."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
                    h = zlib.crc32(part.encode())
                    row[h % self.dimension] += 1 if h >> 31 else -1
        return out


def hashed_features(df: DataFrame, dimension: int = 384, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, weight: the places of Hashed's vectors that aren't 0, divided by their length.

    Texts are cut into words in functions of Spark, and a text's places are summed where it is read, so nothing is shuffled but the
    sums of rows that share an id, which are one text. A text without words, or whose parts cancel out, has no rows."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), f"{SPACE}+"), lambda w: w != "")
    own = df.select(F.col(id_col).alias("id"), words.alias("words"))

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                b = whole.slice(k, ROWS)
                row, place, n = _sums(b.column("words"), dimension)
                lengths = np.sqrt(np.bincount(row, weights=n.astype(np.float64) ** 2, minlength=len(b)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(place, pa.int32()), pa.array(n), pa.array(lengths[row])], names=["id", "place", "n", "length"])

    sums = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, place int, n long, length double")
    many = cut(df.groupBy(F.col(id_col).alias("o")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("o"), "repeated")
    if many.head(1):
        same = F.col("id").eqNullSafe(F.col("o"))
        again = sums.join(many, same, "left_semi").groupBy("id", "place").agg(F.sum("n").alias("n")).where("n <> 0")
        again = again.withColumn("length", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id"))))
        sums = sums.join(many, same, "left_anti").unionByName(again)
    return sums.select(F.col("id").alias(id_col), "place", (F.col("n") / F.col("length")).alias("weight"))


def _sums(words: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place and sum of what Hashed counts in lists of words, sums of 0 left out."""
    found = pa.table({"row": pc.list_parent_indices(words), "word": pc.list_flatten(words)}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = pc.dictionary_encode(found.column("word").chunk(0))
    parts = [[zlib.crc32(x.encode()) for x in (w, *(w[i : i + 3] for i in range(len(w) - 2)))] for w in word.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in parts])
    h = np.array([x for own in parts for x in own], dtype=np.int64)
    code, row, times = word.indices.to_numpy(), found.column("row").to_numpy().astype(np.int64), found.column("count_all").to_numpy()
    n = sizes[code]
    # the parts of each word of a row stand one after the other
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(sizes) - sizes)[code], n)
    signed = np.where(h >> 31, 1, -1)[at] * np.repeat(times, n)
    sums = np.rint(np.bincount(np.repeat(row, n) * dimension + h[at] % dimension, weights=signed)).astype(np.int64)
    held = np.flatnonzero(sums)
    return held // dimension, held % dimension, sums[held]


def dense(features: DataFrame, dimension: int = 384, *, id_col: str = "doc_id") -> DataFrame:
    """ordinal and embedding (array<float>) of hashed_features(); a text without features has no row."""
    held = features.groupBy(F.col(id_col).alias("ordinal")).agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("m"))
    return held.select("ordinal", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


class Remote:
    """An embedder behind a call: any picklable function (texts, kind) -> vectors that raises when the model doesn't answer."""

    def __init__(self, call: Callable[[list[str], str], list], dimension: int):
        self.call, self.dimension = call, dimension

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        return np.asarray(self.call(texts, kind), dtype=np.float32).reshape(len(texts), self.dimension)


class Retrying:
    """An embedder that calls another in batches of BATCH, with a pause of BETWEEN seconds between them, tries each TRIES times
    and doubles its pause after a failure."""

    def __init__(self, inner, batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE, between: float = BETWEEN, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.batch, self.tries, self.pause, self.between, self.sleep = inner, batch, tries, pause, between, sleep
        self.dimension = inner.dimension

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        out = [np.zeros((0, self.dimension))]
        for k in range(0, len(texts), self.batch):
            if k and self.between:
                self.sleep(self.between)
            for attempt in range(self.tries):
                try:
                    out.append(np.asarray(self.inner.embed(texts[k : k + self.batch], kind)))
                    break
                except Exception:
                    if attempt + 1 == self.tries:
                        raise
                    self.sleep(self.pause * 2**attempt)
        return np.concatenate(out)


class Either:
    """The first embedder, until it fails; then the second for good. They must have one dimension, since vectors of two
    models can't be compared."""

    def __init__(self, first, second):
        if first.dimension != second.dimension:
            raise ValueError(f"embedders of dimensions {first.dimension} and {second.dimension} can't stand in for each other")
        self.first, self.second, self.dimension, self.failed = first, second, first.dimension, False

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        if not self.failed:
            try:
                return np.asarray(self.first.embed(texts, kind))
            except Exception:
                self.failed = True
        return np.asarray(self.second.embed(texts, kind))


def chosen(provider: str, remote=None, local=None):
    """The embedder of a provider: remote, local, or auto, which takes the remote one if it answers a probe. An index keeps the
    dimension of the one that made it (see retrieval.load), so the choice is made once, before anything is embedded."""
    if provider not in ("remote", "local", "auto"):
        raise ValueError(f"no provider {provider}")
    if provider == "remote" and remote is None:
        raise ValueError("there is no remote embedder")
    if provider == "remote":
        return remote
    if provider == "auto" and remote is not None:
        try:
            remote.embed(["ping"], "query")
            return remote
        except Exception:  # it doesn't answer: the local one stands in
            pass
    return local or Hashed()


def embedded(df: DataFrame, embedder, *, text_col: str = "text", to: str = "embedding", kind: str = "document") -> DataFrame:
    """df with a vector of length 1 for each text (all zeros for a text without content)."""
    out = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = normalised(embedder.embed(pdf[text_col].fillna("").tolist(), kind)) if len(pdf) else []
            yield pdf.assign(**{to: list(vectors)})

    return df.mapInPandas(run, out)
