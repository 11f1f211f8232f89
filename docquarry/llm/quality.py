"""Quality rules: base rules on word counts, then boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of the rows of `labels` (LABELLED rows, those with the
smallest hash of the id), and score whole Arrow batches at once. A text without words has zero statistics and fails the
base rules, null and empty ones alike. Without usable labels the base rules alone decide. Repeated rows are judged alike,
each for itself; an empty table gives no rows; a text of any length is taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import boosting
from docquarry.llm.shared import arrow_batches, renamed

#: Labelled rows that a fit takes at most.
LABELLED = 6000
#: The least probability of good quality with which a document is kept.
KEEP = 0.4
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and how quality may follow them: 1 may not fall, -1 may not rise, 0 either.
FEATURES = {"symbols_per_word": -1, "exclamations_per_word": -1, "upper_share": -1, "repeated_share": -1, "dup_line_share": -1, "bare_word_share": -1, "unique_share": 1, "word_length": 0, "log_words": 0, "digit_share": 0}


def repeated(ids: np.ndarray, n: int) -> int:
    """Words that lie in 3-word windows found twice or more; ids: a number below n for each word."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * n + ids[1:-1]
    code = pair * n + ids[2:] if n < 2_000_000 else np.unique(pair, return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(ids), dtype=bool)
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        again[starts + k] = True
    return int(again.sum())


def statistics(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """For each text the counts of BASE (integers) and the FEATURES (floats)."""
    base, more = np.zeros((len(texts), len(BASE)), dtype=np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        t = t or ""
        words = t.encode().split()
        n = len(words)
        if not n:
            base[i, 2] = sum(t.count(c) for c in SYMBOLS)
            continue
        chars = len(t) - sum(t.count(c) for c in SPACES)
        symbols = sum(t.count(c) for c in SYMBOLS)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
        known: dict = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
        again = repeated(ids, len(known))
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        kinds = np.bincount(data, minlength=256)
        upper, lower, digits = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[48:58].sum())
        bare = sum(words.count(x) for x in (b"|", b"-", b"*", b"#")) if symbols or kinds[45] else 0
        base[i] = n, chars, symbols, dup, again
        more[i] = symbols / n, int(kinds[33]) / n, upper / max(1, upper + lower), again / n, dup / len(lines), bare / n, len(known) / n, chars / n, np.log1p(n), digits / chars
    return base, more


def failed(base: np.ndarray) -> np.ndarray:
    """Which rows of statistics fail the base rules."""
    return (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> boosting.Trees:
    """Trees from at most `most` labelled rows. Labels of null, of ids without a document, and of null ids don't count.

    A label counts once for each row that has its id, so of labelled rows those with the smallest hashes of id and text are taken."""
    arrow_batches(docs.sparkSession)
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    few = few.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").select("y", F.xxhash64("id", "text").alias("h"), "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(statistics(b.column(2).to_pylist())[1]), pa.list_(pa.float64()))], names=["y", "h", "x"])

    got = own.mapInArrow(run, "y double, h long, x array<double>").orderBy("h", "y").limit(most).toPandas().sort_values(by="y", kind="stable")
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T[::-1], got["y"].to_numpy())) if len(x) else []
    return boosting.fit(x[order], got["y"].to_numpy()[order] if len(x) else np.zeros(0), list(FEATURES.values()))


def verdict(trees: boosting.Trees, base: np.ndarray, more: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """Which rows are kept: not failed, and of good quality with a probability of `keep` at least."""
    return ~failed(base) & (trees.score(more) >= np.log(keep / (1 - keep)))


def judged(docs: DataFrame, trees: boosting.Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the counts of BASE, base_failed, kept and score, the trees' log odds of good quality."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            base, more = statistics(b.column(1).to_pylist())
            cols = [*base.T, failed(base), verdict(sent.value, base, more), sent.value.score(more)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["id", *BASE, "base_failed", "kept", "score"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, trees: boosting.Trees, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdict(sent.value, *statistics(b.column(at).to_pylist()))))

    own, _ = renamed(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
