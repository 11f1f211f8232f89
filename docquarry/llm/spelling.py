"""Spelling variants of the words of a corpus, found by letter-parity bitmasks in three bands.

Each letter has a bit in one of three bands, and a word's mask tells which letters it has an odd number of times. One
replaced letter flips at most two bits, so one band at least is equal; an inserted or deleted one flips one, so two
bands are. Words are joined on equal bands and on length, and what meets is verified.

A vocabulary grows and the bands don't, so buckets of more than CROWD words are split, without losing a pair: where a
band is equal, no letter of it is touched, so its letters stand in the same places of both words, but for the place that an
insertion adds. Such words meet again by their shape, in which the letters of equal bands, and of those of a second,
third and fourth dealing of the letters to bands, are kept and all others are dots.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import arrow_batches, forget, release, written

#: What a run of letters is.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of fewer code points, or that come less often, are none.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: An edit is made in the runs of which this number divides the hash.
EDITED = 97
#: Buckets of more rows are split by shapes. Pairs don't depend on it.
CROWD = 32
#: Letters by how often they come in European languages; others follow by code point. Only the evenness of bands depends on it.
OFTEN = "etaoinsrhldcumfpgwybvkxjqz"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = OFTEN + "".join(map(chr, range(0xC0, 0x100)))
#: Four dealings of the letters to three bands. Two letters are together in one of them at most, but for ranks that are nine apart.
DEALINGS = [{c: f(i % 3, i // 3 % 3) % 3 for i, c in enumerate(LETTERS)} for f in (lambda x, y: x, lambda x, y: y, lambda x, y: x + y, lambda x, y: x + 2 * y)]
_BIT = {c: 1 << i for i, c in enumerate(LETTERS)}


def mask(word: str) -> int:
    """The letters that a word has an odd number of times, as bits."""
    m = 0
    for c in word:
        m ^= _BIT.get(c, 0)
    return m


_BANDS = [sum(_BIT[c] for c in LETTERS if DEALINGS[0][c] == k) for k in range(3)]


#: What a word is in a bucket: replaced words meet each other, and words a letter is inserted in meet those that have one more.
REPLACED, SHORT, LONG = 0, 1, 2


@functools.cache
def _dots(path: str, role: int) -> dict[int, str]:
    """A translation into dots of the letters that may be touched. path: a band of each dealing, equal for REPLACED, else the touched one."""
    own = lambda c: [d[c] == int(k) for d, k in zip(DEALINGS, path, strict=False)]
    return {ord(c): "." for c in LETTERS if (not any(own(c)) if role == REPLACED else all(own(c)))}


def shape(word: str, role: int, path: str) -> str:
    """The word with a dot for each letter that may be touched."""
    return word.translate(_dots(path, role))


def first_keys(word: str) -> list[tuple[int, str, str]]:
    """(role, path, key) of a word by the bands of its mask: one band and the length, or the two others and the length of the short word."""
    m = mask(word)
    keys = [(REPLACED, str(k), f"={k}|{m & band:x}|{len(word)}") for k, band in enumerate(_BANDS)]
    return keys + [(role, str(k), f"~{k}|{m & ~band:x}|{len(word) - (role == LONG)}") for k, band in enumerate(_BANDS) for role in (SHORT, LONG)]


def next_keys(word: str, role: int, path: str) -> list[tuple[int, str, str]]:
    """(role, path, key) of a word by its shapes, one dealing further; those of LONG with one dot less."""
    found = []
    for longer in (path + str(k) for k in range(3)):
        s = shape(word, role, longer)
        shapes = {s[:i] + s[i + 1 :] for i, c in enumerate(s) if c == "."} if role == LONG else {s}
        found += [(role, longer, f"{'~' if role else '='}{longer}|{x}") for x in sorted(shapes)]
    return found


def _keyed(rows: DataFrame, keys) -> DataFrame:
    """word, role, path and the hash of the key of each row by a function of its columns. Words with equal hashes are only compared."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())

    def run(batches):
        for b in batches:
            out = [(row[0], role, path, xxhash.xxh64_intdigest(key)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for role, path, key in keys(*row)]
            words, roles, paths, hashes = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip((words, roles, paths), kinds, strict=False)), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))], names=["word", "role", "path", "key"])

    return rows.mapInArrow(run, "word string, role int, path string, key long")


def _joined(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a and b joined by a shuffle. All that is joined here grows with the vocabulary, and Spark takes what mapInArrow makes for
    smaller than it is, so it would pass such tables whole through the driver, as broadcasts."""
    return a.join(b.hint("merge"), on, how)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of different words, each once, that differ by one inserted, deleted or replaced code point. words: word,
    all different, of letters as RUN has them, A-Z lower-cased."""
    spark = words.sparkSession
    arrow_batches(spark, rows=4_000)
    keyed, found = _keyed(words.select("word"), first_keys), []
    for level in range(len(DEALINGS)):
        own = Window.partitionBy("key")
        sizes = {"n": F.count(F.lit(1)), "least": F.min("role"), "most": F.max("role")}
        if level:
            # one shuffle by key: most rows of shapes are alone, and go here
            met = keyed.withColumns({c: f.over(own) for c, f in sizes.items()})
        else:
            # many words have the same band, so their number is aggregated and joined
            met = _joined(keyed, keyed.groupBy("key").agg(*(f.alias(c) for c, f in sizes.items())), "key")
        met = written(met.where(f"n > 1 and (least = {REPLACED} or least = {SHORT} and most = {LONG})").select("word", "role", "path", "key", "n"), "bands")
        last = level == len(DEALINGS) - 1
        few = met if last else met.where(F.col("n") <= CROWD)
        a, b = few.where(F.col("role") != LONG).select("key", F.col("role").alias("as"), F.col("word").alias("a")), few.select("key", "role", F.col("word").alias("b"))
        pairs = _joined(a, b, "key").where(((F.col("as") == SHORT) & (F.col("role") == LONG)) | ((F.col("role") == REPLACED) & (F.col("a") < F.col("b")))).where(F.levenshtein("a", "b", 1) == 1)
        found.append(written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
        many = None if last else written(met.where(F.col("n") > CROWD).select("word", "role", "path").distinct(), "crowded")
        forget(spark, met)
        release(spark)
        if last or not many.head(1):
            break
        keyed = _keyed(many, next_keys)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def counted(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts, LEAST_LENGTH code points or longer, that come LEAST_COUNT times or more.

    A run of letters is a word, A-Z lower-cased; where EDITED divides the crc32 of "<id>:<run>" it lacks the code point at
    crc32 modulo its length. Words are counted before they are shuffled."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= LEAST_LENGTH)
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    word: Column = F.when(F.col("h") % EDITED == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    A word's form is its near word of the largest n (ties: the first by code points) if that is 2 * n or more, else null;
    root is where forms lead in the end. Each form has twice the count of its word, so there are no circles, and chains are
    followed by doubling."""
    own = written(words.select("word", "n"), "words")
    pairs = near_pairs(own)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _joined(both, own.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), F.col("b").alias("form"))).alias("x"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("x.form").alias("near_form"), (-F.col("x.minus")).alias("near_n"))
    takes = F.coalesce(F.col("near_n") >= 2 * F.col("n"), F.lit(False))
    rows = _joined(own, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("near_form")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n"))
    rows = written(rows, "forms")
    hops, done = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "hops"), False
    while not done:
        step = _joined(hops, hops.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        step = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "hops")
        done = not step.where("moved").head(1)
        forget(hops.sparkSession, hops)
        hops = step.select("word", "root")
    return _joined(rows, hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all texts: grouped() of counted().

    Null and empty texts have no words, a null id counts as an empty one, repeated rows count again, other columns don't matter,
    and a table without words gives no rows."""
    return grouped(counted(df, id_col=id_col, text_col=text_col))


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
#: The same in DuckDB: crc32 by its table, near words by the words that are left when a letter goes.
VARIANTS_SQL = f"""WITH RECURSIVE
    crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{RUN}')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
    bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::BIGINT[] END)) AS b FROM runs),
    hashed AS (SELECT run, times, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
    words AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % {EDITED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}),
    less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
              UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY m.n DESC, b) AS form, max(m.n) AS form_n FROM pairs JOIN words m ON m.word = b GROUP BY 1),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, coalesce(form, word) AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) JOIN forms r ON r.word = c.root AND r.form IS NULL"""
