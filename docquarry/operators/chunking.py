"""From elements to chunks within token budgets.

A document's elements are one fold with resets that depend on the data. Elements are dealt by document and sorted, and the
fold goes on from one Arrow batch to the next, so a task holds the prose of a chunk and never a document. elements: doc_name,
ord, page_number, element_type, content, section.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.config import CHUNKING, Chunking
from docquarry.functions.text import breadcrumb, parent_id, token_estimate

Count = Callable[[str], int]
#: Chunks that a task hands on at a time.
ROWS = 256
_SENTENCE = regex.compile(r"(?<=[.!?])\s+(?=[A-Z0-9✓✗•\-])")


def estimate(text: str) -> int:
    """The estimate of functions.text.token_estimate, for one string."""
    return max(1, int(len(text) / 3.8)) if text else 0


def sentences(text: str) -> list[str]:
    """The sentences of functions.text.sentences, for one string."""
    return [s for part in _SENTENCE.split(text) if (s := part.strip())] or [text]


def windows(parts: list[str], count: Count, config: Chunking = CHUNKING) -> Iterator[str]:
    """Pack sentences up to the target. The next window begins with the last ones that fit in the overlap."""
    held: list[str] = []
    for s in parts:
        if held and count(" ".join([*held, s])) > config.target:
            yield " ".join(held)
            room, start = config.overlap, len(held)
            while start and count(held[start - 1]) <= room:
                start -= 1
                room -= count(held[start])
            held = held[start:]
        held.append(s)
    if held:
        yield " ".join(held)


def table_parts(markdown: str, count: Count, config: Chunking = CHUNKING) -> list[tuple[str, int | None]]:
    """Parts of a table, header and separator repeated in each, with the part's number; a table under 3 lines is one part
    without a number."""
    lines = [x for line in markdown.split("\n") if (x := line.strip())]
    if len(lines) < 3:
        return [(markdown, None)]
    head, parts = "\n".join(lines[:2]), [[]]
    for row in lines[2:]:
        if parts[-1] and count("\n".join([head, *parts[-1], row])) > config.target:
            parts.append([])
        parts[-1].append(row)
    return [("\n".join([head, *rows]), i) for i, rows in enumerate(parts, 1)]


def packed(elements: Iterable, count: Count = estimate, config: Chunking = CHUNKING) -> Iterator[tuple[str, int, str, str, str, int | None]]:
    """Chunks of a document's ordered elements (page, type, content, section): suffix of the id, page, section, type,
    content and the part of a split table.

    Prose gathers until its budget is full, the section changes, or a heading, table or code comes; a heading then opens
    the next prose. A list item changes the section and page only. The page is that of the element that ends the prose,
    except that a change of section ends it on the page before."""
    number, held, section, page = 0, [], "Introduction", 1

    def prose():
        nonlocal number, held
        text, held = "\n\n".join(held).strip(), []
        if text:
            whole = count(text) <= config.most
            for body in [text] if whole else windows(sentences(text), count, config):
                number += 1
                yield f"c{number}", page, section, "prose", body, None

    for at, kind, content, own_section in elements:
        if own_section and own_section != section:
            yield from prose()
            section = own_section
        page = at
        if kind == "paragraph":
            held.append(content)
            if count("\n\n".join(held)) >= config.target:
                yield from prose()
        elif kind in ("heading", "table", "code"):
            yield from prose()
            if kind == "heading":
                held.append("### " + content.lstrip("#").strip())
                continue
            number += 1
            if kind == "code" or count(content) <= config.most:
                yield f"c{number}", page, section, kind, content, None
                continue
            parts = table_parts(content, count, config)
            for body, part in parts:
                yield f"c{number}" + (f"_p{part}" if part and len(parts) > 1 else ""), page, section, kind, body, part
    yield from prose()


def packed_documents(rows: Iterable, count: Count = estimate, config: Chunking = CHUNKING) -> Iterator[tuple]:
    """Chunks of elements (doc_name, page, type, content, section) that come document by document, in order: doc_name, the chunk's
    place, and what packed() gives. Rows are taken as they are needed."""
    for name, own in itertools.groupby(rows, key=lambda r: r[0]):
        els = ((page, kind, content or "", section) for _, page, kind, content, section in own)
        for i, c in enumerate(packed(els, count, config)):
            yield name, i, *c


def counter(spark, ranks_path: str | None = None, pattern: str | None = None):
    """A function that makes a token counter on a worker: the estimate, or exact counts of a rank file and its pattern."""
    if ranks_path is None:
        return lambda: estimate
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def make() -> Count:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in sent.value.splitlines() if x.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


def chunks(elements: DataFrame, config: Chunking = CHUNKING, *, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """chunk_id, parent_id, doc_name, page_number, section_path, element_type, text, raw_content, token_count, char_count,
    ordinal, is_split_table, part. A null content is an empty one. token_count counts the text with its breadcrumb, char_count the content alone."""
    spark = elements.sparkSession
    make = counter(spark, ranks_path, pattern)
    columns = ["doc_name", "ord", "page_number", "element_type", "content", "section"]
    rows = elements.select(*columns).repartition("doc_name").sortWithinPartitions(*columns).drop("ord")
    kinds = {"doc_name": pa.string(), "ordinal": pa.int32(), "suffix": pa.string(), "page_number": pa.int32(), "section_path": pa.string(), "element_type": pa.string(), "raw_content": pa.string(), "part": pa.int32()}

    def run(batches):
        count = make()
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for some in itertools.batched(packed_documents(each, count, config), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds.values(), strict=True)], names=list(kinds))

    got = rows.mapInArrow(run, "doc_name string, ordinal int, suffix string, page_number int, section_path string, element_type string, raw_content string, part int")
    return projected(got, config, None if ranks_path is None else (make,))


def projected(got: DataFrame, config: Chunking = CHUNKING, exact: tuple | None = None) -> DataFrame:
    """Chunk rows with ids, breadcrumbs and counts. got: doc_name, ordinal, suffix, page_number, section_path, element_type,
    raw_content, part."""
    from docquarry.functions.text import stem

    crumb = breadcrumb(F.col("doc_name"), F.col("section_path"), F.col("page_number"))
    text = F.concat(crumb, F.lit("\n"), F.col("raw_content")) if config.breadcrumbs else F.col("raw_content")
    rows = got.withColumn("text", text)
    if exact:
        make = exact[0]

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            n = make()
            for s in batches:
                yield s.map(n).astype("int32")

        tokens = count("text")
    else:
        tokens = token_estimate(F.col("text"))
    split = F.when(F.col("part").isNotNull(), F.col("suffix").contains("_p"))
    return rows.select(F.concat(stem(F.col("doc_name")), F.lit("_"), F.col("suffix")).alias("chunk_id"), parent_id(F.col("doc_name"), F.col("section_path")).alias("parent_id"), "doc_name", "page_number", "section_path", "element_type", "text", "raw_content", tokens.alias("token_count"), F.length("raw_content").alias("char_count"), "ordinal", split.alias("is_split_table"), "part")


def manifest(rows: DataFrame, by: str) -> DataFrame:
    """Chunks and tokens by a column, and their mean of tokens (1 digit)."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").cast("long").alias("tokens"), F.round(F.sum("token_count") / F.greatest(F.lit(1), F.count(F.lit(1))), 1).alias("mean_tokens"))
