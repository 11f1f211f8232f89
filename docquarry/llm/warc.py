"""WARC archives of pages, and one index of all captures, merged from sorted runs.

Writing: each task packs its records into archives of ARCHIVE bytes or so, every record a gzip member of its own. Spark's
text writer puts each archive in a file (it ends a file with a zero byte, which gzip readers skip as padding), so any
store that Spark writes to will do, and a lost executor's archives are written again.

Reading: each archive is parsed record by record, payload digests are checked, and its captures, sorted by URL key, time
and page, are a run of blocks of BLOCK captures. The runs are written to the shared folder. Ranges of the key are dealt to
tasks, and each merges its parts of all runs with a loser tree, so the ranges in order are the history of all captures.
A task reads the blocks in the order of their first keys: a run's next block comes before any capture in it is due, so the
merge is an external one. It holds the open blocks, about one for each run, and never a whole range.

Of records with equal payloads of at least SHARED bytes, the one with the largest id is a response and the others revisit
it; rows that repeat that id are all responses. A null id counts as smaller than any. Null payloads are empty. A page
without a capture time was captured EPOCH plus its id modulo SPAN in seconds, a null id at EPOCH. Texts of any length are one
record. Columns of other names in the table play no part.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.shared import arrow_batches, scratch, written

SHARED, ARCHIVE, RANGE, BLOCK = 1000, 16 << 20, 200_000, 64
EPOCH, SPAN = datetime.datetime(2024, 1, 1), 10**10
#: Parts that the rows of a payload are dealt to when they get the page they refer to.
SALTS = 16
_CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the path and query, all in lower case: com,example,www)/a?b."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.split("#", 1)[0].lower()
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0], rest[cut:]
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/") if host else tail


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member: a response with its payload, or a revisit with the response's headers only."""
    name = lambda p: "<urn:page:{}>".format("null" if p is None else p)
    date = EPOCH + datetime.timedelta(seconds=(page or 0) % SPAN)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if refers_to is not None else http + payload
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_CRLF.join(h.encode() for h in head) + 2 * _CRLF + body + 2 * _CRLF) + packer.flush()


def members(data: bytes):
    """Offset, length and content of each gzip member; zero bytes after the last are padding."""
    at, view = 0, memoryview(data)
    while at < len(data) and data[at]:
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(data):
                raise ValueError("the archive ends within a record")
            step = view[end : end + 65536]
            parts.append(unpack.decompress(step))
            end += len(step)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parsed(content: bytes) -> dict:
    """Page, URL, type, digest (hexadecimal), payload length and referred page of a record; a payload must fit its digest."""
    head, _, rest = content.partition(2 * _CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = lambda name: None if name in (None, "<urn:page:null>") else int(name[len("<urn:page:") : -1])
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4:
        raise ValueError("a record's length doesn't fit its header")
    http, _, payload = body.partition(2 * _CRLF)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't fit its digest")
    return {"page": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "digest": digest, "size": size, "refers_to": page(fields.get("WARC-Refers-To")), "at": fields["WARC-Date"]}


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page, url, payload, refers_to. Digests shared by several rows are found from digests alone; payloads aren't grouped."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= SHARED).groupBy("digest").agg(F.max("page").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared.select("digest", "newest"), "shared")  # of known size: payloads stay where they are if it is small
    # only payloads that several rows have need the join; their rows meet in SALTS places
    spread = shared.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url", F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left")
    older = F.col("newest").isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col("newest"))) & (F.octet_length("payload") >= SHARED)
    return out.select("page", "url", "payload", F.when(older, F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive: int = ARCHIVE) -> None:
    """Write a record for each row of pages to archives in the folder `path`. An archive closes at `archive` bytes, so it
    has one record more at most."""
    arrow_batches(pages.sparkSession)
    rows = with_references(pages, id_col, url_col, html_col)

    def run(batches):
        held: list[bytes] = []
        size = 0
        for b in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, url, payload, refers_to, hashlib.sha1(payload).digest()))
                size += len(held[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The runs of the archives in a folder: run (the archive's file), pos (order in the run), url_key, captured_at, page,
    url, type, digest, size, refers_to, offset, length, and head_key, head_at and head_page, the first key of the block."""
    arrow_batches(spark, rows=1)
    names = ["run", "pos", "url_key", "captured_at", "page", "url", "type", "digest", "size", "refers_to", "offset", "length", *HEAD]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                entries = []
                for at, length, content in members(data.as_buffer().to_pybytes()):
                    r = parsed(content)
                    entries.append((url_key(r["url"]), r["at"], r["page"], r["url"], r["type"], r["digest"], r["size"], r["refers_to"], at, length))
                entries.sort(key=order)
                entries = [(*e, *entries[i - i % BLOCK][:3]) for i, e in enumerate(entries)]
                cols = [[file] * len(entries), list(range(len(entries))), *(list(c) for c in zip(*entries, strict=True))] if entries else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 1").select("path", "content")
    types = {pa.string(): "string", pa.int64(): "long"}
    return files.mapInArrow(run, ", ".join(f"{n} {types[k]}" for n, k in zip(names, kinds, strict=True)))


#: Columns of a capture that hold the first key of its block.
HEAD = ["head_key", "head_at", "head_page"]


def order(entry: tuple) -> tuple:
    """The order of captures: URL key, time, page (null first)."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


class LoserTree:
    """Merges sorted lists: inner nodes keep the losers of matches between lists, so the next winner needs one match for
    each level. Of equal heads the smaller number wins. add() opens a list or appends to one at any time, and plays the matches from its leaf
    to the root only; for that, nodes keep their winners, too. A list that has run out gives its leaf to the next that is opened, so there are about
    as many leaves as lists are open at a time."""

    def __init__(self, lists=(), key=order):
        self.key, self.leaf, self.free = key, {}, []
        self.lists, self.at, self.number, self.head = [], [], [], []
        self._double()
        for number, entries in enumerate(lists):
            self.add(number, list(entries))

    def _double(self) -> None:
        """Twice as many leaves (two at first), and all matches anew."""
        k = len(self.head)
        self.k = max(2, 2 * k)
        self.free += range(self.k - 1, k - 1, -1)
        for column, empty in ((self.lists, ()), (self.at, 0), (self.number, -1), (self.head, None)):
            column += [empty] * (self.k - k)
        self.losers, self.winners = [-1] * self.k, [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            self._match(node)

    def _match(self, node: int) -> None:
        a, b = self.winners[2 * node], self.winners[2 * node + 1]
        self.winners[node], self.losers[node] = (b, a) if self._beats(b, a) else (a, b)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, self.number[a]) < (y, self.number[b]))

    def add(self, number: int, entries: list) -> None:
        """Append entries to the list of a number, a new one or one that goes on."""
        if not entries:
            return
        leaf = self.leaf.get(number)
        if leaf is not None:
            # the head of a list that goes on stays as it is
            self.lists[leaf] = self.lists[leaf][self.at[leaf] :] + entries
            self.at[leaf] = 0
            return
        if not self.free:
            self._double()
        leaf = self.leaf[number] = self.free.pop()
        self.lists[leaf], self.at[leaf], self.number[leaf], self.head[leaf] = entries, 0, number, self.key(entries[0])
        node = (self.k + leaf) // 2
        while node:
            self._match(node)
            node //= 2

    def before(self, limit=None):
        """The entries in order, as long as their key is below the limit."""
        while (head := self.head[best := self.winners[1]]) is not None and (limit is None or head < limit):
            yield self.lists[best][self.at[best]]
            self.at[best] += 1
            if self.at[best] < len(self.lists[best]):
                self.head[best] = self.key(self.lists[best][self.at[best]])
            else:
                self.head[best], self.lists[best] = None, ()
                del self.leaf[self.number[best]]
                self.free.append(best)
            w, node = best, (self.k + best) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                self.winners[node] = w
                node //= 2

    def __iter__(self):
        return self.before()


def interleaved(rows, number, head, key):
    """Merge rows of several runs that come block by block, blocks in the order of head(row), the same for all of a block
    and not above the keys in it; number(row): the row's run. Rows of a run come in the order of their keys."""
    tree, of, block, now = LoserTree([], key), {}, [], None
    for row in rows:
        this = number(row), head(row)
        if this != now:
            if block:
                tree.add(of.setdefault(now[0], len(of)), block)
                block = []
            # whatever is below the head of the block to come can't be preceded by anything still unread
            yield from tree.before(this[1])
            now = this
        block.append(row)
    if block:
        tree.add(of.setdefault(now[0], len(of)), block)
    yield from tree.before()


def merged(runs: DataFrame) -> DataFrame:
    """All captures of the runs with capture_no, their place in the order of URL key, time and page, from 0.

    A range has about RANGE captures; keys end with the page, so a URL with many captures is split too. Of each range
    only its count reaches the driver."""
    spark = runs.sparkSession
    runs = written(runs, "runs")
    names = [c for c in runs.columns if c not in HEAD]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    dealt = runs.repartitionByRange(parts, "url_key", "captured_at", F.col("page").asc_nulls_first())
    dealt = dealt.sortWithinPartitions("head_key", "head_at", F.col("head_page").asc_nulls_first(), "run", "pos")
    arrow_batches(spark, rows=1000)

    def run(batches):
        part, out, done = TaskContext.get().partitionId(), [], 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for row in interleaved(rows, lambda r: r[0], lambda r: order(r[-3:]), lambda r: order(r[2:])):
            out.append(row[: len(names)])
            if len(out) == 1000:
                yield batch(part, done, out)
                done, out = done + len(out), []
        if out:
            yield batch(part, done, out)

    schema = runs.select(*names).schema
    kinds = [pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in schema.fields]

    def batch(part: int, done: int, rows: list) -> pa.RecordBatch:
        cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64())], names=[*names, "part", "nth"])

    ordered = written(dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", part int, nth long"), "history")
    counts = sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "part int, first long")
    return ordered.join(F.broadcast(first), "part").select(*names, (F.col("first") + F.col("nth")).alias("capture_no"))


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write the archives of pages, read them back and merge their index. Per page: id, payload_bytes, payload_digest,
    record_type, refers_to, url_key, captured_at, capture_no. An empty table gives an empty result."""
    path = path or scratch(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    found = merged(read(pages.sparkSession, path))
    return found.select(F.col("page").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url_key", "captured_at", "capture_no")


#: DuckDB SQL of archived() over the table of pages.
ARCHIVED_SQL = """
WITH split AS (SELECT page_id, coalesce(html, '') AS html, lower(split_part(CASE WHEN length(split_part(url, '://', 2)) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END, '#', 1)) AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS authority, regexp_extract(rest, '^[^/?]*(.*)$', 1, 's') AS tail FROM split),
keyed AS (SELECT *, split_part(regexp_replace(authority, '^.*@', ''), ':', 1) AS host, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS newest,
          strftime(TIMESTAMP '2024-01-01' + to_seconds(((coalesce(page_id, 0) % 10000000000) + 10000000000) % 10000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM hosts),
named AS (SELECT *, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END ELSE tail END AS url_key,
          CASE WHEN payload_bytes >= 1000 AND newest IS NOT NULL AND (page_id IS NULL OR page_id < newest) THEN newest END AS refers_to FROM keyed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) - 1 AS capture_no FROM named"""
