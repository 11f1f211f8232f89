"""Byte-level BPE: encoding and decoding by the tokenizers library over Arrow batches.

A rank file maps byte strings to ranks. The library works on characters, so each byte gets a printable character (the
byte table); a token's merge is the last pair that the lower ranks leave of it. A text is split by the pattern and each
match is merged alone, so a worker remembers the ids of the matches it has met first (REMEMBERED of them), and the
library merges the other ones only.

Null texts count as empty and give no ids. A repeated row gives a repeated result, a text of any length is encoded
whole, and ids that no vocabulary has raise an error when decoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.shared import arrow_batches

#: Matches a worker remembers, the characters above which it forgets one at once, and those that are merged in one call.
REMEMBERED, LONG, TOGETHER = 150_000, 64, 20_000


def byte_table() -> list[str]:
    """A printable character for each byte: itself if it prints in Latin-1, else the next one from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, iter(range(0x100, 0x200))
    for b in range(256):
        out[b] = chr(b) if b in prints else chr(next(spare))
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by the ranks below the token's own leaves of it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[at] + parts[at + 1], own) >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.lru_cache(maxsize=4)
def library_json(data: bytes) -> str:
    """The tokenizers library's own form of a rank file."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(data), byte_table()
    as_text = lambda token: "".join(char[b] for b in token)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        if pair := last_pair(token, ranks):
            merges.append((as_text(pair[0]), as_text(pair[1])))
    model = models.BPE(vocab={as_text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, as_json: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.split, self.known = Tokenizer.from_str(as_json), regex.compile(pattern), {}
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = self.library.get_vocab()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers. One call merges many, each alone; the lengths of
        ids in bytes tell where a piece's ids end."""
        out: list[bytes] = []
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            ids = np.array(self.library.encode(some, is_pretokenized=True, add_special_tokens=False).ids, dtype="<u4")
            ends = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in some])) + 1).tolist()
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens, as little-endian unsigned 32-bit integers."""
        known = self.known
        cut = [self.split.findall(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in known})
        fresh = dict(zip(new, self._merged(new), strict=True))
        out = [b"".join([known[p] if p in known else fresh[p] for p in pieces]) for pieces in cut]
        known.update([(p, fresh[p]) for p in new if len(p) <= LONG][: max(0, REMEMBERED - len(known))])
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, as encode() gives them; single tokens may hold parts of a character."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """For each id the first character it touches and the one after its last; how many characters are split.

        Characters follow from bytes: a byte's character is the count of leading bytes up to it, less one."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        lengths = self.lengths[np.frombuffer(ids, dtype="<u4")]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not len(ids):
            return starts, ends, 0
        first, last = char[starts], char[ends - 1] + 1
        return first, last, int(np.unique(first[1:][(data[starts[1:]] & 0xC0) == 0x80]).size)


@functools.lru_cache(maxsize=2)
def codec(as_json: str, pattern: str) -> Codec:
    return Codec(as_json, pattern)


def vocabulary(path: str) -> str:
    """The library's form of the rank file at a path of the driver; executors get it by broadcast (about 2 MB)."""
    with open(path, "rb") as f:
        return library_json(f.read())


def encode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per row of df: id, token_ids array<int>; with offsets also char_start, char_end array<int> and
    split_chars, the number of characters whose bytes lie in more than one token."""
    spark = df.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary(path))
    fields = [("token_ids", pa.list_(pa.int32()))]
    if offsets:
        fields += [("char_start", pa.list_(pa.int32())), ("char_end", pa.list_(pa.int32())), ("split_chars", pa.int64())]

    def run(batches):
        c = codec(sent.value, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = c.encode(texts)
            cols = [[np.frombuffer(i, dtype="<u4") for i in ids]]
            if offsets:
                spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                cols += [list(x) for x in zip(*spans, strict=True)] if spans else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind) for v, (_, kind) in zip(cols, fields, strict=True))], names=["id", *(n for n, _ in fields)])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    types = {"token_ids": "array<int>", "char_start": "array<int>", "char_end": "array<int>", "split_chars": "long"}
    out = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {types[n]}" for n, _ in fields))
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per row of df: id and decoded binary. Null ids count as none."""
    spark = df.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        c = codec(sent.value, ".")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(i or (), dtype="<u4").tobytes()) for i in b.column(1).to_pylist()], pa.binary())], names=["id", "decoded"])

    own = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids again, and return per row: id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes), split_chars, and with ids also
    token_bytes (the ids as such integers). Both directions run in one pass, so no ids are stored or shuffled."""
    spark: SparkSession = df.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        c = codec(sent.value, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, sha, back, split, raw = [], [], [], [], []
            for t, data in zip(texts, c.encode(texts), strict=True):
                n.append(len(data) // 4)
                sha.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(c.decode(data)).hexdigest())
                split.append(0 if t.isascii() else c.offsets(t, data)[2])
                raw.append(data)
            cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(split, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *([pa.array(raw, pa.binary())] if ids else [])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "split_chars", *(["token_bytes"] if ids else [])])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, split_chars long" + ", token_bytes binary" * ids)
    return out.withColumnRenamed("id", id_col)
