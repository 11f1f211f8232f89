import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docquarry.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary(PATH), P.PATTERN)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


def test_random_texts_equal_the_plain_encoder_and_round_trip(codec, encoding):
    rng = random.Random(1)
    pool = ["a", " ", "  ", "\n", "\t", "-", "é", "日本", "!", "1", "'s", "ing", "the", "\x85", "\xa0", "😀", "ab", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    made = codec.encode(texts)
    assert [ids(m) for m in made] == [encoding.encode_ordinary(t) for t in texts]
    assert [codec.decode(m) for m in made] == [t.encode() for t in texts]


def test_every_part_of_unicode(codec, encoding):
    texts = [f"a{chr(c)} b {chr(c)} {chr(c)}x" for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000]
    assert [ids(m) for m in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_a_small_memory_changes_nothing(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 2)
    c = bpe.Codec(bpe.vocabulary(PATH), P.PATTERN)
    for text in ["one two three four", "five one two", "x" * 300]:
        assert ids(c.encode([text])[0]) == encoding.encode_ordinary(text)
    assert len(c.known) == 3


def test_offsets_and_split_characters(codec):
    text = "héllo 日本語 😀!"
    data = codec.encode([text])[0]
    first, last, split = codec.offsets(text, data)
    pieces = [codec.bytes_of[i] for i in ids(data)]
    at, want = 0, []
    for p in pieces:
        want.append((len(text.encode()[:at].decode(errors="ignore")), at + len(p)))
        at += len(p)
    assert at == len(text.encode()) and first[0] == 0 and last[-1] == len(text)
    assert split == sum(1 for k, ch in enumerate(text) if len({j for j, (a, b) in enumerate(zip(first, last, strict=True)) if a <= k < b}) > 1)
    assert codec.offsets("", b"")[2] == 0


def test_queries_of_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "text", "z"), (1, "text", "z"), (1, "text", "z"), (3, "long " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, PATH, P.PATTERN, ids=True).collect()
    assert len(got) == 6 and all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or 9, r.n_tokens, r.ids_sha256)), sorted(rows, key=lambda x: (x[0] or 9, len(x[1] or ""))), strict=True))
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    encoded = bpe.encode(df, PATH, P.PATTERN, offsets=True)
    assert encoded.columns == ["doc_id", "token_ids", "char_start", "char_end", "split_chars"]
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
