"""Byte-level BPE against the tokenizer library, as a brute-force version."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tierscope.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "text string, doc_id bigint, chunk string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})


def test_merge_equals_the_library(library):
    ranks = bpe.load_ranks(VOCABULARY)
    split = bpe.splitters(public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aab é日\n 1'sʼ𝒳²") for _ in range(rng.randint(0, 200)))
        ids = [t for w in bpe._pretokens(text.encode(), *split) for t in bpe.merge(w.encode(), ranks)]
        assert ids == library.encode_ordinary(text)


def test_edge_rows(spark, library):
    texts = [None, "", "a", "the the the", "x" * 50_000, "Ünï \n\n code 日本 𝒳 ²", "the the the"]
    rows = [(t, None if i == 4 else min(i, 5), "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in out.collect()), key=repr)
    want = sorted(((i, len(x := library.encode_ordinary(t or "")), tuple(x), (t or "").encode())
                   for t, i, _ in rows), key=repr)
    assert got == want
    again = bpe.decode(out, VOCABULARY).collect()
    assert sorted((bytes(r.decoded) for r in again)) == sorted((t or "").encode() for t in texts)
    assert bpe.encode(docs.where("false"), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_query_equals_brute_force(spark, library):
    from tierscope.llm.queries import op10_byte_bpe
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in op10_byte_bpe(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode_ordinary(r[1])
        want.add((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    assert got == want


def test_texts_that_are_not_utf8():
    """Numbering in columns keeps bytes that no string holds, and the order of first use."""
    split = bpe.splitters(public_tokenizers.PATTERN)
    texts = [b"", b"the \xff\xfe the", "the é 日".encode(), b"\xed\xa0\x80 a", b""]
    distinct, numbers, sizes = bpe._numbered(texts, split)
    words = distinct.to_pylist()
    assert len(set(words)) == len(words)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert b"".join(words[i] for i in numbers[at:at + n].tolist()) == t
        at += n
    firsts = list(dict.fromkeys(numbers.tolist()))
    assert firsts == list(range(len(words)))


@pytest.mark.parametrize("digests", [False, True])
def test_texts_gathered_in_blocks(spark, library, monkeypatch, digests):
    """Documents longer and shorter than a block, equal chunks among them."""
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 200)
    rng = random.Random(7)
    texts = ["".join(rng.choice("aab é日\n 1's") for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows], "doc_id bigint, text string").coalesce(1)
    got = sorted(tuple(r) for r in bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, digests=digests).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), *((sha(",".join(map(str, ids)).encode()), sha(t.encode())) if digests else (ids, t.encode()))))
    assert got == sorted([*want, *want])
