"""The streaming transducer against the tokenizers library and against whole-text merging."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierscope.llm import bpe_stream as bs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def tables():
    return bs.Tables(PATH)


def streamed(tables, text, size, **kw):
    e = bs.Encoder(tables, **kw)
    ids = [i for p in bs.pieces(text, size) for i in e.feed(p)]
    return ids + e.finish()


def test_pieces_equal_the_library(library, tables):
    rng = random.Random(5)
    parts = list("abc é日 \n\t'!?1٣² 　 ʼ𝒳") + [
        "'re", "'ll", "  ", "\n\n", " the", "tion", "<|endoftext|>", "<|endof", "࢏", "\U00010940"]
    for _ in range(400):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        for size, long, block in ((1, 5, 4), (7, 9, 16), (1 << 16, 1 << 12, 1 << 12)):
            assert streamed(tables, text, size, long=long, block=block) == want, (text, size)
        d = bs.Decoder(tables)
        assert "".join(d.feed([i]) for i in want) + d.finish() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("filler", [" ", "a", "ab", "=", "7", "日本", " \n", "abcdefghij", "!" * 3 + "-"])
def test_very_long_pretokens(library, tables, filler):
    for lead in ("", " ", "x ", "\n"):
        text = lead + filler * 30_000 + "z." * (lead == "x ")
        assert streamed(tables, text, 5000) == library.encode(text, add_special_tokens=False).ids


def test_classes_of_all_code_points(library, tables):
    text = "".join(f"a{c}1{c}!{c} {c}b" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff")
    for at in range(0, len(text), 900_000):
        part = text[at:at + 900_000]
        assert streamed(tables, part, 1 << 16) == library.encode(part, add_special_tokens=False).ids


class Toy(bs.Tables):
    """A random proper merge list over a small alphabet."""

    def __init__(self, rng, n):
        made, merges = [b"a", b"b", b"c"], []
        while len(merges) < n:
            pair = rng.choice(made), rng.choice(made)
            if pair not in merges and pair[0] + pair[1] not in made and len(pair[0] + pair[1]) < 12:
                merges.append(pair)
                made.append(pair[0] + pair[1])
        ids = {bytes([b]): b for b in range(256)} | {x + y: 256 + k for k, (x, y) in enumerate(merges)}
        self.setup(ids, merges)


def test_lookahead_suffices_for_random_merge_lists():
    rng = random.Random(11)
    for _ in range(150):
        toy = Toy(rng, rng.randint(1, 25))
        for _ in range(20):
            data = bytes(rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 250)))
            m = bs.Merger(toy, block=rng.randint(1, 9))
            assert [*m.feed(data), *m.finish()] == toy.merge(data)


def test_short_and_heap_merging_agree(tables):
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"etaoin srhld\n'") for _ in range(rng.randint(1, 60)))
        assert tables._short(data) == tables._heap([tables.byte[b] for b in data])


def test_words_are_bounded_and_frequent_ones_stay(tables, monkeypatch):
    monkeypatch.setattr(bs, "WORDS", 10)
    words = bs.Words()
    for k in range(200):
        assert streamed(tables, f"often w{k}", 100, words=words) == streamed(tables, f"often w{k}", 100)
        assert len(words.new) <= 10 and len(words.old) <= 10
        assert "often" in words.new or "often" in words.old


def test_memory_stays_constant(tables):
    e = bs.Encoder(tables)
    for _ in range(60):
        e.feed("abcdefgh" * 1000)
        assert len(e.text) <= bs.LONG and len(e.merger.held) <= tables.lookahead + 3 * bs.BLOCK


def test_broken_bytes_decode_as_the_library_does(library, tables):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50_257), tables.byte[rng.randrange(128, 256)]]) for _ in range(12)]
        d = bs.Decoder(tables)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_edge_rows(spark, library):
    texts = [None, "", "a", "the the", " " * 70_000, "x" * 70_000, "<|endoftext|>\n  a", "the the", "é日 𝒳 ²"]
    rows = [(t, None if i == 4 else min(i, 5), "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text string, doc_id bigint, n_tokens string")
    out = bs.encode(docs, PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in out.collect()), key=repr)
    want = []
    for t, i, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert sorted(r.decoded for r in bs.decode(out, PATH).collect()) == sorted(w[3] for w in want)
    assert bs.encode(docs.where("false"), PATH).count() == 0
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("X'61FF62'").alias("text"))
    assert bs.encode(broken, PATH).first().decoded == "a�b"


def test_query_equals_brute_force(spark, library):
    from tierscope.llm.queries import op12_streaming_bpe
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode(r[1], add_special_tokens=False).ids
        want.add((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in op12_streaming_bpe(spark, sf).collect()} == want
