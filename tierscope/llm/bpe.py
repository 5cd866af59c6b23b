"""Byte-level BPE encoding and decoding through one shuffle of distinct words.

Texts are cut into pre-tokens with their positions. A chunk of documents
(``CHUNK_BYTES`` of text) sends each distinct pre-token once, packed by a hash
of the pre-token, so all chunks' copies of a pre-token meet in one partition,
where it is merged once. The ids travel back to the chunks, and each chunk's
documents are reassembled by position. A partition never needs more than its
own distinct pre-tokens and one chunk. Hot words cost one packed entry per
chunk, so no key is skewed.

The chunk's texts reach the reassembly by a second reading of the documents
instead of carrying them through the word shuffle; a chunk is named by a digest
of its contents, so a source that returns other rows on the second reading
fails loudly, and equal chunks share their ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import column, pack, shuffle_partitions, unpack

CHUNK_BYTES = 8 << 20
BLOCK_WORDS = 1 << 18  # pre-tokens whose bytes are gathered at a time, or one text's
PLAIN_LIMIT = 0x240  # code points below it start with a byte under 0xC9 in UTF-8

_WORDS = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("payload", pa.binary())])
_BACK = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("payload", pa.binary())])


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file: base64 bytes and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: repeatedly join the adjacent pair of lowest rank
    (leftmost first). A heap over a linked list keeps long pieces near-linear."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))       # end[i]: where the part that starts at i stops
    before = list(range(-1, n - 1))   # start of the part in front
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1)
            if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def _class(member) -> str:
    return "".join(rf"\u{c:04x}" for c in range(PLAIN_LIMIT) if member(chr(c)))


def splitters(pattern: str):
    """The pattern for any text, and the same pattern with its Unicode classes
    written out for texts whose code points all lie under ``PLAIN_LIMIT``,
    which the standard library's engine runs in less than half the time."""
    general = regex.compile(pattern)
    letters = _class(lambda c: unicodedata.category(c)[0] == "L")
    numbers = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: regex.match(r"\s", c) is not None)
    plain = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
             .replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
             .replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
    return general, (re.compile(plain) if r"\p" not in plain else general)


def _pretokens(raw: bytes, general, plain) -> list[str]:
    if not raw:
        return []
    simple = int(np.frombuffer(raw, np.uint8).max()) < 0xC9
    return (plain if simple else general).findall(raw.decode("utf-8", "surrogateescape"))


def _chunks(batches) -> Iterator[tuple[str, list, list[bytes]]]:
    """Consecutive documents of the partition, about ``CHUNK_BYTES`` at a time."""
    ids, texts, held = [], [], 0

    def name() -> str:
        h = hashlib.blake2b(digest_size=16)
        for i, t in zip(ids, texts):
            h.update(f"{i} {len(t)} ".encode())
            h.update(t)
        return h.hexdigest()

    for batch in batches:
        for i, t in zip(column(batch, "doc_id"), column(batch, "raw")):
            t = t or b""
            ids.append(i)
            texts.append(t)
            held += len(t) + 16
            if held >= CHUNK_BYTES:
                yield name(), ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield name(), ids, texts


def _numbered(texts: list[bytes], split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens in order of first use, all texts as their numbers, and
    how many each text has."""
    own = []
    for t in texts:
        words = _pretokens(t, *split)
        try:
            own.append(pa.array(words, pa.large_string()).cast(pa.large_binary()))
        except UnicodeEncodeError:  # bytes that aren't UTF-8
            own.append(pa.array([w.encode("utf-8", "surrogateescape") for w in words], pa.large_binary()))
    coded = pa.concat_arrays(own).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype("<u4"), np.array([len(x) for x in own], "<u4")


def _bytes_of(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large_binary array end to end, and where each string begins (and the last one ends)."""
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int64, len(strings) + 1, 8 * strings.offset) if len(strings) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), ends


def _joined(strings: pa.Array, counts: np.ndarray) -> pa.Array:
    """Neighbouring strings joined, ``counts`` of them at a time."""
    data, ends = _bytes_of(strings)
    at = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """The four bytes of each number apart, lowest first; so they compress better."""
    return [(numbers >> np.uint32(shift)).astype(np.uint8) for shift in (0, 8, 16, 24)]


def encode(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = False,
           parts: int | None = None) -> DataFrame:
    """Encode every whole text, then decode the ids again.

    Returns one row per input row: ``doc_id``, ``n_tokens`` and either
    ``ids array<int>`` with ``decoded binary`` or, with ``digests``, their
    SHA-256 ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256``. A null or empty text has no ids; a null or repeated
    doc_id is kept as it stands; other columns of ``docs`` are not read.
    ``vocabulary`` is a rank file readable on every machine.
    """
    spark = docs.sparkSession
    # several parts for each partition, so that hashing them deals evenly
    parts = parts or 8 * shuffle_partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))

    def send_words(batches):
        split = splitters(pattern)
        for chunk, _, texts in _chunks(batches):
            distinct, _, _ = _numbered(texts, split)
            of = np.array([zlib.crc32(w) % parts for w in distinct.to_pylist()], np.int64)
            order = np.argsort(of, kind="stable")
            data, at = _bytes_of(distinct.take(pa.array(order)))
            sizes = np.diff(at).astype("<u4")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
            out = [(int(of[order[a]]), pack(order[a:b].astype("<u4"), sizes[a:b], tail=bytes(data[at[a]:at[b]])))
                   for a, b in zip(edges.tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(out)), pa.array([p for p, _ in out], pa.int32()),
                 pa.array([x for _, x in out], pa.binary())], schema=_WORDS)

    def encode_words(batches):
        ranks = load_ranks(vocabulary)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            chunks, out = [], []
            for chunk, payload in zip(column(batch, "chunk"), column(batch, "payload")):
                own, sizes, tail = unpack(payload, "<u4", "<u4")
                counts, ids, at = [], [], 0
                for s in sizes.tolist():
                    w = tail[at:at + s]
                    at += s
                    if (x := known.get(w)) is None:
                        x = known[w] = merge(w, ranks)
                    counts.append(len(x))
                    ids += x
                chunks.append(chunk)
                out.append(pack(own, np.array(counts, "<u4"), np.array(ids, "<u4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.string()), pa.array([0] * len(out), pa.int32()),
                 pa.array(out, pa.binary())], schema=_BACK)

    def send_texts(batches):
        split = splitters(pattern)
        for chunk, ids, texts in _chunks(batches):
            distinct, seq, sizes = _numbered(texts, split)
            tail = pa.array(ids, docs_id).to_pandas().isna().to_numpy()
            body = np.array([0 if i is None else i for i in ids], "<i8") if whole else None
            named = body.tobytes() if whole else "\0".join(map(str, ids)).encode()
            payload = pack(sizes, *_planes(seq), np.array([len(distinct)], "<u4"),
                           tail=np.packbits(tail).tobytes() + named)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([1], pa.int32()), pa.array([payload], pa.binary())],
                schema=_BACK)

    whole = kind in ("bigint", "int", "smallint", "tinyint")
    docs_id = pa.int64() if whole else pa.string()
    out_schema = f"doc_id {'bigint' if whole else 'string'}, n_tokens bigint, " + (
        "ids_sha256 string, decoded_sha256 string" if digests
        else "ids array<int>, decoded binary")
    out_arrow = pa.schema([("doc_id", docs_id), ("n_tokens", pa.int64())] + (
        [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests
        else [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))

    def reassemble(batches):
        table = {r: b for b, r in load_ranks(vocabulary).items()}
        span = range(max(table, default=-1) + 1)
        # bytes and decimal digits by token id
        tables = (pa.array([table.get(r) for r in span], pa.large_binary()),
                  pa.array([b"%d," % r for r in span], pa.large_binary()))
        name, got, words = None, [], None
        for batch in batches:
            for chunk, k, payload in zip(column(batch, "chunk"), column(batch, "kind"),
                                         column(batch, "payload")):
                if chunk != name:
                    name, got, words = chunk, [], None
                if k == 0:
                    got.append(unpack(payload, "<u4", "<u4", "<u4")[:3])
                    continue
                sizes, *planes, n, tail = unpack(payload, "<u4", "u1", "u1", "u1", "u1", "<u4")
                seq = np.stack(planes, 1).reshape(-1).view("<u4")
                if words is None:
                    words, got = _words(got, tables), []
                place = words[0]
                if len(place) != int(n[0]) or (place < 0).any():
                    raise ValueError(f"the documents changed between two readings: {chunk} has {(place >= 0).sum()} of {int(n[0])} pre-tokens")
                yield from _documents(sizes, seq, tail, *words)

    def _words(got, tables):
        """Where each pre-token lies in the arrays that follow: its number of ids, its bytes,
        and its ids as digits (each with a comma) or numbers."""
        own, counts, flat = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, "<u4") for k in range(3))
        place = np.full(int(own.max()) + 1 if len(own) else 0, -1)
        place[own] = np.arange(len(own))
        ids = (_joined(tables[1].take(pa.array(flat)), counts) if digests
               else pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]),
                                                  pa.array(flat.astype(np.int32))))
        return place, counts.astype(np.int64), _joined(tables[0].take(pa.array(flat)), counts), ids

    def _documents(sizes, seq, tail, place, counts, data, ids):
        n = len(sizes)
        cut = (n + 7) // 8
        null = np.unpackbits(np.frombuffer(tail[:cut], np.uint8), count=n).astype(bool)
        names = (np.frombuffer(tail[cut:], "<i8").tolist() if whole
                 else tail[cut:].decode().split("\0"))
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        a = 0
        while a < n:
            b = min(a + 1000, max(a + 1, int(np.searchsorted(at, at[a] + BLOCK_WORDS, "right")) - 1))
            own = place[seq[at[a]:at[b]]]
            edges = at[a:b + 1] - at[a]
            tokens = np.concatenate([[0], np.cumsum(counts[own])])[edges]
            raw, ends = _bytes_of(data.take(pa.array(own)))
            raw = [raw[x:y] for x, y in zip(ends[edges[:-1]].tolist(), ends[edges[1:]].tolist())]
            if digests:
                digits, ends = _bytes_of(ids.take(pa.array(own)))
                first = [hashlib.sha256(digits[x:max(x, y - 1)]).hexdigest()
                         for x, y in zip(ends[edges[:-1]].tolist(), ends[edges[1:]].tolist())]
                second = [hashlib.sha256(x).hexdigest() for x in raw]
            else:
                first = pa.ListArray.from_arrays(tokens.astype(np.int32), ids.take(pa.array(own)).flatten())
                second = [bytes(x) for x in raw]
            cols = ([None if null[j] else names[j] for j in range(a, b)], np.diff(tokens), first, second)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, out_arrow)], schema=out_arrow)
            a = b

    sent = rows.mapInArrow(send_words, "chunk string, part int, payload binary")
    back = sent.repartition("part").mapInArrow(
        encode_words, "chunk string, kind int, payload binary")
    again = rows.mapInArrow(send_texts, "chunk string, kind int, payload binary")
    return (back.union(again).repartition("chunk").sortWithinPartitions("chunk", "kind")
            .mapInArrow(reassemble, out_schema))


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, decoded binary)`` from ``(doc_id, ids array<int>)`` through the
    token-byte table, whose size the vocabulary file fixes. Null ids give null;
    an id outside the vocabulary raises an error."""
    def run(batches):
        table = {r: b for b, r in load_ranks(vocabulary).items()}
        for batch in batches:
            out = [None if x is None else b"".join([table[t] for t in x])
                   for x in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(out, pa.binary())],
                names=["doc_id", "decoded"])
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
