"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are inserted into one automaton over word
numbers. Training texts stream through it: after every word the state gives the
longest match that ends there. A match of ``window`` words or more is hit whole;
an item with fewer words is hit where it occurs whole.

An automaton holds at most ``shard_words`` benchmark words and one item (its size
bound; equal items count once); a larger benchmark is cut into several shards. The
documents are read once, without a shuffle: a worker cuts about ``CHUNK_BYTES`` of
text into numbered words and streams them through the shards' automata in turn,
holding one automaton at a time and the compressed items of the others.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import arrow_schema, replaced, stored, words

WINDOW = 10
SHARD_WORDS = 200_000
CHUNK_BYTES = 8 << 20
BUCKETS = 4096  # in which items are counted before they are cut into shards
MAX_COVERAGE = 0.5

_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before lower-casing
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the words' places in the raw text


class Automaton:
    """Suffix automaton of several word sequences.

    ``items``: pairs of (item id, list of words). For every state: ``next``
    (word number to state), ``link`` (suffix link), ``size`` (longest string).
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[tuple[int, list[int]]] = []
        coded = []
        for item, own in items:
            seq = [self.number.setdefault(w, len(self.number)) for w in own]
            if seq:
                coded.append((item, seq))
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # item ids of every state whose string is a window, and of whole short items
        self.items: dict[int, set] = {}
        self.whole: dict[int, set] = {}
        self.least = window
        for item, seq in coded:
            state = size = 0
            short = len(seq) < window
            for w in seq:
                state, size = self.next[state][w], size + 1
                if not short and size >= window:
                    state = self._suffix(state, window)
                    size = window
                    self.items.setdefault(state, set()).add(item)
            if short:
                self.whole.setdefault(state, set()).add(item)
                self.least = min(self.least, len(seq))
        # nearest state on the suffix path (itself included) that is a whole short item
        self.near = [0] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.near[s] = s if s in self.whole else self.near[self.link[s]]
        pairs = {(a, b) for _, seq in coded for a, b in zip(seq, seq[1:])}
        self.bigrams = np.array(sorted(a * len(self.number) + b for a, b in pairs), np.int64)

    def _suffix(self, state: int, size: int) -> int:
        while self.size[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w)
        new = len(self.size)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        return new

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of known words whose neighbouring pairs all occur in the
        benchmark, long enough to hold a window: no match crosses their ends."""
        ok = codes >= 0
        n = len(codes)
        joined = ok[:-1] & ok[1:]
        if joined.any():
            at = np.flatnonzero(joined)
            keys = codes[at] * len(self.number) + codes[at + 1]
            found = np.searchsorted(self.bigrams, keys)
            found[found == len(self.bigrams)] = 0
            joined[at] = (self.bigrams[found] == keys) if len(self.bigrams) else False
        starts = np.flatnonzero(ok & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(ok & ~np.concatenate([joined, [False]])) + 1
        for k in np.flatnonzero(stops - starts >= self.least):
            yield int(starts[k]), min(int(stops[k]), n)

    def codes(self, own: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those that no item has."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in own), np.int64, len(own))

    def stream(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans (word positions, end excluded, merged), items with a window
        that occurs, and the longest match that is a hit, of a text given by its words' numbers."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        for a, b in self.runs(codes):
            state = size = 0
            for j, w in enumerate(codes[a:b].tolist(), a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.size[state]
                if w in self.next[state]:
                    state, size = self.next[state][w], size + 1
                first = j
                if size >= self.window:
                    first = j - size
                    items |= self.items[self._suffix(state, self.window)]
                s = state if state in self.whole and size >= self.size[state] else self.near[self.link[state]] if state else 0
                while s > 0:
                    items |= self.whole[s]
                    first = min(first, j - self.size[s])
                    s = self.near[self.link[s]]
                if first < j:
                    longest = max(longest, j - first)
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, j))
        return spans, items, longest


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit words and what stands between them."""
    places = [m.span() for m in _WORD_BYTES.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` plus ``n_words bigint``, ``n_hit bigint``, ``spans
    array<struct<first,stop>>`` (word positions), ``items array<bigint>`` (sorted
    distinct ids of items with a window that occurs), ``longest int`` (words of the
    longest hit match, 0 without one) and ``kept_text string`` (hit words cut out).

    One row per input row; columns of ``docs`` with these names are replaced. A
    null text has no words and stays null; an item with a null id marks words
    but isn't listed; items without words, and an empty benchmark, mark nothing;
    repeated items count once by their id.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
                             F.col("text").cast("binary").alias("raw")).where("raw is not null")
    # equal rows mark the same words; the operator's own words, so a shard is as large as it says
    size = F.regexp_count(F.col("raw").cast("string"), F.lit(_WORD_PATTERN))
    items = bench.distinct().select("item_id", "raw", size.cast("bigint").alias("n")).where("n > 0")
    held = [spark.sparkContext.broadcast(_packed(own)) for own in shards(items, shard_words)]
    df = replaced(docs, {
        "n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"),
        "spans": F.array().cast("array<struct<first:int,stop:int>>"),
        "items": F.array().cast("array<bigint>"), "longest": F.lit(0),
        "kept_text": F.col("text")})
    return _pass(df, held, window)


def shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items ``(item_id, raw, n)`` cut by the running sum of their words ``n``; one
    shard at a time reaches the driver, at most ``shard_words`` words and one item."""
    items = stored(items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "raw"), F.lit(BUCKETS))))
    inside = Window.partitionBy("bucket").orderBy("item_id", "raw")
    # at most BUCKETS rows
    before = items.groupBy("bucket").agg(F.sum("n").alias("all")).select(
        "bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    place = F.col("before") + F.sum("n").over(inside) - F.col("n")
    dealt = stored(items.join(F.broadcast(before), "bucket").select(
        "item_id", "raw", F.floor(place / shard_words).alias("shard")))
    for row in dealt.select("shard").distinct().orderBy("shard").collect():
        own = dealt.where(F.col("shard") == row["shard"]).select("item_id", "raw")
        yield [(r["item_id"], words(bytes(r["raw"]))) for r in own.collect()]


def _packed(own: list[tuple[int, list[bytes]]]) -> bytes:
    return zlib.compress(pickle.dumps([(item, b" ".join(w)) for item, w in own]), 1)


_last: list = [None, None, None]  # a worker's last shard, window and automaton, kept for its next task


def _automaton(packed: bytes, window: int) -> Automaton:
    if _last[:2] != [packed, window]:
        _last[:] = [None] * 3
        own = [(item, w.split()) for item, w in pickle.loads(zlib.decompress(packed))]
        _last[:] = [packed, window, Automaton(own, window)]
    return _last[2]


def _pass(df: DataFrame, held: list, window: int) -> DataFrame:
    schema, arrow = df.schema, arrow_schema(df.schema)
    names = df.columns

    def chunk(batch: pa.RecordBatch, texts: list, raws: list[bytes]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}  # the chunk's words are numbered once for all shards
        coded = [np.fromiter((known.setdefault(w, len(known)) for w in own), np.int32, len(own))
                 for own in map(words, raws)]
        spans, items, longest = [[] for _ in raws], [set() for _ in raws], [0] * len(raws)
        for shard in held:
            automaton = _automaton(shard.value, window)
            number = automaton.codes(list(known))
            for i, local in enumerate(coded):
                hit, ids, length = automaton.stream(number[local])
                if hit:
                    spans[i] = _merged(spans[i] + hit) if spans[i] else hit
                    items[i] |= ids
                longest[i] = max(longest[i], length)
        cols = dict(zip(names, batch.columns))
        cols |= {
            "n_words": [len(c) for c in coded], "n_hit": [sum(b - a for a, b in hit) for hit in spans],
            "spans": [[{"first": a, "stop": b} for a, b in hit] for hit in spans],
            "items": [sorted(i for i in ids if i is not None) for ids in items], "longest": longest,
            "kept_text": [_cut(raw, hit).decode("utf-8", "surrogateescape") if hit else text
                          for text, raw, hit in zip(texts, raws, spans)]}
        return pa.RecordBatch.from_arrays(
            [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type)
             for f in arrow], schema=arrow)

    def run(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            first, texts, raws, size = 0, [], [], 0
            for i in range(batch.num_rows):
                text = column[i].as_py()
                texts.append(text)
                raws.append(b"" if text is None else text.encode("utf-8", "surrogateescape"))
                size += len(raws[-1])
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    yield chunk(batch.slice(first, i + 1 - first), texts, raws)
                    first, texts, raws, size = i + 1, [], [], 0

    return df.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; documents with more than
    ``max_coverage`` of their words hit go. Columns stay as they are, except
    ``n_chars`` (if there), which follows a cut text. Clean rows are unchanged."""
    found = scan(docs, benchmark, window)
    kept = found.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    cut = F.col("n_hit") > 0
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(cut, F.length("kept_text").cast(kind)).otherwise(F.col("n_chars")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return kept.select(*out)
