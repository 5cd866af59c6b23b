"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and 5-word shingles (64-bit hashes) are columns of an
incidence matrix. Two documents link when ``100 * |A & B| >= 80 * |A | B|``.

1. Candidate blocks. A link needs ``ceil(0.8 n)`` common shingles of either
   document, so in any one order of all shingles it shares one of the first
   ``n - ceil(0.8 n) + 1`` of both (the size-derived prefix). The order is that of
   the hashes, but shingles that were found often (``frequent``) come last, the
   most frequent at the very end: a passage or line of many documents reaches a
   prefix only where a document has little else. Only prefix columns are shuffled. Inside a
   column, documents are joined when their sizes allow a link and 128 one-bit
   min-hashes agree in at least ``AGREE`` places (a link at exactly 0.8 agrees in
   115 on average and misses this bound with a probability under 1e-7); a
   column gives a spanning forest, never all its pairs. Columns of more than
   ``COLUMN_ROWS`` documents are split in blocks, and every pair of blocks meets
   in its own task. Connected candidates form a family.
2. Block products. The whole incidence rows of a family are multiplied in blocks
   of ``BLOCK`` documents, accumulating exact overlap counts over slices of
   columns; pairs whose sizes or counts stay below the bound are dropped. Each
   product gives a spanning forest of its links. Exact copies take part once.

A hot column or family is therefore spread over blocks of bounded size; links
between different texts are never thinned out, only not listed one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import (
    by_part, column, connected_components, dealt, pack, shuffle_partitions, stored, unpack)

WORDS = 5
BLOCK = 512
COLUMN_ROWS = 1 << 17  # entries of columns that meet in one task; more are split
BITS, AGREE = 128, 94
SLICE = 4096  # columns of the incidence matrix multiplied at a time
CHUNK = 1 << 18  # bytes of text that are hashed, and shingles that are sketched, at a time
SHORT = 64  # bytes of the longest word that is hashed in numpy
SEEN = 1 << 20, 3  # a shingle is frequent if so many (shingles, of documents one after the other) hold it so many times
TOLD, LATE = 1 << 13, 1 << 18  # so many such shingles are reported at a time, and come last, at most
SENT = 1 << 19  # prefix entries of a task that are packed at a time
SMALL = 64  # columns of up to so many sketches are compared together

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ADD = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_ODD = (np.random.default_rng(7).integers(1, 1 << 63, BITS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _words(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of lowered bytes, which begin with one
    blank and end with eight."""
    blank = _BLANK[np.frombuffer(low, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    h = _mixed(length.astype(np.uint64) * _ADD)
    on, k = np.arange(len(starts)), 0
    while len(on) and k < SHORT:
        v = eight[starts[on] + k] & _FIRST[np.minimum(length[on] - k, 8)]
        h[on] = _mixed(h[on] ^ v)
        k += 8
        on = on[length[on] > k]
    for i in on.tolist():
        h[i] = xxhash.xxh64_intdigest(low[starts[i]:starts[i] + length[i]])
    return starts, h


def _follow(h: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mixed(h * _ADD + after)


def _sets(raws: list[bytes], size: int) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(raw) + 1 for raw in raws]) + 1
    starts, h = _words(b"".join([b" ", b" ".join(raws).translate(_LOWER), b" " * 8]))
    at = np.concatenate([[0], np.searchsorted(starts, ends)])
    first, n = at[:-1], np.diff(at)
    out = h.copy()
    whole = max(0, len(h) - size + 1)
    for i in range(1, size):
        out[:whole] = _follow(out[:whole], h[i:i + whole])
    for k in range(1, size):
        few = first[n == k]
        if len(few):
            one = h[few]
            for i in range(1, k):
                one = _follow(one, h[few + i])
            out[few] = _mixed(one + np.uint64(k))
    taken = np.repeat(at[1:], n) - np.arange(len(h)) >= size  # the last words of a text start no shingle
    taken[first[(n > 0) & (n < size)]] = True
    flat = out[taken]
    cuts = np.concatenate([[0], np.cumsum(taken)])[at]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        flat[a:b].sort()
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[:len(flat)]
    new[cuts[:-1][n > 0]] = True
    flat, cuts = flat[new], np.concatenate([[0], np.cumsum(new)])[cuts]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield flat[a:b]


def shingles(raws: Iterable[bytes | None], size: int = WORDS) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles; with fewer words the
    whole sequence is one; without words none. Words are separated by blank, tab, line
    feed, vertical tab, form feed and carriage return; A-Z are lowered."""
    held, n = [], 0
    for raw in raws:
        held.append(raw or b"")
        n += len(held[-1])
        if n >= CHUNK:
            yield from _sets(held, size)
            held, n = [], 0
    if held:
        yield from _sets(held, size)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[:len(a)])
    return starts, np.diff(np.append(starts, len(a)))


def often(sets: list[np.ndarray], times: int) -> bytes | None:
    """Shingles that at least ``times`` of the sets hold, with their number of sets; if
    more than ``TOLD`` do, those that most hold, of equals those that come first."""
    flat = np.sort(np.concatenate(sets))
    starts, sizes = _runs(flat)
    gram, sizes = flat[starts[sizes >= times]], sizes[sizes >= times]
    if len(gram) > TOLD:
        most = np.sort(np.argsort(-sizes, kind="stable")[:TOLD])
        gram, sizes = gram[most], sizes[most]
    return pack(gram.astype("<u8"), sizes.astype("<i8")) if len(gram) else None


def frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of rows ``(often)``, ``LATE`` at most, sorted, and their
    places in the order of all shingles, 1 and up (0 is any other shingle)."""

    def entries(batches):
        for batch in batches:
            for payload in column(batch, "often"):
                gram, sets, _ = unpack(payload, "<u8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(gram.view("<i8")), pa.array(sets)], names=["gram", "sets"])

    summed = stored(found.mapInArrow(entries, "gram bigint, sets bigint").groupBy("gram").agg(
        F.sum("sets").alias("sets"), F.floor(8 * F.log2(F.sum("sets"))).alias("level")))
    least, many = None, 0
    for level, count in sorted(summed.groupBy("level").count().collect(), reverse=True):  # 8 levels for each power of 2
        many += count
        if many > LATE:
            break
        least = level
    top = summed.where(F.col("level") >= F.lit(least)).select("gram", "sets").toArrow()
    gram = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    place = np.empty(len(gram), np.int32)
    place[np.lexsort((gram, top.column("sets").to_numpy()))] = np.arange(1, len(gram) + 1)
    return gram[order], place[order]


def prefixes(sets: list[np.ndarray], n: np.ndarray, percent: int, late: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of all sets, one after the other, and their lengths."""
    size = n - -(-percent * n // 100) + 1
    flat, ends = np.concatenate(sets), np.cumsum(n)
    grams, places, maybe = late
    place = np.zeros(len(flat), np.int32)
    if len(grams):
        at = np.flatnonzero(maybe[flat & np.uint64(len(maybe) - 1)])
        where = np.minimum(np.searchsorted(grams, flat[at]), len(grams) - 1)
        place[at] = np.where(grams[where] == flat[at], places[where], 0)
    own = np.arange(len(flat)) - np.repeat(ends - n, n) < np.repeat(size, n)
    moved = np.unique(np.searchsorted(ends, np.flatnonzero(own & (place > 0)), "right"))
    for d in moved.tolist():
        a, b = ends[d] - n[d], ends[d]
        flat[a:b] = flat[a:b][np.argsort(place[a:b], kind="stable")]
    return flat[own], size


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-bit min-hashes (two words of 64 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    bits = np.empty((len(sets), BITS), np.uint8)
    for k in range(BITS):
        low = np.minimum.reduceat(flat * _ODD[k], starts)
        bits[:, k] = (_mixed(low) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _sizes_allow(a, b, percent):
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places two sketches (or one and many) agree."""
    return BITS - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _forest(n: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of one column's candidates, by their numbers: every newly reached
    document is compared with those of fitting size not reached yet."""
    out = []
    left = np.argsort(n, kind="stable")
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            lo = np.searchsorted(n[left], -(-percent * n[at] // 100))
            hi = np.searchsorted(n[left], 100 * n[at] // percent, "right")
            near = left[lo:hi]
            ok = _agree(sketch[near], sketch[at]) >= AGREE
            if ok.any():
                new = near[ok]
                out += [(int(at), int(i)) for i in new]
                reached += new.tolist()
                left = np.delete(left, lo + np.flatnonzero(ok))
    return out


def _lowest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the lowest node that pairs ``(a, b)`` connect it with."""
    low = np.arange(count)
    while True:
        at = np.minimum(low[a], low[b])
        now = low.copy()
        for end in (a, b):
            np.minimum.at(now, low[end], at)  # roots hang on the lower root
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _column_edges(gram, ids, n, sketch, percent) -> np.ndarray:
    """Candidate edges of all columns in one part."""
    order = np.argsort(gram, kind="stable")
    starts, sizes = _runs(gram[order])
    order = order[np.repeat(sizes > 1, sizes)]
    # equal sketches and sizes (copies above all) hang on the first of them
    same = _mixed(_mixed(sketch[order, 0] + n[order].astype(np.uint64) * _ADD) ^ sketch[order, 1])
    order = order[np.lexsort((ids[order], same, gram[order]))]
    gram, ids, n, sketch = gram[order], ids[order], n[order], sketch[order]
    equal = (gram[1:] == gram[:-1]) & (n[1:] == n[:-1]) & (sketch[1:] == sketch[:-1]).all(1)
    starts = np.flatnonzero(np.concatenate([[True], ~equal])[:len(gram)])
    edges = [np.stack([np.repeat(ids[starts], np.diff(np.append(starts, len(ids)))), ids], 1)]
    gram, ids, n, sketch = gram[starts], ids[starts], n[starts], sketch[starts]
    starts, sizes = _runs(gram)
    a, b = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        own = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        for at in range(0, len(own), max(1, (1 << 18) // len(i))):
            some = own[at:at + max(1, (1 << 18) // len(i)), None]
            x, y = (some + i).ravel(), (some + j).ravel()
            ok = _sizes_allow(n[x], n[y], percent)
            x, y = x[ok], y[ok]
            ok = _agree(sketch[x], sketch[y]) >= AGREE
            a.append(x[ok])
            b.append(y[ok])
    if a:
        edges.append(np.stack([ids[_lowest(len(ids), np.concatenate(a), np.concatenate(b))], ids], 1))
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = slice(at, at + size)
        found = _forest(n[own], sketch[own], percent)
        if found:
            edges.append(ids[own][np.array(found)])
    e = np.concatenate(edges)
    e = np.sort(e[e[:, 0] != e[:, 1]], 1)
    return np.unique(e, axis=0) if len(e) else e


def _pack_entries(gram, ids, n, marks) -> bytes:
    """Entries of one part; hashes and sketches don't get smaller, so they aren't compressed."""
    rest = pack(np.diff(ids, prepend=0).astype("<i8"), n.astype("<i4"))
    return b"".join([len(gram).to_bytes(4, "little"), gram.astype("<u8").tobytes(), marks.astype("<u8").tobytes(), rest])


def _unpack_entries(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    count = int.from_bytes(payload[:4], "little")
    step, n, _ = unpack(payload[4 + 24 * count:], "<i8", "<i4")
    return (np.frombuffer(payload, "<u8", count, 4), np.cumsum(step), n.astype(np.int64),
            np.frombuffer(payload, "<u8", 2 * count, 4 + 8 * count).reshape(-1, 2))


def _pairs(e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0], pa.int64()), pa.array(e[:, 1], pa.int64())],
                                      names=["a", "b"])


def split_columns(packed: DataFrame, percent: int, limit: int) -> DataFrame:
    """Candidate edges of columns in crowded parts: every column by itself, and a
    column of more than ``limit`` entries in blocks of about that many, each pair
    of blocks in its own group of rows."""

    def entries(batches):
        for batch in batches:
            for payload in column(batch, "payload"):
                gram, ids, n, marks = _unpack_entries(payload)
                marks = np.ascontiguousarray(marks.T).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view("<i8")), pa.array(ids), pa.array(n.astype(np.int32)),
                     pa.array(marks[0]), pa.array(marks[1])], names=["gram", "doc_id", "n", "s0", "s1"])

    single = packed.mapInArrow(entries, "gram bigint, doc_id bigint, n int, s0 bigint, s1 bigint")
    hot = single.groupBy("gram").agg(F.count("*").alias("entries")).where(F.col("entries") > limit).select(
        "gram", F.ceil(F.col("entries") / limit).cast("int").alias("blocks"))
    placed = single.join(hot, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sent = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "doc_id", "n", "s0", "s1")

    def meet(batches):
        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held = np.concatenate([held, new])
            key = held[:, :3]
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
            whole = np.searchsorted(group, group[-1])  # the last group may go on in the next batch
            if whole:
                yield _pairs(edges(held[:whole], group[:whole]))
                held = held[whole:]
        if len(held):
            yield _pairs(edges(held, np.zeros(len(held), np.int64)))

    def edges(rows, group):
        return _column_edges(group, rows[:, 3], rows[:, 4],
                             np.ascontiguousarray(rows[:, 5:]).view(np.uint64), percent)

    return (sent.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
            .mapInArrow(meet, "a bigint, b bigint"))


def candidates(rows: DataFrame, percent: int, size: int, parts: int, limit: int = COLUMN_ROWS,
               late: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.int32))) -> DataFrame:
    """Candidate edges ``(a, b)`` from rows ``(doc_id, raw)``. Columns are dealt
    into ``parts``; those of a part with more than ``limit`` entries are split.
    ``late`` is what ``frequent`` gives."""

    def send(batches):
        maybe = np.zeros(1 << 22, bool)  # which last bits the late shingles have
        maybe[late[0] & np.uint64(len(maybe) - 1)] = True
        held, ids, sets, total = [], [], [], 0

        def taken():
            n = np.array([len(s) for s in sets], np.int64)
            gram, length = prefixes(sets, n, percent, (*late, maybe))
            own = np.array(ids, np.int64), n, sketches(sets)
            ids.clear()
            sets.clear()
            return gram, *[np.repeat(x, length, axis=0) for x in own]

        def packed():
            gram, ids, n, marks = (np.concatenate(x) for x in zip(*held))
            held.clear()
            of = (_mixed(gram) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(of, kind="stable")
            starts, sizes = _runs(of[order])
            dealt_out = np.split(order, starts[1:])
            for at in range(0, len(dealt_out), 64):  # small batches, for the memory of the JVM
                some = dealt_out[at:at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(of[o[0]]) for o in some], pa.int32()), pa.array(sizes[at:at + 64]),
                     pa.array([_pack_entries(gram[o], ids[o], n[o], marks[o]) for o in some], pa.binary())],
                    names=["part", "entries", "payload"])

        for batch in batches:
            for i, s in zip(column(batch, "doc_id"), shingles(column(batch, "raw"), size)):
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    total += len(s)
                if total >= CHUNK:
                    held.append(taken())
                    total = 0
                    if sum(len(x[0]) for x in held) >= SENT:
                        yield from packed()
        if sets:
            held.append(taken())
        if held:
            yield from packed()

    def meet(batches):
        for _, payloads in by_part(batches):
            yield _pairs(_column_edges(*(np.concatenate(x) for x in zip(*map(_unpack_entries, payloads))), percent))

    packed = stored(rows.mapInArrow(send, "part int, entries bigint, payload binary"))
    crowded = packed.groupBy("part").agg(F.sum("entries").alias("n")).where(F.col("n") > limit).select("part")
    if crowded.isEmpty():
        return dealt(packed.select("part", "payload")).mapInArrow(meet, "a bigint, b bigint").distinct()
    crowded = F.broadcast(stored(crowded))  # at most ``parts`` numbers
    usual = packed.join(crowded, "part", "left_anti").select("part", "payload")
    return dealt(usual).mapInArrow(meet, "a bigint, b bigint").union(split_columns(
        packed.join(crowded, "part", "left_semi").select("payload"), percent, limit)).distinct()


def block_links(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Links between the sets of one block (``y`` None) or of two: a boolean
    matrix, from overlap counts accumulated over slices of columns."""
    both = x if y is None else x + y
    sizes = np.array([len(s) for s in both])
    _, col, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = count > 1  # a column of one document adds to no overlap
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a = len(x)
    overlap = np.zeros((a, a if y is None else len(y)), np.float32)
    width = int(shared.sum())
    for start in range(0, width, SLICE):
        lo, hi = np.searchsorted(col, [start, start + SLICE])
        m = np.zeros((len(both), min(SLICE, width - start)), np.float32)
        m[row[lo:hi], col[lo:hi] - start] = 1
        overlap += m[:a] @ (m[:a] if y is None else m[a:]).T
    n, k = sizes[:a, None], (sizes[:a] if y is None else sizes[a:])[None, :]
    links = _sizes_allow(n, k, percent) & (100 * overlap >= percent * (n + k - overlap))
    if y is None:
        np.fill_diagonal(links, False)
    return links


def _spanning(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Forest edges of a link matrix: pairs of row and column numbers."""
    out = []
    if square:
        left = np.ones(len(links), bool)
        for s in range(len(links)):
            if left[s]:
                left[s] = False
                stack = [s]
                while stack:
                    at = stack.pop()
                    new = np.flatnonzero(links[at] & left)
                    left[new] = False
                    out += [(at, int(j)) for j in new]
                    stack += new.tolist()
        return out
    rows, cols = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    for s in range(links.shape[0]):
        if not rows[s]:
            continue
        rows[s] = False
        stack = [(True, s)]
        while stack:
            is_row, at = stack.pop()
            line, left = (links[at], cols) if is_row else (links[:, at], rows)
            new = np.flatnonzero(line & left)
            left[new] = False
            out += [(at, int(j)) if is_row else (int(j), at) for j in new]
            stack += [(not is_row, int(j)) for j in new]
    return out


def family_links(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Links ``(a, b)`` from rows ``(family, blocks, doc_id, raw)``: each family's
    block products, every pair of blocks in its own group of rows."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    sent = rows.withColumn("own", own).select(
        "family", "doc_id", "raw", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") > F.col("other")).alias("second"), "doc_id", "raw")

    def multiply(batches):
        def product(key, held):
            _, i, j = key
            sides = [[h for h in held if not h[0]], [h for h in held if h[0]]]
            if i == j:
                found = _spanning(block_links([h[2] for h in held], None, percent), True)
                return [(held[p][1], held[q][1]) for p, q in found]
            if not sides[0] or not sides[1]:
                return []
            found = _spanning(block_links([h[2] for h in sides[0]], [h[2] for h in sides[1]], percent), False)
            return [(sides[0][p][1], sides[1][q][1]) for p, q in found]

        now, held, out = None, [], []
        for batch in batches:
            for f, i, j, second, doc, own in zip(*(column(batch, c) for c in (
                    "family", "i", "j", "second", "doc_id")), shingles(column(batch, "raw"), size)):
                if (f, i, j) != now:
                    out += product(now, held) if len(held) > 1 else []
                    now, held = (f, i, j), []
                held.append((second, doc, own))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += product(now, held) if len(held) > 1 else []
        yield _edges(out)

    return (sent.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
            .mapInArrow(multiply, "a bigint, b bigint"))


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)],
                                      names=["a", "b"])


def join(docs: DataFrame, percent: int = 80, size: int = WORDS, block: int = BLOCK,
         column_rows: int = COLUMN_ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    component_id is the smallest doc_id reachable by links. A text that is null
    or has no words has no shingles and links with nothing; so does a row with a
    null doc_id (its component is null). Rows that share a doc_id are one node.
    Exact copies link with each other. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))

    def count(batches):
        held, n = [], 0
        for batch in batches:
            counts, digests = [], []
            for s in shingles(column(batch, "raw"), size):
                counts.append(len(s))
                digests.append(xxhash.xxh128_digest(s.tobytes()))
                if len(s):
                    held.append(s)
                    n += len(s)
                if n >= SEEN[0]:
                    yield found(held)
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.nulls(len(counts), pa.binary())], names=["doc_id", "n_shingles", "same", "often"])
        if held:
            yield found(held)

    def found(sets):
        payload = [p for p in [often(sets, SEEN[1])] if p]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(payload), pa.int64()), pa.nulls(len(payload), pa.int64()), pa.nulls(len(payload), pa.binary()),
             pa.array(payload, pa.binary())], names=["doc_id", "n_shingles", "same", "often"])

    counted = stored(rows.mapInArrow(count, "doc_id bigint, n_shingles bigint, same binary, often binary"))
    late = frequent(counted.where("often is not null").select("often"))
    counted = counted.where("often is null").select("doc_id", "n_shingles", "same")
    named = counted.where("doc_id is not null and n_shingles > 0")
    copies = named.groupBy("same").agg(F.min("doc_id").alias("first"))
    copied = named.join(copies, "same").select("doc_id", "first")
    near = connected_components(candidates(
        rows.where("doc_id is not null"), percent, size, 8 * shuffle_partitions(docs.sparkSession), column_rows, late))
    # one document of each set of copies stands for them in the products
    stands = near.join(copies, F.col("node") == F.col("first"), "left_semi")
    families = stored(stands.groupBy("component").agg(F.count("*").alias("members")).where("members > 1"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    needed = stands.join(families, "component").select(
        F.col("component").alias("family"), blocks.alias("blocks"), F.col("node").alias("doc_id"))
    links = family_links(rows.join(needed, "doc_id").select("family", "blocks", "doc_id", "raw"), percent, size)
    linked = connected_components(links.union(copied.select("doc_id", "first")))
    return counted.join(linked, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest
    doc_id, of rows that share it the one whose text hashes lowest. A document is an id
    with its text, so rows that share an id but not a text are compared like any others;
    of rows equal in both, the one whose whole row hashes lowest stays. Rows without an
    id stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # own columns can't clash with the ones below
    named = docs.where("doc_id is not null").select("doc_id", "text", whole.alias("row"))
    text = F.xxhash64("text")
    clashing = stored(named.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select(
        F.col("doc_id").alias("clashing")))
    # ids of one text stay as they are: they pack better than hashes
    node = F.col("doc_id").cast("bigint")
    if not clashing.isEmpty():
        named = named.join(clashing, named["doc_id"] == clashing["clashing"], "left")
        node = F.when(F.col("clashing").isNull(), node).otherwise(F.xxhash64("doc_id", "text"))
    ids = named.select("doc_id", node.alias("node")).distinct()
    found = join(named.select(node.alias("doc_id"), "text"), percent, size).select(
        F.col("doc_id").alias("node"), "component_id").distinct()
    first = ids.join(found, "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(
        "first.node")
    kept = named.select(node.alias("node"), "row").join(first, "node", "left_semi").groupBy("node").agg(
        F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))
