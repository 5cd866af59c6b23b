"""Removal of byte strings that repeat, with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same or another document.

1. Anchors. Of the ``GRAM``-byte hashes inside a string the smallest (leftmost)
   is its anchor, so equal strings have equal anchors at equal offsets. Every
   start belongs to one anchor; neighbouring starts with the same anchor form a
   run, whose context is the bytes that its strings cover. Equal neighbours (in
   text of a short period) are one range of runs. Contexts are counted by a grouped
   sum; an anchor that occurs once holds no repeat, and runs with equal contexts
   repeat whole. This leaves anchors with differing contexts.
2. Shards. Differing contexts (one of each) meet by anchor in shards of about
   ``SHARD_BYTES``. A shard's suffix array is built by Larsson-Sadakane
   refinement, Kasai's common prefixes cut it into classes of equal strings, and
   a string repeats if its class has another start. An anchor whose contexts fill
   several shards is merged across them by binary search in the others' arrays.
3. An anchor with more than ``HOT_CONTEXTS`` differing contexts isn't gathered at
   all: the hashes of its strings are dealt out one by one.

64-bit hashes decide equality in steps 1 and 3.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import by_part, column, dealt, pack, shuffle_partitions, stored, unpack

LENGTH = 400
GRAM = 64
SHARD_BYTES = 8 << 20
HOT_CONTEXTS = 16_384
_BUFFER = 1 << 20   # bytes of text hashed at a time
_LANE = 512         # positions that one lane of Kasai's walk covers
_BYTES_HIGH = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, _BUFFER + 4 * LENGTH)
        for name, base in (("p", _P), ("q", _P_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["q"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """``c`` with ``(c[j] - c[i]) * inverse power i`` the hash of bytes i to j."""
    p, _ = _power(len(b) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * p[:len(b)], dtype=np.uint64)])


def _between(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    _, q = _power(len(c))
    return (c[j] - c[i]) * q[i]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:len(v)] = v
    grid = full.reshape(-1, w)
    before = np.minimum.accumulate(grid, 1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1:w - 1 + n])


def runs(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple:
    """Runs of starts in texts laid end to end (``ends``: where each text stops):
    text number, first and last start, anchor hash, the anchor's offset from the
    first start, and the context's hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(b) < length:
        return none
    c = prefix_hash(b)
    at = np.arange(len(b) - gram + 1)
    _, q = _power(len(c))
    v = _mixed((c[gram:] - c[:-gram]) * q[:len(at)])
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((v & ~low) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    # a run starts with its text or where the anchor changes, among the starts whose strings lie in one text
    begin = np.concatenate([[0], ends[:-1]])
    has = ends - begin >= length
    begin, stop = begin[has], ends[has] - length
    if not len(begin):
        return none
    inside = np.zeros(len(anchor) + 1, np.int8)
    inside[begin] += 1
    inside[stop + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    first = np.zeros(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) & inside[1:]
    first[begin] = True
    lo = np.flatnonzero(first)
    text = np.searchsorted(ends, lo, "right")
    hi = np.minimum(np.append(lo[1:], len(b)) - 1, ends[text] - length)
    anchor = anchor[lo]
    context = _mixed(_between(c, lo, hi + length) + (hi - lo).astype(np.uint64) * _P
                     + _mixed((anchor - lo).astype(np.uint64)))
    return text, lo, hi, v[anchor], anchor - lo, context


def _pieces(ids, texts, length):
    """Texts laid end to end, about ``_BUFFER`` bytes at a time; a longer text is
    cut into pieces that overlap so that every start has its string in one."""
    held, size = [], 0
    for i, raw in zip(ids, texts):
        if raw is None or len(raw) < length:
            continue
        for at in range(0, len(raw) - length + 1, _BUFFER):
            piece = raw[at:at + _BUFFER + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= _BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _merged(text, lo, hi, key, off, context) -> tuple:
    """Neighbouring runs with equal key and context as one: the first of each range,
    the range's last start, and how many runs it holds."""
    new = np.ones(len(text), bool)
    new[1:] = ((text[1:] != text[:-1]) | (lo[1:] != hi[:-1] + 1) | (key[1:] != key[:-1])
               | (context[1:] != context[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    return text[first], lo[first], hi[first], key[first], off[first], context[first], hi[last], last - first + 1


def find_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs whose anchor occurs more than once: ``(row, lo, hi, end, key, off, whole,
    send, hot)``; neighbours that are equal are one row, from the first run's
    ``lo`` and ``hi`` to the last start ``end``. whole: all its strings repeat;
    send: its context stands for those equal to it in step 2; hot: its strings are
    dealt one by one.

    Equal contexts are counted by a grouped sum, combined before it is dealt, and
    the counts are joined back, so no task holds all runs of an anchor."""

    def cut(batches):
        for batch in batches:
            for held in _pieces(column(batch, "row"), column(batch, "raw"), length):
                b = np.frombuffer(b"".join([h[2] for h in held]), np.uint8)
                ends = np.cumsum([len(h[2]) for h in held])
                text, lo, hi, key, off, context, end, n = _merged(*runs(b, ends, length, gram))
                if not len(text):
                    continue
                base = np.array([h[1] for h in held])[text] - (ends - [len(h[2]) for h in held])[text]
                row = np.array([h[0] for h in held], np.int64)[text]
                yield pa.RecordBatch.from_arrays([pa.array([pack(
                    key.astype("<u8"), context.astype("<u8"), np.diff(row, prepend=0).astype("<i8"),
                    (lo + base).astype("<u4"), (hi - lo).astype("<u2"), off.astype("<u2"),
                    (end - lo).astype("<u4"), n.astype("<u4"))], pa.binary())], names=["payload"])

    def lay(batches):
        for batch in batches:
            for payload in column(batch, "payload"):
                key, context, row, lo, n, off, more, m, _ = unpack(
                    payload, "<u8", "<u8", "<i8", "<u4", "<u2", "<u2", "<u4", "<u4")
                lo = lo.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.cumsum(row)), pa.array(lo), pa.array(lo + n), pa.array(lo + more),
                     pa.array(key.view(np.int64)), pa.array(off.astype(np.int64)),
                     pa.array(context.view(np.int64)), pa.array(m.astype(np.int64))],
                    names=["row", "lo", "hi", "end", "key", "off", "context", "n"])

    held = stored(rows.select("row", "raw").mapInArrow(cut, "payload binary")).mapInArrow(
        lay, "row bigint, lo bigint, hi bigint, end bigint, key bigint, off bigint, context bigint, n bigint")
    place = F.xxhash64("row", "lo")
    counts = held.groupBy("key", "context").agg(F.sum("n").alias("total"), F.min(place).alias("pick"))
    kinds = counts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("total").alias("of_key")).where(
        "of_key > 1").select("key", "kinds")
    known = counts.join(kinds, "key")
    send = (F.col("kinds") > 1) & (place == F.col("pick"))
    return held.join(known, ["key", "context"]).select(
        "row", "lo", "hi", "end", "key", "off", (F.col("total") > 1).alias("whole"), send.alias("send"),
        (F.col("kinds") > HOT_CONTEXTS).alias("hot")).where("whole or send")


def words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as big-endian numbers (zeros beyond
    the end)."""
    full = np.concatenate([b, np.zeros(16, np.uint8)])
    out = np.empty(len(b), np.uint64)
    for k in range(min(8, len(b))):
        out[k::8] = np.frombuffer(full, ">u8", len(out[k::8]), k)
    return out


def suffix_array(b: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks: sort by a few bytes, then refine only the groups
    that are still equal, by the ranks h bytes on, doubling h (Larsson and
    Sadakane). A suffix that ends sorts first. While three group numbers fit one
    key, a round looks at two later ranks and h grows threefold."""
    n = len(b)
    words = words_at(b) if words is None else words
    index = np.int32 if n < 1 << 30 else np.int64
    h = 8
    if n < 1 << 24 and b.all():  # five bytes and the position are one number
        low = np.uint64((1 << 24) - 1)
        both = np.sort((words & ~low) | np.arange(n, dtype=np.uint64))
        order, new = (both & low).astype(index), _changes(both >> np.uint64(24))
        h = 5
    else:  # zeros beyond the end must sort before zero bytes: length breaks the tie
        short = np.minimum(np.arange(n, 0, -1), 8)
        order = np.lexsort((short, words)).astype(index)
        new = _changes(words[order]) | _changes(short[order])
    rank = np.empty(n + 1, index)
    while not new.all():
        dense = np.cumsum(new, dtype=index)  # the end is 0
        bits = int(dense[-1]).bit_length()
        if 3 * bits > 63:
            break
        rank[n], rank[order] = 0, dense
        key = dense.astype(np.int64)
        for far in (h, 2 * h):
            key <<= bits
            key |= rank[np.minimum(order + index(min(far, n)), index(n))]
        by = np.argsort(key)
        order, new = order[by], _changes(key[by])
        h *= 3
    open_ = np.flatnonzero(~(new & np.append(new[1:], True))).astype(index)
    rank[n], rank[order] = -1, np.maximum.accumulate(np.where(new, np.arange(n, dtype=index), index(0)))
    own = order[open_]
    group = rank[own]
    while len(open_):
        pair = group.astype(np.int64) * (n + 1)  # below 2**63: shards are small
        pair += rank[np.minimum(own + index(min(h, n)), index(n))]
        pair += 1
        by = np.argsort(pair)
        own = own[by]
        order[open_] = own
        new = _changes(pair[by])
        group = np.maximum.accumulate(np.where(new, open_, index(0)))
        rank[own] = group
        left = np.flatnonzero(~(new & np.append(new[1:], True)))
        open_, own, group = open_[left], own[left], group[left]
        h *= 2
    return order, rank[:n]


def _changes(v: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one in front."""
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    return new


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int,
                    lanes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``lcp[r]``: common prefix (at most ``most``) of the suffixes of rank r and
    r - 1. Kasai's walk in text order, in which a common prefix shrinks by one at
    most, done for many lanes of the text side by side, eight bytes at a time.

    ``order`` may hold only some suffixes: the neighbouring ones that each lane
    (where it begins, how many) covers; the others' ``rank`` is -1. Where the
    suffix in front has no next one in ``order``, a prefix is measured anew."""
    n = len(words)
    lcp = np.zeros(len(order), np.int64)
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    at = np.arange(0, n, _LANE) if lanes is None else lanes[0]
    count = np.minimum(_LANE, n - at) if lanes is None else lanes[1]
    by = np.argsort(-count, kind="stable")  # lanes that end are the last ones
    at, count = at[by], count[by]
    size = np.zeros(len(at), np.int64)
    for step in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -step))
        i, size = at[:live] + step, size[:live]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)].astype(np.int64)
        size[r == 0] = 0
        go = np.flatnonzero((r > 0) & (size < most))
        while len(go):
            a, b = np.minimum(i[go] + size[go], n), np.minimum(j[go] + size[go], n)
            x = padded[a] ^ padded[b]
            same = np.full(len(x), 8)
            differ = np.flatnonzero(x)
            same[differ] = 7 - np.searchsorted(_BYTES_HIGH, x[differ], "right")
            room = n - np.maximum(a, b)  # zeros beyond the end aren't common bytes
            grown = np.minimum(same, room)
            size[go] += grown
            go = go[(grown == 8) & (size[go] < most)]
        size = np.minimum(size, most)
        lcp[r] = size
        size = np.where(rank[np.minimum(j + 1, n - 1)] < 0, 0, np.maximum(size - 1, 0))
    return lcp


class Shard:
    """Contexts of one or more anchors with their suffix array, cut into classes
    of equal strings. ``repeats`` is true for eligible starts that repeat."""

    def __init__(self, contexts: list[bytes], weights: np.ndarray, length: int):
        self.length = length
        self.b = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(c) for c in contexts])
        self.begin = np.cumsum(sizes) - sizes
        self.count = sizes - length + 1  # eligible starts of each context
        n = len(self.b)
        edge = np.zeros(n + 1, np.int8)
        edge[self.begin] += 1
        edge[self.begin + self.count] -= 1
        eligible = np.cumsum(edge[:n], dtype=np.int8).view(bool)
        weight = np.repeat(weights.astype(np.int8), sizes)
        self.words = words_at(self.b)
        order, _ = suffix_array(self.b, self.words)
        self.order = order[eligible[order]]      # eligible starts in string order
        rank = np.full(n, -1, order.dtype)
        rank[self.order] = np.arange(len(self.order))
        self.of = np.cumsum(common_prefixes(self.words, self.order, rank, length, (self.begin, self.count)) < length)
        total = np.bincount(self.of, weight[self.order])
        self.repeats = np.zeros(n, bool)
        self.repeats[self.order] = total[self.of] > 1
        self.first = np.flatnonzero(_changes(self.of))  # one start of each class

    def _less(self, i: np.ndarray, other: "Shard", j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether own strings at i sort before the other's at j, and are equal."""
        less, equal = np.zeros(len(i), bool), np.ones(len(i), bool)
        go = np.arange(len(i))
        for k in range(0, self.length, 8):
            k = min(k, self.length - 8)
            x, y = self.words[i[go] + k], other.words[j[go] + k]
            less[go] = x < y
            equal[go] = x == y
            go = go[x == y]
            if not len(go):
                break
        return less, equal

    def merge(self, other: "Shard") -> None:
        """Find each of the other's strings here by binary search; strings found
        repeat in both shards."""
        want = other.order[other.first]
        have = self.order[self.first]
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(have))
        while (open_ := lo < hi).any():
            q = np.flatnonzero(open_)
            mid = (lo[q] + hi[q]) // 2
            less, _ = self._less(have[mid], other, want[q])
            lo[q[less]] = mid[less] + 1
            hi[q[~less]] = mid[~less]
        q = np.flatnonzero(lo < len(have))
        _, equal = self._less(have[lo[q]], other, want[q])
        self._mark(np.flatnonzero(np.bincount(lo[q[equal]], minlength=len(have))))
        other._mark(q[equal])

    def _mark(self, classes: np.ndarray) -> None:
        chosen = np.zeros(len(self.first), bool)
        chosen[classes] = True
        number = np.cumsum(np.concatenate([[True], self.of[1:] != self.of[:-1]])) - 1
        self.repeats[self.order[chosen[number]]] = True

    def found(self) -> list[tuple[int, int, int]]:
        """(context, first, last) of neighbouring starts that repeat."""
        r = self.repeats.astype(np.int8)
        step = np.diff(np.concatenate([[0], r, [0]]))
        owner = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(r))))
        new = (r > 0) & ((step[:-1] > 0) | (np.concatenate([[-1], owner[:-1]]) != owner))
        last = (r > 0) & ((step[1:] < 0) | (np.concatenate([owner[1:], [-1]]) != owner))
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        c = owner[a]
        return list(zip(c.tolist(), (a - self.begin[c]).tolist(), (b - self.begin[c]).tolist()))


def _shards(key: np.ndarray, sizes: np.ndarray, limit: int):
    """Cuts contexts in order of keys into shards: lists of (from, to) for each
    group of whole keys, or the several shards of one large key."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)]
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    for k in range(len(begins) - 1):
        a, b = begins[k], begins[k + 1]
        if total[b] - total[a] > limit:
            if at < a:
                yield [(at, a)]
            cuts, s = [], a
            while s < b:
                e = max(s + 1, int(np.searchsorted(total, total[s] + limit, "right")) - 1)
                cuts.append((s, min(e, b)))
                s = min(e, b)
            yield cuts
            at = b
        elif total[b] - total[at] > limit:
            yield [(at, a)]
            at = a
    if at < len(key):
        yield [(at, len(key))]


def repeated_starts(rows: DataFrame, found: DataFrame, length: int, parts: int,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(row, lo, hi)``: starts that repeat, of runs that don't repeat whole. The
    join takes all columns of ``rows``, so that a later join of the same rows in
    one query reads the same shuffle."""
    own = found.where("send").groupBy("row").agg(
        F.collect_set(F.struct("lo", "hi", "key", "off", "whole", "hot")).alias("runs"))
    held = rows.join(own, "row")

    def send(batches):
        for batch in batches:
            out = []
            for row, raw, own in zip(*(column(batch, c) for c in ("row", "raw", "runs"))):
                key = np.array([r["key"] for r in own], np.int64).view(np.uint64)
                lo = np.array([r["lo"] for r in own], np.int64)
                n = np.array([r["hi"] for r in own], np.int64) - lo
                whole = np.array([r["whole"] for r in own], np.uint8)
                hot = np.array([r["hot"] for r in own], bool)
                of = (key % np.uint64(parts)).astype(np.int64)
                cold = np.flatnonzero(~hot)
                order = cold[np.argsort(of[cold], kind="stable")]
                for o in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                    tail = b"".join([raw[lo[k]:lo[k] + n[k] + length] for k in o.tolist()])
                    out.append((int(of[o[0]]), pack(
                        key[o].astype("<u8"), np.full(len(o), row, "<i8"), lo[o].astype("<u4"),
                        n[o].astype("<u2"), whole[o], tail=tail)))
                for k in np.flatnonzero(hot).tolist():
                    b = np.frombuffer(raw[lo[k]:lo[k] + n[k] + length], np.uint8)
                    i = np.arange(n[k] + 1)
                    h = _mixed(_between(prefix_hash(b), i, i + length))
                    at = (h % np.uint64(parts)).astype(np.int64)
                    for p in np.unique(at).tolist():
                        o = np.flatnonzero(at == p)
                        out.append((p + parts, pack(h[o].astype("<u8"), np.full(len(o), row, "<i8"),
                                                    (lo[k] + o).astype("<u4"), np.full(len(o), 0, "<u2"),
                                                    np.full(len(o), whole[k], np.uint8))))
                if len(out) > 2000:
                    yield _packed(out)
                    out = []
            yield _packed(out)

    def meet(batches):
        for part, payloads in by_part(batches):
            got = [unpack(p, "<u8", "<i8", "<u4", "<u2", "u1") for p in payloads]
            key, row = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            lo, n, whole = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (2, 3, 4))
            if part >= parts:  # strings one by one
                _, of = np.unique(key, return_inverse=True)
                again = (np.bincount(of, 1 + whole)[of] > 1) & (whole == 0)
                yield _starts(row[again], lo[again], lo[again])
                continue
            texts = []
            for g in got:
                at = 0
                for size in (g[3].astype(np.int64) + length).tolist():
                    texts.append(g[5][at:at + size])
                    at += size
            order = np.argsort(key, kind="stable")
            key = key[order]
            for cuts in _shards(key, n[order] + length, shard_bytes):
                built = []
                for a, b in cuts:
                    o = order[a:b]
                    shard = Shard([texts[k] for k in o.tolist()], 1 + whole[o], length)
                    for other, _ in built:
                        other.merge(shard)
                    built.append((shard, o))
                for shard, o in built:
                    out = [(o[c], x, y) for c, x, y in shard.found() if not whole[o[c]]]
                    if out:
                        c, x, y = (np.array([t[k] for t in out]) for k in range(3))
                        yield _starts(row[c], lo[c] + x, lo[c] + y)

    return dealt(held.mapInArrow(send, "part int, payload binary")).mapInArrow(
        meet, "row bigint, lo bigint, hi bigint")


def _packed(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()),
                                       pa.array([x for _, x in out], pa.binary())], names=["part", "payload"])


def _starts(row, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, lo, hi)], names=["row", "lo", "hi"])


def ranges(starts: DataFrame, length: int) -> DataFrame:
    """``(row, lo, hi)`` with starts whose strings meet or overlap as one range."""
    in_row = Window.partitionBy("row").orderBy("lo")
    before = F.max("hi").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    one = starts.groupBy("row", "lo").agg(F.max("hi").alias("hi"))
    apart = one.withColumn("new", F.coalesce(F.col("lo") > before + length, F.lit(True)).cast("int"))
    numbered = apart.withColumn("of", F.sum("new").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "of").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digests: bool = False,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans`` and ``kept``
    (the bytes left, binary) or, with ``digests``, ``kept_sha256``.

    A null text is empty; a text shorter than ``length`` bytes keeps all of them.
    Rows that repeat are documents of their own, so their texts repeat; a null or
    repeated doc_id is kept as it stands. Other columns aren't read. A row is known
    by a 64-bit hash of its id and text, so several readings of ``docs`` may order
    its rows differently.
    """
    spark = docs.sparkSession
    parts = 8 * shuffle_partitions(spark)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id",
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    found = stored(find_runs(rows, length, gram))
    starts = found.where("whole").select("row", "lo", F.col("end").alias("hi")).union(
        repeated_starts(rows, found, length, parts, shard_bytes))
    own = ranges(starts, length).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = rows.join(own, "row", "left").select("doc_id", "raw", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for raw, own in zip(column(batch, "raw"), column(batch, "runs")):
                out, at, count = [], 0, 0
                for lo, hi in sorted((r["lo"], r["hi"] + length) for r in own or []):
                    if not count or lo > at:
                        out.append(raw[at:lo])
                        count += 1
                    at = max(at, hi)
                out.append(raw[at:])
                rest = b"".join(out)
                n.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(count)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.string() if digests else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                             + ("kept_sha256 string" if digests else "kept binary"))
