"""Prefix trie of conversations.

Every conversation becomes a path of turn keys (128-bit digests of role and text).
Distinct paths are dealt to shards by range, so that a shard holds neighbouring
paths however common their first turns are. Each shard encodes its turn keys by a
dictionary of its own and builds a ternary search tree, medians first, which keeps it
balanced; one iterative traversal adds up members, leaves and savings. Nodes that
neighbouring shards share are the prefixes on a shard's first and last path: knowing
how far those agree with its neighbours, a shard counts each shared node's own part
exactly once, so merging shared nodes is a plain sum by prefix.

Limits: a conversation's path (16 bytes and a length per turn) has to fit in a row,
and the digest of a node's ending conversations is sequential, so the ids (not the
texts) of conversations with one and the same path stream through one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import column, shuffle_partitions, stored

GROUP = 100    # conversations c - c % GROUP lend their first turns
LENT = 6       # a conversation takes crc32(c) % LENT turns
KEY = 16       # bytes of a turn key
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("key", pa.binary()),
    ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_NODES_SQL = ("conv_id bigint, depth bigint, parent_conv_id bigint, key binary, parent_key binary, n_convs bigint, "
              "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def rebuild(conversations: DataFrame, group: int = GROUP, lent: int = LENT) -> DataFrame:
    """``(conv_id, part, pos, role, text)``: the first h turns of conversation
    ``c - c % group``, then c's own turns after its first h, with
    ``h = crc32(decimal c) % lent``; in the order of part and pos.

    Turns are ordered by turn (null first), role, text; repeated rows are turns of their
    own; a null role or text is empty. A conversation without turns is one row with a null
    pos. Rows with a null conv_id belong to no conversation and are left out. Other columns
    are not read. Only the first turns of every ``group``-th id are looked up, and each meets
    fewer than ``group`` conversations.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        empty("role").alias("role"), empty("text").alias("text")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    taken = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(lent))
    turns = stored(rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text"))
    own = turns.where(F.col("pos") > taken("conv_id")).select("conv_id", F.lit(1).alias("part"), "pos", "role", "text")
    giver = F.col("conv_id") - F.col("conv_id") % F.lit(group)
    takers = turns.where("pos = 1").select("conv_id", giver.alias("giver"), taken("conv_id").alias("h"))
    givers = turns.where((F.col("pos") < lent) & (F.col("conv_id") % F.lit(group) == 0)).select(
        F.col("conv_id").alias("giver"), "pos", "role", "text")
    lent_rows = takers.join(givers, "giver", "left").where("pos is null or pos <= h or pos = 1").select(
        "conv_id", F.lit(0).alias("part"), F.when(F.col("pos") <= F.col("h"), F.col("pos")).alias("pos"),
        F.when(F.col("pos") <= F.col("h"), F.col("role")).alias("role"),
        F.when(F.col("pos") <= F.col("h"), F.col("text")).alias("text"))
    return lent_rows.union(own)


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, path binary, sizes array<int>)`` from ``(conv_id, part, pos, role, text)``:
    the turn keys of a conversation in order, and the code points of each text."""
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * KEY)
    rows = turns.select("conv_id", F.when(F.col("pos").isNotNull(), F.struct(
        "part", "pos", key.alias("key"), F.length("text").alias("size"))).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select(
        "conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t.key), "")).alias("path"),
        F.transform("ts", lambda t: t["size"]).alias("sizes"))


def _members(batches):
    """Rows ``(path_key, conv_id)`` sorted by both: members, the smallest and the digest of each path."""
    now, n, first, sha = None, 0, 0, None
    out = []

    def done():
        out.append((n, first, sha.hexdigest()))

    for batch in batches:
        for key, conv in zip(column(batch, "path_key"), column(batch, "conv_id")):
            if key != now:
                if now is not None:
                    done()
                now, n, first, sha = key, 1, conv, hashlib.sha256(b"%d" % conv)
            else:
                n += 1
                sha.update(b",%d" % conv)
        if len(out) >= 10_000:
            yield _member_batch(out)
            out.clear()
    if now is not None:
        done()
    if out:
        yield _member_batch(out)


def _member_batch(out):
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
         pa.array([o[2] for o in out], pa.string())], names=["n", "conv_id", "ends"])


def distinct_paths(found: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes, n, ends)``: each distinct path once, with its smallest
    conversation, the number of conversations and the digest of their ids."""
    keyed = found.select(F.unhex(F.sha2("path", 256)).alias("path_key"), "conv_id")
    members = keyed.repartition("path_key").sortWithinPartitions("path_key", "conv_id").mapInArrow(
        _members, "n bigint, conv_id bigint, ends string")
    return found.join(members, "conv_id")


def agreed(a: bytes, b: bytes) -> int:
    """Number of equal leading turns of two paths."""
    n = min(len(a), len(b)) // KEY
    lo, hi = 0, n  # the prefixes of lo turns agree, those of hi + 1 don't
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:KEY * mid] == b[:KEY * mid] else (lo, mid - 1)
    return lo


def _neighbours(batches):
    for batch in batches:
        rows = [[], [], []]
        for shard, first, last, before, after in zip(*(column(batch, c) for c in (
                "shard", "first", "last", "before", "after"))):
            rows[0].append(shard)
            rows[1].append(-1 if before is None else agreed(before, first))
            rows[2].append(-1 if after is None else agreed(last, after))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()) for r in rows], names=["shard", "up", "down"])


class TernaryTree:
    """A ternary search tree over sequences of dictionary ids; tree node k is trie node
    k + 1, the trie's root is 0."""

    def __init__(self):
        self.id, self.less, self.equal, self.more = [], [], [], []
        self.top = -1

    def insert(self, ids: list[int]) -> int:
        """Insert a sequence; the trie node at which it ends."""
        at, links, slot = 0, None, 0
        for x in ids:
            node = self.top if links is None else links[slot]
            while True:
                if node < 0:
                    node = len(self.id)
                    for side in (self.less, self.equal, self.more):
                        side.append(-1)
                    self.id.append(x)
                    if links is None:
                        self.top = node
                    else:
                        links[slot] = node
                if x == self.id[node]:
                    break
                links, slot = (self.less if x < self.id[node] else self.more), node
                node = links[slot]
            links, slot, at = self.equal, node, node + 1
        return at

    def walk(self):
        """``(trie node, parent, id)``, parents before children, without recursion."""
        stack = [(self.top, 0)]
        while stack:
            node, parent = stack.pop()
            if node < 0:
                continue
            yield node + 1, parent, self.id[node]
            stack += [(self.less[node], parent), (self.more[node], parent), (self.equal[node], node + 1)]


def medians(n: int):
    """Indices 0 to n - 1, the middle of each range before its halves."""
    ranges = [(0, n)]
    for lo, hi in ranges:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges += [(lo, mid), (mid + 1, hi)]


def _shard_nodes(rows: list[tuple], up: int, down: int):
    """Trie nodes of one shard's sorted paths ``(path, sizes, n, conv_id, ends)``, as rows of
    ``_NODES``; ``up`` and ``down``: turns shared with the neighbouring shards, or -1."""
    cut = lambda path: [path[at:at + KEY] for at in range(0, len(path), KEY)]
    number = {k: i for i, k in enumerate(sorted({k for r in rows for k in cut(r[0])}))}
    size = [0] * len(number)
    tree, ends = TernaryTree(), {}
    for i in medians(len(rows)):
        path, sizes, n, conv, sha = rows[i]
        ids = [number[k] for k in cut(path)]
        for x, s in zip(ids, sizes):
            size[x] = s
        end = tree.insert(ids)
        ends[end] = (n, conv, sha)
        if i == len(rows) - 1:
            last_end = end
    count = len(tree.id) + 1
    order, parent, depth, own = [0], [-1] * count, [0] * count, [0] * count
    for v, p, x in tree.walk():
        order.append(v)
        parent[v], depth[v], own[v] = p, depth[p] + 1, size[x]

    shared: dict[int, bytes] = {}   # nodes that a neighbour has too, with their prefix's key
    elsewhere: set[int] = set()     # those that the shard before counts
    children = {(p, x): v for v, p, x in tree.walk()} if max(up, down) > 0 else {}
    for (path, *_), top in ((rows[0], up), (rows[-1], down)):
        v, sha = 0, hashlib.sha256()
        for d, k in enumerate([None, *cut(path)[:max(top, 0)]]):
            if top < 0:
                break
            if d:
                sha.update(k)
                v = children[v, number[k]]
            shared[v] = b"%d:" % d + sha.digest()
            if d <= up and path is rows[0][0]:
                elsewhere.add(v)
    continued = last_end if down * KEY == len(rows[-1][0]) else -1  # by the next shard

    n, conv, kids, leaves, saved = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    inner = [False] * count
    for v in reversed(order):
        if (e := ends.get(v)) is not None:
            n[v] += e[0]
            conv[v] = e[1] if conv[v] is None else min(conv[v], e[1])
        counted = v not in elsewhere
        if not inner[v] and v != continued:
            leaves[v] = 1
        saved[v] += (n[v] - counted) * own[v]
        if (p := parent[v]) >= 0:
            inner[p] = True
            n[p] += n[v]
            conv[p] = conv[v] if conv[p] is None else min(conv[p], conv[v])
            kids[p] += counted
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    for v in order:
        p, e = parent[v], ends.get(v)
        above = shared.get(p) if p >= 0 else None
        yield (conv[v], depth[v], conv[p] if p >= 0 and above is None else None, shared.get(v), above, n[v], kids[v],
               leaves[v], saved[v], e[2] if e else None)


def _tries(batches):
    rows, up, down = [], -1, -1
    for batch in batches:
        for row in zip(*(column(batch, c) for c in ("path", "sizes", "n", "conv_id", "ends", "up", "down"))):
            rows.append(row[:5])
            up, down = row[5:]
    out = []
    if rows:
        for node in _shard_nodes(rows, up, down):
            out.append(node)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)


def trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``turns(conv_id, part, pos, role, text)``, one row each:

    ``conv_id`` the smallest conversation that begins with the node's turns, ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (code points that storing each node once saves in its subtree) and
    ``ends_sha256`` of the conversations that end there. No conversations, no nodes.
    """
    spark = turns.sparkSession
    known = distinct_paths(stored(paths(turns)))
    dealt = stored(known.repartitionByRange(shards or shuffle_partitions(spark), "path")
                   .sortWithinPartitions("path").withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    line = Window.orderBy("shard")  # one row per shard
    bounds = ends.select("shard", "first", "last", F.lag("last").over(line).alias("before"),
                         F.lead("first").over(line).alias("after")).mapInArrow(_neighbours, "shard int, up int, down int")
    # one row of three numbers per shuffle partition
    nodes = stored(dealt.join(F.broadcast(bounds), "shard").select(
        "path", "sizes", "n", "conv_id", "ends", "up", "down").mapInArrow(_tries, _NODES_SQL))

    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = stored(nodes.where("key is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in counts], F.max("ends_sha256").alias("ends_sha256")))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    loose = nodes.where("key is null and parent_key is not null").drop("parent_conv_id", "key").unionByName(
        merged.drop("key"))
    out = ["conv_id", "depth", "parent_conv_id", *counts,
           F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return nodes.where("key is null and parent_key is null").select(*out).unionByName(
        loose.join(above, "parent_key", "left").select(*out))
