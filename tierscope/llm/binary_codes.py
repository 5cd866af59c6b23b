"""Embedding near-duplicates with randomised-rotation binary codes.

A vector of length 1 is rotated by a fixed random rotation; its code is the sign
of each coordinate and its correction factor ``f`` the inner product of the code
(as a unit vector) with the rotated vector. For another unit vector ``q``,
``<code, q> / f`` is an unbiased estimate of their cosine over the rotation. The
part of the code across the vector has length ``sqrt(1 - f*f)``, so for a cosine
of ``t`` or more the estimate is at least ``t - z * sqrt(1 - t*t)`` times
``sqrt(1 - f*f) / f``. With ``z = 1`` (the default) this confidence bound holds
for certain and no link is lost; a smaller z is a probabilistic bound. Only pairs
above it are compared exactly, in double precision.

Equal vectors of a label are compared once. A label's vectors are dealt into
blocks, and every pair of blocks is one group of rows: pairs aren't emitted, only
counts and a spanning forest for each block. All pairs of a label are estimated,
so the work grows with the square of the label's size, in numpy products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import column, connected_components, stored

THRESHOLD = 0.98
BLOCK = 2048
_ROWS = 256  # rows of a block compared at a time


def rotation(dims: int, seed: int = 20) -> np.ndarray:
    """A random rotation (QR of a Gaussian matrix), the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed bits) and correction factors of unit vectors."""
    turned = unit @ turn.T
    bits = turned >= 0
    f = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return np.packbits(bits, axis=1), f


def estimate(codes: np.ndarray, f: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors (rows) with rotated vectors (columns)."""
    dims = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1
    return (signs @ turned.T.astype(np.float32)) / (np.sqrt(dims) * f[:, None]).astype(np.float32)


def bound(f: np.ndarray, threshold: float, z: float) -> np.ndarray:
    """The least estimate that a cosine of ``threshold`` or more can have (with
    room for single-precision rounding)."""
    return threshold - z * np.sqrt(max(0.0, 1 - threshold ** 2)) * np.sqrt(
        np.maximum(0.0, 1 - f ** 2)) / f - 1e-4


def compare(x: np.ndarray, y: np.ndarray | None, threshold: float, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of ``x`` and ``y`` (of ``x`` alone, first before second, if
    ``y`` is None) with a cosine of at least ``threshold``."""
    turn = rotation(x.shape[1])
    nx = np.linalg.norm(x, axis=1)
    ux = x / nx[:, None]
    ny, uy = (nx, ux) if y is None else (np.linalg.norm(y, axis=1), y / np.linalg.norm(y, axis=1)[:, None])
    other = x if y is None else y
    codes, f = encode(ux, turn)
    turned, least = uy @ turn.T, bound(f, threshold, z)
    rows, cols = [], []
    for at in range(0, len(x), _ROWS):
        own = slice(at, at + _ROWS)
        est = estimate(codes[own], f[own], turned)
        i, j = np.nonzero(est >= least[own, None])
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            a, b = i[k:k + 50_000], j[k:k + 50_000]
            cos = np.einsum("ij,ij->i", x[a], other[b]) / (nx[a] * ny[b])
            rows.append(a[cos >= threshold])
            cols.append(b[cos >= threshold])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(rows or empty), np.concatenate(cols or empty)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _comparable(vector: Column) -> Column:
    """Neither null nor empty nor zero, no null or non-finite component."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, z: float = 1.0,
                    block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    ``vectors``: vec_id, embedding (array of float or double), label. Vectors are
    compared when their labels are equal and not null and their lengths are equal.
    n_links counts the other rows linked directly (copies included); component_id
    is the smallest vec_id reachable; kept: it is the row's own. Vectors that
    can't be compared link with nothing, nor does a row with a null vec_id (its
    component is null and it isn't kept). Rows that repeat a vec_id are one node.
    Other columns aren't read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding").withColumn(
        "ok", _comparable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = rows.where("ok").select("vec_id", "label", "embedding")
    classes = stored(usable.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("dims", F.size("embedding")))
    sizes = classes.groupBy("label", "dims").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")
    sent = classes.join(sizes, ["label", "dims"]).withColumn("own", own).select(
        "label", "dims", "first", "n", "embedding", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "dims", F.col("label").cast("string").alias("label"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"), "first", "n", "embedding")
    order = ["label", "dims", "i", "j"]

    def run(batches):
        def block_pair(key, held):
            _, dims, i, j = key
            ids = np.array([h[1] for h in held], np.int64)
            n = np.array([h[2] for h in held], np.int64)
            x = np.array([h[3] for h in held], np.float64).reshape(len(held), dims)
            if i == j:
                a, b = compare(x, None, threshold, z)
            else:
                second = np.array([h[0] for h in held])
                left, right = np.flatnonzero(~second), np.flatnonzero(second)
                if not len(left) or not len(right):
                    return
                a, b = compare(x[left], x[right], threshold, z)
                a, b = left[a], right[b]
            links = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
            label = _least_labels(len(ids), a, b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])],
                names=["first", "links", "peer"])

        now, held = None, []
        for batch in batches:
            for key in zip(*(column(batch, c) for c in (*order, "second", "first", "n", "embedding"))):
                if key[:4] != now:
                    if held:
                        yield from block_pair(now, held)
                    now, held = key[:4], []
                held.append(key[4:])
        if held:
            yield from block_pair(now, held)

    found = stored(sent.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        run, "first bigint, links bigint, peer bigint"))
    links = found.groupBy("first").agg(F.sum("links").alias("links"))
    peers = found.select(F.col("first").alias("a"), F.col("peer").alias("b")).where("a <> b").distinct()
    copied = usable.join(classes.where("n > 1").select("label", "embedding", "first"),
                         ["label", "embedding"]).select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    linked = connected_components(peers.union(copied))
    named = classes.join(links, "first", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    counted = usable.join(named, ["label", "embedding"], "left").select("vec_id", "n_links").union(
        rows.where("not ok").select("vec_id", F.lit(0).cast("bigint")))
    return counted.join(linked, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
