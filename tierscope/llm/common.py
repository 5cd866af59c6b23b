"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Fixed word class of the word-window operators: after ASCII lower-casing, a
# word is a run of digits, a-z and bytes of 0x80 or more.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b)
    if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lowered, split at every other ASCII byte."""
    return text.translate(WORD_TABLE).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> Iterator:
    """Values of one column, converted one at a time (a batch may be large)."""
    return (v.as_py() for v in batch.column(batch.schema.get_field_index(name)))


def shared_folder(spark: SparkSession) -> str:
    """Make sure reliable checkpoints go to the folder the session names in
    ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def replaced(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` without columns whose names clash with the new ones (names are
    compared without case, as Spark does), plus the new ones."""
    new = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new],
                     *[v.alias(k) for k, v in columns.items()])


def arrow_schema(df_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df_schema)


def pack(*arrays, tail: bytes = b"") -> bytes:
    """Several numpy arrays (and bytes) as one compressed value."""
    import numpy as np
    head = np.array([a.nbytes for a in arrays], "<u4").tobytes()
    return zlib.compress(b"".join([head, *(a.tobytes() for a in arrays), tail]), 1)


def unpack(payload: bytes, *kinds: str) -> list:
    """What ``pack`` has packed, by the arrays' types; the last item is the tail."""
    import numpy as np
    raw = zlib.decompress(payload)
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)), 4 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return [*out, raw[at:]]


def by_part(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads of each part, from rows ``(part, payload)`` sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, payload in zip(column(batch, "part"), column(batch, "payload")):
            if part != now:
                if held:
                    yield now, held
                now, held = part, []
            held.append(payload)
    if held:
        yield now, held


def dealt(packed: DataFrame) -> DataFrame:
    """Rows ``(part, payload)`` with each part in one partition, in order of parts."""
    return packed.repartition("part").sortWithinPartitions("part")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is
    the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round is a min aggregate with map-side combining and one join, and is
    checkpointed, so no group is collected and lineage stays short. Null ends
    are ignored. Rounds grow with the logarithm of the longest path.
    """
    e = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = e.select("u").union(e.select("v")).distinct()
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("u").alias("node")).join(
        roots.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
