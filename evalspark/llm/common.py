"""Helpers shared by the training-data operators.

Everything here works on DataFrames or inside one task; nothing is collected.
Intermediate tables go to the shared folder of ``spark.checkpoint.dir`` as
Parquet, so a lost executor never takes the only copy of anything with it.
"""
from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import checkpoint_dir

#: rows of one Arrow batch sent to Python: documents are long, so batches are short
ARROW_ROWS = 1000
#: measured bytes up to which adaptive execution may broadcast a side of a join
BROADCAST = "32MB"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings of the operators: short Arrow batches of long texts, small broadcasts.

    Adaptive execution broadcasts a side only once its measured size is below the
    threshold; beyond it the join is by shuffle, and skewed keys are split.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new folder of the shared checkpoint directory, reread it.

    Cuts the lineage as ``checkpoint()`` does, but as a columnar table: later
    steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: it does so once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width_for(rows: int, each: int, least: int = 1) -> int:
    """Partitions for a measured number of rows at about ``each`` rows."""
    return max(least, -(-int(rows) // int(each)))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and its offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int):
    """Runs of whole texts of about ``limit`` bytes (one long text stands alone)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as stars: each node but the roots, with its component's least node.

    At most one row per node comes out, however many links went in.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while len(ia):
        la, lb = label[ia], label[ib]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        keep = label[ia] != label[ib]
        ia, ib = ia[keep], ib[keep]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, rows_each: int = 500_000) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the least node.

    Alternating large-star and small-star rounds; every round is written to the
    shared folder. A hot node costs one partial minimum and one join that
    adaptive execution can split; nothing is gathered per node. Roots have no
    row of their own. Empty input gives an empty table. Links are undirected;
    nulls and self links are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = (seen["n"], seen["x"])
        now = now.coalesce(width_for(seen["n"], rows_each))
        # large star: every larger neighbour of x is hung on the least of x and its neighbours
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(
            F.col("v").alias("x"), F.least("m", "v").alias("m"))
        large = now.join(least, F.col("u") == F.col("x")).select("v", F.col("m").alias("u")).distinct()
        # small star: every smaller neighbour of v, and v, is hung on the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low.withColumnRenamed("v", "x"), F.col("v") == F.col("x"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").union(low.select("v", F.col("m").alias("u"))).distinct()
        now = stored(small.coalesce(width_for(seen["n"], rows_each)), "edges")
