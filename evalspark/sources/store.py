"""The evaluation store on Parquet: typed reads, writes and the taxonomy seed.

Layout: one Parquet directory per table under a snapshot root. ``runs`` and
``evaluations`` are written hash-partitioned by ``run_id`` (bucketed when a
catalog is available) so their join — the only big-big join — needs no shuffle,
and ``evaluations`` is partitioned on disk by ``rubric`` so a rubric filter
prunes files. Mutations never rewrite in place: every operator returns the full
new table and the caller writes a new snapshot directory.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.schemas import DEFAULT_TAXONOMY, TABLES, TAG_TAXONOMY


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed read of one table; the declared schema avoids inference jobs."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {n: read_store(spark, root, n) for n in TABLES}


def write_store(tables: dict[str, DataFrame], root: str, mode: str = "errorifexists",
                n_buckets: int | None = None, table_prefix: str | None = None) -> None:
    """Write a snapshot under ``root``.

    ``n_buckets`` hash-partitions runs and evaluations by run_id. With
    ``table_prefix`` they are also registered as bucketed catalog tables
    (``<prefix>runs``, ``<prefix>evaluations``; same bucket count, sorted by
    run_id), so a reader's run_id join uses the buckets and needs no shuffle —
    read them back with ``spark.table``. Evaluations are partitioned on disk by
    rubric either way, so rubric filters prune files. Files are Zstandard-compressed
    (hashes as hex take half the room that Snappy leaves them).
    """
    for name, df in tables.items():
        cols = [f.name for f in TABLES[name]] if name in TABLES else df.columns
        out = df.select(*cols)
        path = f"{root.rstrip('/')}/{name}"
        if name in ("runs", "evaluations") and n_buckets and table_prefix:
            writer = (out.write.mode(mode).option("compression", "zstd").bucketBy(n_buckets, "run_id").sortBy("run_id")
                         .option("path", path))
            if name == "evaluations":
                writer = writer.partitionBy("rubric")
            writer.saveAsTable(f"{table_prefix}{name}")
            continue
        w = out.repartition(n_buckets, "run_id") if name in ("runs", "evaluations") and n_buckets else out
        writer = w.write.mode(mode).option("compression", "zstd")
        if name == "evaluations":
            writer = writer.partitionBy("rubric")
        writer.parquet(path)


def default_taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(t, d, None) for t, d in DEFAULT_TAXONOMY]
    return spark.createDataFrame(rows, TAG_TAXONOMY)


def taxonomy_seed(existing: DataFrame) -> DataFrame:
    """Default tags missing from ``existing`` (insert-missing-only semantics)."""
    spark = existing.sparkSession
    return default_taxonomy(spark).join(existing.select("tag"), "tag", "left_anti")


def taxonomy_after_seed(existing: DataFrame) -> DataFrame:
    """The taxonomy table after seeding: existing rows win, defaults fill gaps."""
    return existing.select("tag", "description", "parent").unionByName(taxonomy_seed(existing))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def as_store_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Cast key columns to string (natural keys are strings in the store)."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df
