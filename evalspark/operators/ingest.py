"""Ingest: hash, de-duplicate against the input itself and the store, count.

Raw prompt records (from any reader) carry: content, source, source_ref,
created_at, metadata (JSON text) and an ``order`` key that defines "first"
(e.g. file name + line number). First-wins de-duplication is a ``min_by``
aggregate per content hash: partial aggregation collapses a hot hash (a text
copied a million times) on the map side, so no task ever holds a whole group.
Only the surviving one-row-per-hash side meets the store (anti-join on hash).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.judges import is_blank
from evalspark.functions.rows import one_row
from evalspark.functions.text import content_hash, stored_content

RAW_COLS = ["content", "source", "source_ref", "created_at", "metadata"]


def hashed(raw: DataFrame) -> DataFrame:
    """Non-blank raw rows with their content hash."""
    return (raw.filter(~is_blank(F.col("content")))
               .withColumn("content_hash", content_hash(F.col("content"))))


def first_per_hash(raw: DataFrame, order: str = "order") -> DataFrame:
    """One row per content hash: the one with the smallest ``order``."""
    payload = [c for c in raw.columns if c not in ("content_hash",)]
    h = hashed(raw)
    return (h.groupBy("content_hash")
             .agg(F.min_by(F.struct(*payload), F.col(order)).alias("_first"))
             .select("content_hash", "_first.*"))


def prompt_rows(firsts: DataFrame, ingested_at=None, token_count=None) -> DataFrame:
    """Raw rows, one per hash, as rows of the prompts table.

    Stored content is normalized unless it has a newline; ``char_count`` is the
    length of the raw text; ``token_count`` is an optional column function.
    """
    ts = (F.current_timestamp() if ingested_at is None
          else F.to_timestamp(F.lit(str(ingested_at))))
    tok = token_count(F.col("content")) if token_count is not None else F.lit(None).cast("bigint")
    return firsts.select(
        F.col("content_hash").alias("prompt_id"),
        stored_content(F.col("content")).alias("content"),
        "content_hash",
        tok.alias("token_count"),
        F.length("content").cast("bigint").alias("char_count"),
        "source", "source_ref",
        F.col("metadata").alias("source_metadata"),
        "created_at",
        ts.alias("ingested_at"))


def dedup_prompts(raw: DataFrame, stored: DataFrame | None, ingested_at=None,
                  token_count=None, order: str = "order") -> dict[str, DataFrame]:
    """New prompt rows plus counters (inserted, duplicates, skipped)."""
    firsts = first_per_hash(raw, order)
    if stored is not None:
        firsts = firsts.join(stored.select("content_hash"), "content_hash", "left_anti")
    new = prompt_rows(firsts, ingested_at, token_count)
    return {"new": new, "counters": ingest_counters(raw, new)}


def ingest_counters(raw: DataFrame, new: DataFrame) -> DataFrame:
    """inserted / duplicates / skipped from two global counts (dry run = this
    plan without writing ``new``)."""
    r = raw.agg(F.count(F.lit(1)).alias("_seen"),
                F.count_if(is_blank(F.col("content"))).alias("skipped"))
    n = new.agg(F.count(F.lit(1)).alias("inserted"))
    return (one_row(r, n)
             .select("inserted", (F.col("_seen") - F.col("skipped") - F.col("inserted")).alias("duplicates"),
                     "skipped"))


def ingest_dry_run(raw: DataFrame, stored: DataFrame | None, order: str = "order") -> DataFrame:
    """Counters only; nothing is materialised besides one row per new hash."""
    firsts = hashed(raw).select("content_hash").distinct()
    if stored is not None:
        firsts = firsts.join(stored.select("content_hash"), "content_hash", "left_anti")
    return ingest_counters(raw, firsts)
