"""Streaming ingest: keyed state over batches, restarts, retries and other writers."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from evalspark.functions.text import content_hash
from evalspark.operators import ingest as IG
from evalspark.streaming import ops as S

RAW = "content string, source string, source_ref string, created_at timestamp, metadata string, `order` bigint"


def _put(spark, folder, rows):
    """One file of raw records (content, source_ref, order)."""
    (spark.createDataFrame([(c, "s", ref, dt.datetime(2024, 1, 1), None, o) for c, ref, o in rows], RAW)
          .coalesce(1).write.mode("append").parquet(folder))


def _run(spark, folder, store, ckpt, files=None):
    r = spark.readStream.schema(RAW)
    S.stream_ingest_dedup((r.option("maxFilesPerTrigger", files) if files else r).parquet(folder), store, ckpt,
                          ingested_at="2024-06-01 00:00:00")


def _refs(spark, store):
    return sorted(r.source_ref for r in spark.read.parquet(store).select("source_ref").collect())


def test_first_wins_over_batches_restarts_and_retries(spark):
    raw, store, ckpt = (S.scratch(spark, f"t-ingest-{x}") for x in ("raw", "store", "ckpt"))
    _put(spark, raw, [("beta", "b9", 9), ("beta", "b2", 2), ("  beta ", "b3", 3), ("alpha", "a5", 5), ("beta", "bn", None),
                      ("", "blank", 0), (None, "null", 0), (" \t", "space", 0)])
    _run(spark, raw, store, ckpt)
    assert _refs(spark, store) == ["a5", "b2"]          # smallest order of the batch, NULL order last
    _put(spark, raw, [("alpha", "a1", 1), ("gamma", "g1", 1), ("x" * 200_000, "long", 1)])
    _put(spark, raw, [("gamma", "g0", 0), ("beta", "b0", 0)])
    _run(spark, raw, store, ckpt, files=1)              # later batches: nothing seen before comes again
    got = _refs(spark, store)
    assert len(got) == 4 and {"a5", "b2", "long"} < set(got) and len({"g0", "g1"} & set(got)) == 1
    commits = os.path.join(ckpt, "commits")
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))      # as if lost after the sink wrote
    _run(spark, raw, store, ckpt)
    assert _refs(spark, store) == got


def test_store_of_other_writers_is_seen(spark):
    raw, store, ckpt = (S.scratch(spark, f"t-ingest-{x}") for x in ("raw", "store", "ckpt"))
    _put(spark, raw, [("one", "r1", 1)])
    _run(spark, raw, store, ckpt)
    other = spark.createDataFrame([("two", "s", "w1", None, None, 1)], RAW)
    IG.dedup_prompts(other, None, ingested_at="2024-06-01 00:00:00")["new"].write.mode("append").parquet(store)
    _put(spark, raw, [("two", "r2", 1), ("three", "r3", 1)])
    _run(spark, raw, store, ckpt)
    assert _refs(spark, store) == ["r1", "r3", "w1"]
    again = S.scratch(spark, "t-ingest-ckpt")           # a fresh checkpoint: the state is fed by the store
    _run(spark, raw, store, again)
    assert _refs(spark, store) == ["r1", "r3", "w1"]


def test_hot_text_is_reduced_before_the_shuffle(spark):
    raw, store, ckpt = (S.scratch(spark, f"t-ingest-{x}") for x in ("raw", "store", "ckpt"))
    (spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("content"),
                                F.lit("s").alias("source"), F.col("id").cast("string").alias("source_ref"),
                                F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("metadata"),
                                (F.col("id") % 1000).alias("order")).write.parquet(raw))
    _run(spark, raw, store, ckpt)
    got = spark.read.parquet(store)
    want = {r.h for r in spark.read.parquet(raw).select(content_hash(F.col("content")).alias("h")).distinct().collect()}
    assert {r.content_hash for r in got.collect()} == want and got.count() == len(want)
    best = next(iter(S._combine(iter([IG.hashed(spark.read.parquet(raw)).withColumn("_stored", F.lit(False)).toPandas()]))))
    assert len(best) == len(want)


def test_empty_stream_and_order_type(spark):
    raw, store, ckpt = (S.scratch(spark, f"t-ingest-{x}") for x in ("raw", "store", "ckpt"))
    spark.createDataFrame([], RAW).write.parquet(raw)
    _run(spark, raw, store, ckpt)
    assert spark.read.schema("content_hash string").parquet(store).count() == 0
    with pytest.raises(ValueError):
        S.stream_ingest_dedup(spark.readStream.schema(RAW).parquet(raw).withColumn("order", F.struct("order")), store, ckpt)


def test_no_python_call_a_key_and_texts_stay_out_of_the_state(spark):
    raw, store, ckpt = (S.scratch(spark, f"t-ingest-{x}") for x in ("raw", "store", "ckpt"))
    _put(spark, raw, [(f"{i} " + "word " * 2000, f"r{i}", i) for i in range(200)])
    _run(spark, raw, store, ckpt)
    assert len(_refs(spark, store)) == 200
    assert {r.operatorName for r in spark.read.format("state-metadata").load(ckpt).collect()} == {"dedupe"}
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(os.path.join(ckpt, "state")) for f in names]
    assert 0 < sum(sizes) < 200_000                     # the texts are 2 MB
