"""Structured Streaming versions of the incremental steps.

All four are restartable from their checkpoint and idempotent per
micro-batch, so a lost executor or a retried batch never double-writes:

* ``stream_ingest_dedup`` — hashes seen so far are keyed state (RocksDB), fed
  by the raw prompts and by the store itself, so a batch costs what it brings,
  not what is stored. Only a batch that an earlier attempt began is held
  against the store's hashes.
* ``stream_score`` — new runs are judged as they arrive; rows already scored
  for (run_id, rubric, rubric_hash) are skipped.
* ``stream_agg_tag_model`` — evaluations stream joined with static tag and
  model tables, aggregated per (tag, model) with partial aggregation; each
  batch overwrites the small result table.
* ``stream_tag_changes`` — the same aggregate where tags arrive as a stream of
  their own and may be withdrawn: a prompt's tags and partial sums are kept by
  batch and joined, every batch writes signed changes, compaction folds them.
* ``stream_run_health`` — event-time daily windows per model with a
  watermark bounding state; updated rows are appended with their batch id
  and readers take the latest row per key.

``run_available_now`` drives a query to completion (tests, backfills).
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import aggregate as A
from evalspark.operators import ingest as IG
from evalspark.operators.scoring import Rubric, decide, judged
from evalspark.session import checkpoint_dir


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available_now(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                      output_mode: str = "append") -> None:
    """Process everything available now through ``sink`` (foreachBatch), then stop."""
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise q.exception()


# ---------------------------------------------------------------- ingest

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _logged(spark: SparkSession, checkpoint: str, log: str) -> set[int]:
    """Batch numbers in a log of a stream's checkpoint."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{log}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(n) for n in names if n.isdigit()}


def _first_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each hash the row of smallest order (NULL last, then as they came); a stored hash stands for all its rows."""
    return (pdf.sort_values(["_stored", "order"], ascending=[False, True], na_position="last", kind="stable")
               .drop_duplicates("content_hash"))


def _combine(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        yield _first_rows(pdf)


def stream_ingest_dedup(raw_stream: DataFrame, store_dir: str, checkpoint: str,
                        ingested_at=None) -> None:
    """Append first-seen prompts (by content hash) to the Parquet store at ``store_dir``.

    ``raw_stream`` has the raw-record columns and ``order``, a number, text or
    time; blank and NULL contents are left out. Of equal hashes the one of an
    earlier micro-batch stays, in one micro-batch the one of smallest order.
    Seen hashes are state, one key each without an expiry, since a prompt may come
    again at any time; nothing is ever too late. The store's hashes enter the state
    as a second stream: all of them with the first batch of a checkpoint, later
    those that other jobs add. Only hashes meet the state; a batch's texts are grouped
    by hash in its sink, with partial aggregates. ``spark.sql.shuffle.partitions`` at the first
    start fixes the partitions of the state for the checkpoint's life.

    A batch is a retry where the checkpoint has its offsets and no commit as the
    stream starts; it is held against the store, so what an attempt had written is
    not written again.
    """
    spark = raw_stream.sparkSession
    kind = raw_stream.schema["order"].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        raise ValueError(f"order must be a number, text or time, not {kind.simpleString()}")
    cols = [*IG.RAW_COLS, "order"]
    rows = IG.hashed(raw_stream.select(*cols)).withColumn("_stored", F.lit(False))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store_dir)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    stored = (spark.readStream.schema("content_hash string").parquet(store_dir)
              .select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols],
                      "content_hash", F.lit(True).alias("_stored")))
    rows = rows.unionByName(stored).withColumn("_new", F.lit(False))
    keys = rows.select("content_hash", "order", "_stored")
    new = keys.mapInPandas(_combine, keys.schema).select("content_hash").dropDuplicates(["content_hash"])    # none that the state holds
    marks = new.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols], "content_hash",
                       F.lit(False).alias("_stored"), F.lit(True).alias("_new"))
    begun = _logged(spark, checkpoint, "offsets") - _logged(spark, checkpoint, "commits")

    def sink(batch: DataFrame, batch_id: int) -> None:
        raw = ~F.col("_new") & ~F.col("_stored")
        first = F.min_by(F.struct(*cols), F.when(raw, F.struct(F.col("order").isNull(), "order")))      # NULL order last
        found = (batch.groupBy("content_hash").agg(F.bool_or("_new").alias("_new"), F.bool_or("_stored").alias("_stored"), first.alias("_first"))
                      .filter("_new and not _stored").select("content_hash", "_first.*"))
        if batch_id in begun:
            known = spark.read.schema("content_hash string").parquet(store_dir)
            found = found.join(known, "content_hash", "left_anti")
        IG.prompt_rows(found, ingested_at).write.mode("append").parquet(store_dir)
    with _settings(spark, ROCKSDB):
        run_available_now(rows.unionByName(marks), sink, checkpoint)


# ---------------------------------------------------------------- scoring

def stream_score(runs_stream: DataFrame, rubric: Rubric, out_dir: str, checkpoint: str,
                 prompts: DataFrame | None = None, as_of=None, prompt_tags: DataFrame | None = None,
                 replies: DataFrame | None = None) -> None:
    """Judge new runs and append evaluations, by the decision of ``score_runs``:
    runs with an up-to-date row (hash NULL or equal), a blank response, no
    applicable tag or no recorded reply are skipped. ``runs_stream`` needs run_id,
    prompt_id, response; ``prompts`` their metadata, ``prompt_tags`` their tags."""
    scored_by = "llm" if rubric.judge_kind == "llm" else "auto"
    ts = F.current_timestamp() if as_of is None else F.to_timestamp(F.lit(str(as_of)))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(out_dir) if _exists(spark, out_dir) else None
        meta = prompts if prompts is not None else (batch.select("prompt_id", "source_metadata").dropDuplicates(["prompt_id"])
                                                    if "source_metadata" in batch.columns else None)
        todo = decide(rubric, batch, known, prompt_tags, replies)
        judged(rubric, todo, batch, meta, replies, scored_by, ts).write.mode("append").parquet(out_dir)
    run_available_now(runs_stream, sink, checkpoint)


# ---------------------------------------------------------------- aggregates

def stream_agg_tag_model(scored_stream: DataFrame, prompt_tags: DataFrame, models: DataFrame,
                         out_dir: str, checkpoint: str) -> None:
    """Running per-(tag, model) aggregate over a stream of scored runs
    (run_id, prompt_id, model, score, passed, cost_usd, latency_ms) of the
    chosen rubrics; the static tag/model sides are small or co-partitioned."""
    pt = A.distinct_prompt_tags(prompt_tags)
    m = models.select(F.col("name").alias("model"), "size_params_b", "context_window")
    agg = (scored_stream.join(pt, "prompt_id").join(m, "model")
           .groupBy("tag", "model", "size_params_b", "context_window")
           .agg(*A._measures()))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a folder of its own per batch: readers of the last version are never cut off, a replay rewrites its own
        A.with_derived(batch).write.mode("overwrite").parquet(f"{out_dir}/version={batch_id}")
    run_available_now(agg, sink, checkpoint, output_mode="complete")


def latest_version(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last complete version that a versioned sink wrote."""
    done = _complete(spark, out_dir, "version")
    if not done:
        raise ValueError(f"no complete version under {out_dir}")
    return spark.read.parquet(done[max(done)])


COUNTS = ["_n", "_np", "_nk", "_ns", "_nc", "_sl", "_nl"]
SUMS = ["_ss", "_sc"]
PARTIALS = COUNTS + SUMS
_TAG_ROW = ["tag", "classifier", "present", "order"]


def _condense(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs summed per prompt and model, tag rows as they are: a prompt with very many runs leaves a few rows a batch."""
    for pdf in pdfs:
        runs = pdf["model"].notna()
        yield (pdf[runs].groupby(["prompt_id", "model"], as_index=False, sort=False)[PARTIALS].sum()
               .assign(**dict.fromkeys(_TAG_ROW))[list(pdf.columns)])
        yield pdf[~runs]


#: folders of kept tags and sums that a batch reads at most; beyond it they are folded into one
KEPT_FOLDERS = 16


def _kept(spark: SparkSession, root: str, kind: str, batch_id: int) -> list[str]:
    """Folders under ``root`` with what batches before ``batch_id`` kept: the last fold and the batches after it."""
    folds, batches = (_complete(spark, f"{root}/{kind}", x) for x in ("fold", "batch"))
    base = max((n for n in folds if n < batch_id), default=-1)
    return ([folds[base]] if base in folds else []) + [p for n, p in sorted(batches.items()) if base < n < batch_id]


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prompt_id", "model").agg(*[F.sum(c).alias(c) for c in PARTIALS])


def _latest(rows: DataFrame) -> DataFrame:
    """What holds of each classifier's tag: the word of the last batch."""
    return rows.groupBy("prompt_id", "tag", "classifier").agg(F.max(F.struct("batch", "present")).alias("_l")).select(
        "prompt_id", "tag", "classifier", "_l.batch", "_l.present")


def _tag_changes(rows: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Signed partial sums per (tag, model) that a batch's rows cause, against what earlier batches kept under ``root``.

    A prompt's new runs count for the tags that it has now; its earlier ones are added for a
    tag that it gets and taken out for one that it loses. What the batch brings is kept in
    folders of its own number, so a retry rewrites them and reads only those before."""
    spark = rows.sparkSession
    runs, tags = f"{root}/runs/batch={batch_id}", f"{root}/tags/batch={batch_id}"
    _sums(rows.filter("model is not null")).write.mode("overwrite").parquet(runs)
    (rows.filter("model is null").groupBy("prompt_id", "tag", "classifier").agg(F.max(F.struct("order", "present")).alias("_l"))
         .select("prompt_id", "tag", "classifier", F.lit(batch_id).cast("bigint").alias("batch"), "_l.present")
         .write.mode("overwrite").parquet(tags))
    old = {kind: _kept(spark, root, kind, batch_id) for kind in ("runs", "tags")}
    if len(old["runs"]) > KEPT_FOLDERS:
        for kind, fold in (("runs", _sums), ("tags", _latest)):
            to = f"{root}/{kind}/fold={batch_id - 1}"
            fold(spark.read.parquet(*old[kind])).write.mode("overwrite").parquet(to)
            for p in old[kind]:                         # only this batch can be tried again, and it reads the fold
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            old[kind] = [to]
    fresh, new = spark.read.parquet(runs), F.col("batch") == batch_id
    earlier = spark.read.parquet(*old["runs"]) if old["runs"] else fresh.limit(0)
    each = spark.read.parquet(*old["tags"], tags).groupBy("prompt_id", "tag", "classifier").agg(
        F.max(F.struct("batch", "present"))["present"].alias("now"),
        F.max(F.when(~new, F.struct("batch", "present")))["present"].alias("before"))
    held = each.groupBy("prompt_id", "tag").agg(*[F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("now", "before")])
    signed = lambda x, sign: x.select("tag", "model", *[(F.col(c) * sign).alias(c) for c in PARTIALS])
    return signed(fresh.join(held.filter("now = 1"), "prompt_id"), F.lit(1)).unionByName(
        signed(earlier.join(held.filter("now <> before"), "prompt_id"), F.col("now") - F.col("before")))


def stream_tag_changes(scored_stream: DataFrame, tag_stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Changes of the (tag, model) aggregate while runs and tags both arrive.

    ``scored_stream`` has prompt_id, model, score, passed, cost_usd, latency_ms, and
    may have ``sign``: -1 takes a run counted earlier out again (a score that is
    replaced). ``tag_stream`` has prompt_id, tag, classifier, present, order (a
    bigint): a prompt carries a tag while any classifier gives it; ``present`` false
    withdraws a classifier's tag, and of one batch's rows the one of largest order
    holds (among equals ``present`` true). A tag given later adds the prompt's earlier runs, a tag withdrawn takes
    them out. Rows with NULL prompt_id, or with NULL model or tag, count nowhere.

    Kept per prompt, beside the checkpoint's own files: its tags and one set of sums a model,
    a folder each batch, folded now and then. A batch meets them in joins on the prompt, so
    no prompt costs a call of its own. Every batch writes its
    changes to a folder of its own, so a retry rewrites it; ``out_dir`` belongs to
    one checkpoint. ``tag_model_now`` reads the sums, ``compact_changes`` folds the folders.
    """
    sign = F.coalesce(F.col("sign").cast("bigint"), F.lit(1)) if "sign" in scored_stream.columns else F.lit(1).cast("bigint")
    known = lambda c: F.when(F.col(c).isNotNull(), sign).otherwise(0).cast("bigint")
    total = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) * sign
    runs = scored_stream.filter("prompt_id is not null and model is not null").select(
        "prompt_id", "model", sign.alias("_n"), F.when(F.col("passed"), sign).otherwise(0).cast("bigint").alias("_np"),
        known("passed").alias("_nk"), known("score").alias("_ns"), known("cost_usd").alias("_nc"),
        total("latency_ms", "bigint").alias("_sl"), known("latency_ms").alias("_nl"),
        total("score", "double").alias("_ss"), total("cost_usd", "double").alias("_sc"))
    tags = tag_stream.filter("prompt_id is not null and tag is not null").select(
        "prompt_id", "tag", F.coalesce("classifier", F.lit("")).alias("classifier"),
        F.coalesce("present", F.lit(True)).alias("present"), F.coalesce("order", F.lit(0)).cast("bigint").alias("order"))
    rows = (runs.select("*", *[F.lit(None).cast(tags.schema[c].dataType).alias(c) for c in _TAG_ROW])
                .unionByName(tags.select("*", F.lit(None).cast("string").alias("model"),
                                         *[F.lit(0).cast("double" if c in SUMS else "bigint").alias(c) for c in PARTIALS])))
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    def sink(batch: DataFrame, batch_id: int) -> None:
        _folded(_tag_changes(batch, f"{checkpoint}/kept", batch_id)).write.mode("overwrite").parquet(f"{out_dir}/delta={batch_id}")
    run_available_now(rows.mapInPandas(_condense, shape), sink, checkpoint)


def _folded(changes: DataFrame) -> DataFrame:
    """Changes summed per tag and model; what cancels out goes."""
    return (changes.groupBy("tag", "model").agg(*[F.sum(c).alias(c) for c in PARTIALS])
                   .filter(" or ".join(f"{c} <> 0" for c in PARTIALS)))


def _complete(spark: SparkSession, out_dir: str, kind: str) -> dict[int, str]:
    """Numbers and paths of the folders ``kind=<number>`` that were written to the end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in paths
            if p.getName().startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _changes_now(spark: SparkSession, out_dir: str) -> tuple[DataFrame, int]:
    """All changes that count (the last base and the deltas after it) and the last batch among them."""
    bases, deltas = _complete(spark, out_dir, "base"), _complete(spark, out_dir, "delta")
    base = max(bases, default=-1)
    after = {n: p for n, p in deltas.items() if n > base}
    paths = ([bases[base]] if bases else []) + list(after.values())
    if not paths:
        raise ValueError(f"no complete batch under {out_dir}")
    return spark.read.parquet(*paths), max(after, default=base)


def tag_model_now(spark: SparkSession, out_dir: str, models: DataFrame) -> DataFrame:
    """The (tag, model) aggregate after the last complete batch."""
    m = models.select(F.col("name").alias("model"), "size_params_b", "context_window")
    now = _folded(_changes_now(spark, out_dir)[0]).filter("_n <> 0")
    return A.with_derived(A._finish(now.join(m, "model"), ["tag", "model", "size_params_b", "context_window"]))


def compact_changes(spark: SparkSession, out_dir: str) -> int:
    """Fold the changes so far into one base folder; returns its last batch.

    Readers change over when the base is complete. What the base before it had
    folded is deleted only now, so a reader that began on that base still ends."""
    changes, last = _changes_now(spark, out_dir)
    done = _complete(spark, out_dir, "base")
    if last in done:
        return last
    _folded(changes).write.mode("overwrite").parquet(f"{out_dir}/base={last}")
    jvm = spark.sparkContext._jvm
    before = max(done, default=-1)
    stale = [p for n, p in _complete(spark, out_dir, "delta").items() if n <= before] + [p for n, p in done.items() if n < before]
    for p in stale:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return last


def stream_run_health(runs_stream: DataFrame, out_dir: str, checkpoint: str,
                      window: str = "1 day", watermark: str = "1 day") -> None:
    """Daily (event-time) runs, errors, cost and latency per model."""
    s = runs_stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    agg = (s.withWatermark("created_at", watermark)
           .groupBy(F.window("created_at", window).alias("w"), "model")
           .agg(F.count(F.lit(1)).alias("n_runs"),
                F.count_if(F.col("error").isNotNull()).alias("n_errors"),
                F.sum("cost_usd").alias("cost_usd"),
                F.avg("latency_ms").alias("avg_latency_ms")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), "model", "n_runs", "n_errors", "cost_usd",
                      "avg_latency_ms", F.lit(batch_id).alias("batch_id"))
              .write.mode("append").parquet(out_dir))
    run_available_now(agg, sink, checkpoint, output_mode="update")


def latest_health(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest row per (window, model) from the update log."""
    h = spark.read.parquet(out_dir)
    return (h.groupBy("window_start", "model")
             .agg(F.max_by(F.struct("n_runs", "n_errors", "cost_usd", "avg_latency_ms"), F.col("batch_id")).alias("x"))
             .select(F.to_date("window_start").alias("day"), "model", "x.*"))


def source_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table, one file or a folder of files, as a file stream (schema taken from the table)."""
    path = sf_dir.rstrip("/")
    table = f"{path}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(table).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return r.parquet(table)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(path)    # a file stream reads folders only


__all__ = ["stream_ingest_dedup", "stream_score", "stream_agg_tag_model", "stream_tag_changes", "tag_model_now",
           "compact_changes", "stream_run_health", "latest_version",
           "latest_health", "run_available_now", "scratch", "source_table"]
