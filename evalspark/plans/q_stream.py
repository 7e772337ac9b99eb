"""Streaming queries: each runs its stream with an availableNow trigger over
the driver's table (read as a file stream), then returns the sink's table."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.plans.fixtures import f2_models, f2_prompt_tags, table, with_views
from evalspark.plans.q_ingest import DEDUP_CTES
from evalspark.plans.q_score import NO_REFUSAL, SCOPED, _NR, _score_sql, f4_prompt_tags
from evalspark.plans.registry import register
from evalspark.streaming import ops as S


@register("stream_ingest_dedup", with_views("""
select distinct h as content_hash from h where h not in (select h from stored)""", extra=DEDUP_CTES))
def q_stream_ingest(spark, d):
    store = S.scratch(spark, "stream-store")
    docs = S.source_table(spark, d, "documents")
    stored = docs.filter(F.col("lang") == "de")
    raw = lambda x: x.select(F.col("text").alias("content"), F.lit("documents").alias("source"),
                             F.col("doc_id").cast("string").alias("source_ref"),
                             F.lit(None).cast("timestamp").alias("created_at"),
                             F.to_json(F.struct("lang", "source")).alias("metadata"), F.col("doc_id").alias("order"))
    S.stream_ingest_dedup(raw(stored), store, S.scratch(spark, "ckpt"), ingested_at="2024-06-01 00:00:00")
    pre = spark.read.parquet(store).select("content_hash")
    S.stream_ingest_dedup(raw(S.source_table(spark, d, "documents")), store, S.scratch(spark, "ckpt"),
                          ingested_at="2024-06-02 00:00:00")
    out = spark.read.parquet(store).select("content_hash")
    return out.join(pre, "content_hash", "left_anti")


@register("stream_ingest_restart", with_views("""
select f.h as content_hash, cast(f.first_doc as varchar) as source_ref
from (select h, min(doc_id) as first_doc from h group by h) f where f.h not in (select h from stored)""", extra=DEDUP_CTES))
def q_stream_ingest_restart(spark, d):
    """German documents first; then, on the same checkpoint and so from its state, all documents as they are."""
    docs = S.source_table(spark, d, "documents")
    store, ckpt, arrived = (S.scratch(spark, f"stream-{x}") for x in ("store", "ckpt", "arrived"))
    raw = (spark.read.schema(docs.schema).parquet(f"{d.rstrip('/')}/documents.parquet")
           .select(F.col("text").alias("content"), F.lit("documents").alias("source"),
                   F.col("doc_id").cast("string").alias("source_ref"), F.lit(None).cast("timestamp").alias("created_at"),
                   F.to_json(F.struct("lang", "source")).alias("metadata"), F.col("doc_id").alias("order"), "lang"))
    for load, part in enumerate((raw.filter(F.col("lang") == "de"), raw), 1):
        part.drop("lang").write.mode("append").parquet(arrived)
        S.stream_ingest_dedup(spark.readStream.schema(raw.drop("lang").schema).parquet(arrived), store, ckpt,
                              ingested_at=f"2024-06-0{load} 00:00:00")
    return (spark.read.parquet(store).filter(F.col("ingested_at") == F.to_timestamp(F.lit("2024-06-02 00:00:00")))
                 .select("content_hash", "source_ref"))


@register("stream_score", with_views(
    f"select run_id, '{NO_REFUSAL.name}' as rubric, {_NR['score']} as score, {_NR['passed']} as passed from f4_runs "
    f"where trim(response) <> ''", "f4_prompts", "f4_runs"))
def q_stream_score(spark, d):
    from evalspark.plans.fixtures import f4_runs
    out = S.scratch(spark, "stream-evals")
    part = S.source_table(spark, d, "part")
    runs_stream = f4_runs(spark, d, part).withColumnRenamed("prompt", "content")
    S.stream_score(runs_stream, NO_REFUSAL, out, S.scratch(spark, "ckpt"), as_of="2024-06-01 00:00:00")
    return spark.read.parquet(out).select("run_id", "rubric", "score", "passed")


@register("stream_score_tags", with_views("select run_id, rubric, score, passed from new", "f4_prompts", "f4_runs",
                                          extra=_score_sql("append", SCOPED, True)))
def q_stream_score_tags(spark, d):
    """A rubric with applies_to_tags over a stream: only runs whose prompt carries a tag."""
    from evalspark.plans.fixtures import f4_runs
    out = S.scratch(spark, "stream-evals")
    runs_stream = f4_runs(spark, d, S.source_table(spark, d, "part"))
    S.stream_score(runs_stream, SCOPED, out, S.scratch(spark, "ckpt"), as_of="2024-06-01 00:00:00", prompt_tags=f4_prompt_tags(spark, d))
    return spark.read.parquet(out).select("run_id", "rubric", "score", "passed")


# The stream's events are line items as they arrive (each one a scored run);
# the batch F2 view additionally merges the rare duplicate line keys.
STREAM_AGG_SQL = """
select pt.tag, m.name as model, m.size_params_b, m.context_window, count(*) as n_evals,
       cast(sum(case when s.passed then 1 else 0 end) as bigint) as n_passed,
       cast(sum(case when s.passed is not null then 1 else 0 end) as bigint) as n_passed_known,
       coalesce(avg(s.score), 0.0) as avg_score, avg(s.cost_usd) as avg_cost_usd, avg(s.latency_ms) as avg_latency_ms
from (select l_orderkey as prompt_id, l_suppkey as model_key, round(l_discount * 100) / 16e0 as score,
             case when l_returnflag = 'N' then null else round(l_discount * 100) >= 3 end as passed,
             case when l_tax = 0 then null else floor(l_extendedprice) / 1048576e0 end as cost_usd,
             cast(l_quantity * 100 as int) as latency_ms
      from lineitem where l_linestatus = 'F') s
join (select distinct prompt_id, tag from f2_prompt_tags {where}) pt on pt.prompt_id = s.prompt_id
join f2_models m on m.model_key = s.model_key
group by pt.tag, m.name, m.size_params_b, m.context_window"""
AGG_COLS = ["tag", "model", "size_params_b", "context_window", "n_evals", "n_passed", "n_passed_known", "avg_score",
            "avg_cost_usd", "avg_latency_ms"]


def _scored(spark, d, li):
    """Line items of status F as scored runs."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    disc = F.round(F.col("l_discount") * 100)
    return (li.filter(F.col("l_linestatus") == "F")
              .select(F.concat_ws("-", *[F.col(c).cast("string") for c in keys]).alias("run_id"),
                      F.col("l_orderkey").alias("prompt_id"), F.col("l_suppkey").alias("model_key"),
                      (disc / F.lit(16.0)).alias("score"),
                      F.when(F.col("l_returnflag") == "N", F.lit(None).cast("boolean")).otherwise(disc >= 3).alias("passed"),
                      F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
                       .otherwise(F.floor("l_extendedprice") / F.lit(1048576.0)).alias("cost_usd"),
                      (F.col("l_quantity") * 100).cast("int").alias("latency_ms"), "l_linenumber")
              .join(f2_models(spark, d).select("model_key", F.col("name").alias("model")), "model_key"))


@register("stream_agg_tag_model", with_views(STREAM_AGG_SQL.format(where=""), "f2_prompt_tags", "f2_models"))
def q_stream_agg(spark, d):
    out = S.scratch(spark, "stream-agg")
    scored = _scored(spark, d, S.source_table(spark, d, "lineitem"))
    S.stream_agg_tag_model(scored, f2_prompt_tags(spark, d), f2_models(spark, d), out, S.scratch(spark, "ckpt"))
    return S.latest_version(spark, out).select(*AGG_COLS)


@register("stream_tag_changes", with_views(STREAM_AGG_SQL.format(
    where="where not (classifier = 'bench' and prompt_id % 4 in (0, 1))"), "f2_prompt_tags", "f2_models"))
def q_stream_tag_changes(spark, d):
    """Runs and tags in two loads on one checkpoint: the second brings the later line items, the model's tags, and
    withdraws half of the bench tags, so earlier sums are corrected."""
    out, ckpt, runs, tags = (S.scratch(spark, f"stream-{x}") for x in ("changes", "ckpt", "runs", "tags"))
    scored = _scored(spark, d, table(spark, d, "lineitem")).drop("model_key", "run_id")
    given = f2_prompt_tags(spark, d).select("prompt_id", "tag", "classifier", F.lit(True).alias("present"),
                                            F.lit(1).cast("bigint").alias("order"))
    late = F.col("classifier") == "ml"
    withdrawn = (given.filter((F.col("classifier") == "bench") & (F.col("prompt_id") % 4).isin(0, 1))
                      .withColumn("present", F.lit(False)).withColumn("order", F.lit(2).cast("bigint")))
    loads = [(scored.filter("l_linenumber <= 3"), given.filter(~late)),
             (scored.filter("l_linenumber > 3"), given.filter(late).unionByName(withdrawn))]
    for r, t in loads:
        r.drop("l_linenumber").write.mode("append").parquet(runs)
        t.write.mode("append").parquet(tags)
        S.stream_tag_changes(spark.readStream.schema(r.drop("l_linenumber").schema).parquet(runs),
                             spark.readStream.schema(t.schema).parquet(tags), out, ckpt)
    S.compact_changes(spark, out)
    return S.tag_model_now(spark, out, f2_models(spark, d)).select(*AGG_COLS)


@register("stream_run_health", with_views("""
select cast(created_at as date) as day, model, count(*) as n_runs,
       count(*) filter (where error is not null) as n_errors,
       sum(cost_usd) as cost_usd, avg(latency_ms) as avg_latency_ms
from f3_runs group by cast(created_at as date), model""", "f3_runs"))
def q_stream_health(spark, d):
    out = S.scratch(spark, "stream-health")
    e = S.source_table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("tag"),
                    F.concat(F.lit("m-"), (F.col("user_id") % 10).cast("string")).alias("model"),
                    (F.floor(F.col("value") * 100) / F.lit(1024.0)).alias("cost_usd"),
                    F.floor("value").cast("int").alias("latency_ms"),
                    F.when(F.col("event_type") == "error", F.lit("http_error: timed out")).alias("error"),
                    F.col("ts").alias("created_at"))
    S.stream_run_health(runs, out, S.scratch(spark, "ckpt"))
    return S.latest_health(spark, out)


@register("f3_daily", with_views("""
select cast(created_at as date) as day, model, count(*) as n_runs,
       count(*) filter (where error is not null) as n_errors,
       sum(cost_usd) as cost_usd, avg(latency_ms) as avg_latency_ms
from f3_runs group by cast(created_at as date), model""", "f3_runs"))
def q_f3_daily(spark, d):
    from evalspark.plans.fixtures import f3_runs
    r = f3_runs(spark, d)
    return (r.groupBy(F.to_date("created_at").alias("day"), "model")
             .agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
                  F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("avg_latency_ms")))


