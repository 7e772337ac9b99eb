"""Benchmark breakdown, end-to-end bench run and refusal analysis."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.rubrics import BENCH_DIR_META_KEY, BENCH_EXPECTED_RUBRIC
from evalspark.operators.aggregate import agg_intended_tag


def bench_prompts(prompts: DataFrame, marker: str | None = None,
                  source: str = "self_generated:seed") -> DataFrame:
    """Prompts of one bench: seed-sourced and carrying the bench marker."""
    p = prompts.filter(F.col("source") == source)
    if marker is not None:
        p = p.filter(F.get_json_object("source_metadata", f"$.{BENCH_DIR_META_KEY}") == marker)
    return p


def bench_breakdown(bench: DataFrame, runs: DataFrame, models: DataFrame, evaluations: DataFrame,
                    rubric: str = BENCH_EXPECTED_RUBRIC) -> DataFrame:
    """category x model: runs, passes, rate, score, cost, $/pass, latency;
    sorted by category, best rate first, then model."""
    a = agg_intended_tag(bench, runs, models, evaluations, [rubric])
    return (a.select(F.col("tag").alias("category"), "model",
                     F.col("n_evals").alias("n_runs"), F.col("n_passed").alias("pass_count"),
                     "avg_score", "pass_rate", "avg_cost_usd", "cost_per_pass", "avg_latency_ms")
             .orderBy("category", F.desc("pass_rate"), "model"))


def refusal_rate(runs: DataFrame, evaluations: DataFrame, rubric: str = "no_refusal") -> DataFrame:
    """Per model: evaluated runs, refused runs (passed not true) and the rate."""
    e = evaluations.filter(F.col("rubric") == rubric).select("run_id", "passed")
    j = e.join(runs.select("run_id", "model"), "run_id")
    refused = F.count_if(~F.coalesce(F.col("passed"), F.lit(False)))
    return (j.groupBy("model")
             .agg(F.count(F.lit(1)).alias("n"), refused.alias("n_refused"))
             .withColumn("refusal_rate", F.col("n_refused") / F.col("n")))


def refused_prompts(runs: DataFrame, prompts: DataFrame, evaluations: DataFrame,
                    rubric: str = "no_refusal", preview: int = 65) -> DataFrame:
    """Long form (model, prompt_id, preview) of refused runs — never collected per model."""
    e = evaluations.filter((F.col("rubric") == rubric) & ~F.coalesce(F.col("passed"), F.lit(False)))
    return (e.select("run_id").join(runs.select("run_id", "model", "prompt_id"), "run_id")
             .join(prompts.select("prompt_id", "content"), "prompt_id")
             .select("model", "prompt_id", F.substring("content", 1, preview).alias("preview")))


def bench_run(raw: DataFrame, marker: str, stored_prompts: DataFrame | None, prompt_tags: DataFrame | None,
              models: DataFrame, runs: DataFrame | None, evaluations: DataFrame, replies: DataFrame,
              created_at, model_names=None, extra_rubrics=(), skip_existing: bool = True) -> dict[str, DataFrame]:
    """Load -> fan out -> score expected_contains -> extra rubrics -> breakdown.

    ``raw`` are the bench's raw records (``sources.seeds.read_bench``), ``replies``
    the recorded completions for (prompt_id, model). Returns the breakdown, the
    new prompts / tags / runs / evaluations and one counters row.
    """
    from evalspark.functions.rows import one_row
    from evalspark.functions.rubrics import BENCH_RUBRIC
    from evalspark.operators.classify import tag_intended
    from evalspark.operators.ingest import dedup_prompts
    from evalspark.operators.runs import fanout_replay, fanout_work
    from evalspark.operators.scoring import score_runs

    loaded = dedup_prompts(raw, stored_prompts, ingested_at=created_at)
    prompts = loaded["new"] if stored_prompts is None else stored_prompts.unionByName(
        loaded["new"], allowMissingColumns=True)
    tags = tag_intended(prompts, prompt_tags, marker=marker)
    all_tags = tags if prompt_tags is None else prompt_tags.select("prompt_id", "tag").unionByName(tags.select("prompt_id", "tag"))
    bench = bench_prompts(prompts, marker)
    work = fanout_work(bench, models, runs, model_names=model_names, skip_existing=skip_existing)
    fan = fanout_replay(work, replies, models, created_at)
    all_runs = fan["runs"] if runs is None else runs.unionByName(fan["runs"], allowMissingColumns=True)
    bench_runs = all_runs.join(bench.select("prompt_id"), "prompt_id", "left_semi")
    scored = score_runs(BENCH_RUBRIC, bench_runs, prompts, evaluations, as_of=created_at,
                        mode="skip" if skip_existing else "append")
    evals = scored["evaluations"]
    extra_counts = []
    for rub in extra_rubrics:
        r = score_runs(rub, all_runs, prompts, evals, prompt_tags=all_tags, as_of=created_at,
                       mode="skip" if skip_existing else "append")
        evals = r["evaluations"]
        extra_counts.append(r["counters"].select(F.col("evaluations_written").alias(f"_x{len(extra_counts)}")))
    breakdown = bench_breakdown(bench, all_runs, models, evals)
    parts = [loaded["counters"].select(F.col("inserted").alias("prompts_loaded"),
                                       F.col("duplicates").alias("prompts_deduped")),
             fan["counters"].select(F.col("attempted").alias("runs_attempted"),
                                    F.col("succeeded").alias("runs_succeeded"), F.col("failed").alias("runs_failed")),
             scored["counters"].select(F.col("evaluations_written").alias("expected_evals_written")),
             *extra_counts]
    counters = one_row(*parts)
    x = [F.col(f"_x{i}") for i in range(len(extra_counts))]
    counters = counters.withColumn("rubric_evals_written", sum(x, F.lit(0)).cast("bigint")).drop(*[f"_x{i}" for i in range(len(extra_counts))])
    return {"breakdown": breakdown, "prompts": loaded["new"], "tags": tags, "runs": fan["runs"],
            "evaluations": evals, "counters": counters}
