"""Per-(bucket, model) evaluation aggregates and the small rollups built on them.

Join order is written by hand because there are no table statistics:
evaluations (filtered by rubric at the scan) join runs on ``run_id`` (the one
big-big join; co-partition or bucket both tables by run_id in the store) and
are reduced to decomposable partial sums per (prompt, model); only those meet
the de-duplicated prompt tags on ``prompt_id``, then models. The final
``groupBy(tag, model)`` has few keys, so partial (map-side) aggregation
collapses hot tags/models before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from evalspark.functions.metrics import cost_per_pass, pass_rate
from evalspark.functions.rows import one_row

AGG_MEASURES = ["n_evals", "n_passed", "n_passed_known", "avg_score",
                "avg_cost_usd", "avg_latency_ms"]


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_evals"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).cast("bigint").alias("n_passed"),
        F.sum(F.when(F.col("passed").isNotNull(), 1).otherwise(0)).cast("bigint").alias("n_passed_known"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ]


def with_derived(agg: DataFrame) -> DataFrame:
    """Add pass_rate and cost_per_pass (derived, never stored)."""
    return (agg.withColumn("pass_rate", pass_rate("n_passed", "n_passed_known"))
               .withColumn("cost_per_pass", cost_per_pass("avg_cost_usd", "pass_rate")))


def _empty_like(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).limit(0)


def _isin(col: str, values: Sequence) -> Column:
    return F.col(col).isin(list(values))


def distinct_prompt_tags(prompt_tags: DataFrame, tags: Sequence[str] | None = None,
                         prompt_ids: Sequence | None = None) -> DataFrame:
    """One row per (prompt_id, tag) whatever the number of classifiers.

    Grouping by prompt_id alone (set of tags, bounded by the taxonomy) leaves
    the result hash-partitioned on prompt_id, which the following join on
    prompt_id reuses instead of shuffling again.
    """
    pt = prompt_tags.select("prompt_id", "tag")
    if tags is not None:
        pt = pt.filter(_isin("tag", tags))
    if prompt_ids is not None:
        pt = pt.filter(_isin("prompt_id", prompt_ids))
    return (pt.groupBy("prompt_id").agg(F.collect_set("tag").alias("_tags"))
              .select("prompt_id", F.explode("_tags").alias("tag")))


def scored_runs(runs: DataFrame, evaluations: DataFrame, rubrics: Sequence[str]) -> DataFrame:
    """evaluations of the chosen rubrics joined to their runs (one row per evaluation)."""
    e = evaluations.filter(_isin("rubric", rubrics)).select("run_id", "score", "passed")
    r = runs.select("run_id", "prompt_id", "model", "cost_usd", "latency_ms")
    return e.join(r, "run_id")


def prompt_model_partials(runs: DataFrame, evaluations: DataFrame, rubrics: Sequence[str]) -> DataFrame:
    """Decomposable partial sums per (prompt_id, model) over evaluations of
    ``rubrics`` joined to their runs. Everything downstream (per tag, per
    category, per model) is a sum of these, so the evaluation-level rows are
    reduced — map-side first — before any join on prompt_id: a prompt or model
    that owns a third of all runs becomes a handful of rows."""
    j = scored_runs(runs, evaluations, rubrics)
    return (j.groupBy("prompt_id", "model").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).cast("bigint").alias("_np"),
        F.sum(F.when(F.col("passed").isNotNull(), 1).otherwise(0)).cast("bigint").alias("_nk"),
        F.sum("score").alias("_ss"), F.count("score").alias("_ns"),
        F.sum("cost_usd").alias("_sc"), F.count("cost_usd").alias("_nc"),
        F.sum("latency_ms").alias("_sl"), F.count("latency_ms").alias("_nl")))


def _finish(x: DataFrame, keys: list[str]) -> DataFrame:
    """Sum partials per ``keys`` and turn them into the aggregate measures."""
    g = x.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in
                               ("_n", "_np", "_nk", "_ss", "_ns", "_sc", "_nc", "_sl", "_nl")])
    return g.select(*keys,
                    F.col("_n").alias("n_evals"), F.col("_np").alias("n_passed"),
                    F.col("_nk").alias("n_passed_known"),
                    F.coalesce(F.try_divide("_ss", "_ns"), F.lit(0.0)).alias("avg_score"),
                    F.try_divide("_sc", "_nc").alias("avg_cost_usd"),
                    F.try_divide("_sl", "_nl").cast("double").alias("avg_latency_ms"))


def agg_tag_model(prompt_tags: DataFrame, runs: DataFrame, models: DataFrame,
                  evaluations: DataFrame, rubrics: Sequence[str],
                  tags: Sequence[str] | None = None,
                  prompt_ids: Sequence | None = None,
                  model_names: Sequence[str] | None = None) -> DataFrame:
    """Group (distinct prompt tag) x run x model x evaluation by (tag, model).

    ``None`` means no filter; an empty list matches nothing.
    """
    out_cols = ["tag", "model", "size_params_b", "context_window", *AGG_MEASURES]
    m = models.select(F.col("name").alias("model"), "size_params_b", "context_window")
    if model_names is not None:
        m = m.filter(_isin("model", model_names))
    pt = distinct_prompt_tags(prompt_tags, tags, prompt_ids)
    parts = prompt_model_partials(runs, evaluations, rubrics)
    if prompt_ids is not None:
        parts = parts.filter(_isin("prompt_id", prompt_ids))
    joined = parts.join(pt, "prompt_id").join(m, "model")
    agg = _finish(joined, ["tag", "model", "size_params_b", "context_window"])
    if not rubrics or any(x is not None and len(x) == 0 for x in (tags, prompt_ids, model_names)):
        return with_derived(_empty_like(agg, out_cols))
    return with_derived(agg.select(*out_cols))


def intended_tag(meta_col: str = "source_metadata", key: str = "intended_tag") -> Column:
    """Declared category from the prompt's JSON metadata, default 'uncategorized'."""
    return F.coalesce(F.get_json_object(F.col(meta_col), f"$.{key}"), F.lit("uncategorized"))


def agg_intended_tag(prompts: DataFrame, runs: DataFrame, models: DataFrame,
                     evaluations: DataFrame, rubrics: Sequence[str],
                     prompt_ids: Sequence | None = None) -> DataFrame:
    """Same measures bucketed by the prompt's declared category."""
    p = prompts.select("prompt_id", intended_tag().alias("tag"))
    if prompt_ids is not None:
        p = p.filter(_isin("prompt_id", prompt_ids))
    m = models.select(F.col("name").alias("model"), "size_params_b", "context_window")
    joined = prompt_model_partials(runs, evaluations, rubrics).join(p, "prompt_id").join(m, "model")
    agg = _finish(joined, ["tag", "model", "size_params_b", "context_window"])
    out_cols = ["tag", "model", "size_params_b", "context_window", *AGG_MEASURES]
    if not rubrics or (prompt_ids is not None and len(prompt_ids) == 0):
        return with_derived(_empty_like(agg, out_cols))
    return with_derived(agg.select(*out_cols))


def _weighted(value: str, weight: str = "n_evals") -> Column:
    """Mean of per-row averages weighted by n_evals of rows whose average is known."""
    num = F.sum(F.when(F.col(value).isNotNull(), F.col(value) * F.col(weight)))
    den = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.round(num / den, 9)


def stats_by_model(agg: DataFrame, tags: Sequence[str] | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Merge per-(tag, model) rows into per-model candidate stats.

    ``group_cols`` adds leading keys (e.g. a tag-set id) so one pass computes
    the stats for many tag sets at once. A prompt carrying two of the chosen
    tags counts twice, as in the per-tag rows.
    """
    a = agg if tags is None else agg.filter(_isin("tag", tags))
    keys = [*group_cols, "model", "size_params_b", "context_window"]
    return (a.groupBy(*keys).agg(
                F.sum("n_evals").alias("sample_count"),
                F.sum("n_passed").alias("n_passed"),
                F.sum("n_passed_known").alias("n_passed_known"),
                F.round(F.sum(F.col("avg_score") * F.col("n_evals")) / F.sum("n_evals"), 9).alias("avg_score"),
                _weighted("avg_cost_usd").alias("avg_cost_usd"),
                _weighted("avg_latency_ms").alias("avg_latency_ms"))
             .withColumn("pass_rate", pass_rate("n_passed", "n_passed_known")))


def group_by_first_key(agg: DataFrame) -> DataFrame:
    """Rows of each tag with the tag's totals: (tag, model, n_evals, pass_rate, n_models, tag_evals).

    Long form: a tag with any number of models is that many rows, never one."""
    totals = agg.groupBy("tag").agg(F.count(F.lit(1)).alias("n_models"), F.sum("n_evals").alias("tag_evals"))
    return agg.select("tag", "model", "n_evals", "pass_rate").join(totals, "tag")


def heatmap_cells(agg: DataFrame, value: str = "pass_rate") -> DataFrame:
    """The matrix in long form: one row (tag, model, value) per cell that has data."""
    return agg.select("tag", "model", F.col(value).alias("value"))


def heatmap(agg: DataFrame, model_names: Sequence[str], value: str = "pass_rate", fill=None) -> DataFrame:
    """tag x model matrix of ``value`` for the models named, in that order; missing
    cells get ``fill``. For all models of a table take :func:`heatmap_cells`."""
    piv = agg.groupBy("tag").pivot("model", list(model_names)).agg(F.first(value))
    if fill is not None:
        piv = piv.fillna(fill, subset=[c for c in piv.columns if c != "tag"])
    return piv


# ---------- headline counts and simple breakdowns -----------------------------

def headline(prompts: DataFrame, models: DataFrame, runs: DataFrame,
             evaluations: DataFrame) -> DataFrame:
    """Counts of four tables, runs with error, total cost (NULL -> 0)."""
    r = runs.agg(F.count(F.lit(1)).alias("n_runs"),
                 F.count_if(F.col("error").isNotNull()).alias("n_runs_with_error"),
                 F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"))
    p = prompts.agg(F.count(F.lit(1)).alias("n_prompts"))
    m = models.agg(F.count(F.lit(1)).alias("n_models"))
    e = evaluations.agg(F.count(F.lit(1)).alias("n_evals"))
    return one_row(p, m, r, e).select(
        "n_prompts", "n_models", "n_runs", "n_evals", "n_runs_with_error", "total_cost_usd")


def run_errors(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("error").isNotNull()).alias("n_runs_with_error"))


def count_by(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Rows per key, largest first (ties by key for a stable order)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), *[F.asc(c) for c in cols]))


def prompts_by_source(prompts: DataFrame) -> DataFrame:
    return count_by(prompts, "source")


def evals_by_rubric(evaluations: DataFrame) -> DataFrame:
    return count_by(evaluations, "rubric")


def tags_by_classifier(prompt_tags: DataFrame) -> DataFrame:
    return count_by(prompt_tags, "tag", "classifier")


def distinct_rubrics(evaluations: DataFrame, preferred: str = "human_pass") -> DataFrame:
    """Rubric names present, the preferred one first, then alphabetical."""
    return (evaluations.select("rubric").distinct()
            .withColumn("rank", F.when(F.col("rubric") == preferred, 0).otherwise(1))
            .orderBy("rank", "rubric"))


def models_by_size(models: DataFrame) -> DataFrame:
    """Models by size ascending, unknown sizes last."""
    return models.orderBy(F.asc_nulls_last("size_params_b"), F.asc("name"))
