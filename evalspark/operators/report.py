"""Report sections: tag activity, per-tag scorecards, coverage gaps, rubric
freshness, data-quality checks and the nested JSON document.

Every section is computed for all tags at once (one aggregate, then windows
over the small per-(tag, model) candidate table) instead of one query per tag.
Activity counts are pre-aggregated per prompt before meeting the tag table, so
the classifier fan-out multiplies counts, not rows.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.rows import one_row
from evalspark.operators.aggregate import stats_by_model
from evalspark.operators.route import PRESETS, score_candidates
from evalspark.schemas import DEFAULT_MIN_SAMPLES, DEFAULT_THRESHOLD

REPORT_SCHEMA_VERSION = 1


def per_prompt_activity(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """prompt_id -> (n_runs, n_evals) over all runs and all rubrics."""
    e_per_run = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("_ne"))
    return (runs.select("run_id", "prompt_id").join(e_per_run, "run_id", "left")
            .groupBy("prompt_id")
            .agg(F.count(F.lit(1)).alias("p_runs"),
                 F.coalesce(F.sum("_ne"), F.lit(0)).cast("bigint").alias("p_evals")))


def tag_activity(prompt_tags: DataFrame, runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per tag: distinct prompts; runs and evaluations counted through the raw
    (not de-duplicated) tag rows, so they scale with the number of classifiers
    that assigned the tag (kept on purpose: it is what the counts mean)."""
    act = per_prompt_activity(runs, evaluations)
    return (prompt_tags.select("prompt_id", "tag").join(act, "prompt_id", "left")
            .groupBy("tag")
            .agg(F.countDistinct("prompt_id").alias("n_prompts"),
                 F.coalesce(F.sum("p_runs"), F.lit(0)).cast("bigint").alias("n_runs"),
                 F.coalesce(F.sum("p_evals"), F.lit(0)).cast("bigint").alias("n_evals")))


def tag_candidates(agg: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                   min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """Per (tag, model) candidate stats with qualification and balanced score."""
    c = stats_by_model(agg, group_cols=["tag"])
    c = c.withColumn("qualifying", (F.col("sample_count") >= min_samples)
                     & (F.col("pass_rate") >= threshold))
    return score_candidates(c, PRESETS["balanced"], ["tag"], where=F.col("qualifying"))


def scorecards(activity: DataFrame, agg: DataFrame, threshold: float = DEFAULT_THRESHOLD,
               min_samples: int = DEFAULT_MIN_SAMPLES,
               taxonomy: DataFrame | None = None) -> DataFrame:
    """One row per tag that has prompts and candidates.

    quality pick = highest pass rate, cheaper first on ties (unknown cost last);
    cost pick = cheapest; balanced pick = best composite under balanced
    weights — all among qualifying models. With none qualifying the quality
    pick is the best (pass rate, samples) candidate and the other picks NULL.
    Remaining ties go to the model name. All picks come from one ``min_by``
    aggregate per tag (partial aggregation, no per-pick window or join).
    """
    c = tag_candidates(agg, threshold, min_samples)
    q = F.col("qualifying")
    cost_inf = F.coalesce(F.col("avg_cost_usd"), F.lit(float("inf")))
    m = F.col("model")
    val = F.struct("model", "pass_rate", "sample_count", "avg_cost_usd")

    def best(key, cond=None):
        k = F.struct(*key, m)
        return F.min_by(val, k if cond is None else F.when(cond, k))

    picks = c.groupBy("tag").agg(
        best([-F.col("pass_rate"), cost_inf], q).alias("q"),
        best([-F.col("pass_rate"), -F.col("sample_count")]).alias("f"),
        best([cost_inf], q).alias("c"),
        best([-F.coalesce(F.col("composite_score"), F.lit(0.0))], q).alias("b"),
        F.count_if(q).alias("qualifying_models"))
    has = F.col("qualifying_models") > 0
    pick = F.when(has, F.col("q")).otherwise(F.col("f"))
    out = (activity.filter(F.col("n_prompts") > 0).join(picks, "tag")
           .select("tag", "n_prompts", "n_runs", "n_evals",
                   pick["model"].alias("quality_pick"), pick["pass_rate"].alias("quality_pass_rate"),
                   pick["sample_count"].alias("quality_n"),
                   F.col("c.model").alias("cost_pick"), F.col("c.avg_cost_usd").alias("cost_pick_avg_cost"),
                   F.col("b.model").alias("balanced_pick"),
                   has.alias("has_qualifying"), "qualifying_models"))
    return _order_tags(out, taxonomy)


def _order_tags(df: DataFrame, taxonomy: DataFrame | None) -> DataFrame:
    """Taxonomy tags first (sorted), then others (sorted)."""
    if taxonomy is None:
        return df.orderBy("tag")
    t = taxonomy.select("tag").withColumn("_in_tax", F.lit(0))
    return (df.join(t, "tag", "left")
              .orderBy(F.coalesce(F.col("_in_tax"), F.lit(1)), "tag").drop("_in_tax"))


def coverage_gaps(activity: DataFrame, agg: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """Tags with prompts but no candidates (no_runs / no_evals) or no qualifying model."""
    c = tag_candidates(agg, threshold, min_samples)
    per_tag = c.groupBy("tag").agg(F.count(F.lit(1)).alias("n_cand"),
                                   F.count_if("qualifying").alias("n_qual"))
    a = activity.filter(F.col("n_prompts") > 0).join(per_tag, "tag", "left")
    reason = (F.when(F.col("n_cand").isNull(),
                     F.when(F.col("n_runs") == 0, "no_runs").otherwise("no_evals"))
               .when(F.col("n_qual") == 0, "no_qualifying"))
    return (a.withColumn("reason", reason).filter(F.col("reason").isNotNull())
             .select("tag", "n_prompts", "reason"))


def _as_ts(as_of) -> F.Column:
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(as_of))


def rubric_freshness(evaluations: DataFrame, as_of, staleness_days: float = 30.0) -> DataFrame:
    """Per rubric: count, last scored time, age in days at ``as_of``, stale flag,
    and the scored_by breakdown (largest first) as text. ``as_of`` replaces now() so
    the result is reproducible."""
    return freshness_rows(evaluations, as_of, staleness_days).withColumn("scored_by_breakdown", F.array_join(F.transform(
        "scored_by_breakdown", lambda s: F.concat(s["scored_by"], F.lit(":"), s["count"].cast("string"))), ","))


def freshness_rows(evaluations: DataFrame, as_of, staleness_days: float = 30.0) -> DataFrame:
    """``rubric_freshness`` with the breakdown as an array of (scored_by, count)."""
    by = (evaluations.groupBy("rubric", "scored_by").agg(F.count(F.lit(1)).alias("cnt"))
          .groupBy("rubric")
          .agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "scored_by", "cnt")))
               .alias("_b")))
    base = evaluations.groupBy("rubric").agg(
        F.count(F.lit(1)).alias("n_evals"),
        F.max("created_at").alias("last_scored_at"))
    last = F.col("last_scored_at").cast("timestamp")
    age = (F.unix_micros(_as_ts(as_of)) - F.unix_micros(last)) / F.lit(86400e6)
    return (base.join(by, "rubric")
            .withColumn("age_days", age)
            .withColumn("stale", F.coalesce(F.col("age_days") > staleness_days, F.lit(False)))
            .withColumn("scored_by_breakdown", F.transform(
                "_b", lambda s: F.struct(s["scored_by"].alias("scored_by"), s["cnt"].alias("count"))))
            .select("rubric", "n_evals", "last_scored_at", "age_days", "stale", "scored_by_breakdown"))


# ---------------------------------------------------------------- quality checks

def quality_checks(prompts: DataFrame, prompt_tags: DataFrame, models: DataFrame,
                   evaluations: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Data part of the setup check as (check, status, detail, value) rows."""
    one = one_row(taxonomy.agg(F.count(F.lit(1)).alias("taxonomy")),
                  prompts.agg(F.count(F.lit(1)).alias("prompts")),
                  prompt_tags.agg(F.countDistinct("prompt_id").alias("tagged")),
                  models.agg(F.count(F.lit(1)).alias("models")),
                  evaluations.agg(F.count(F.lit(1)).alias("evaluations")))
    t, p, g, m, e = (F.col(x) for x in ("taxonomy", "prompts", "tagged", "models", "evaluations"))
    s = F.lit("ok")

    def row(name, status, detail, value):
        return F.struct(F.lit(name).alias("check"), status.alias("status"),
                        detail.alias("detail"), value.cast("double").alias("value"))

    pct = F.when(p > 0, g / p)
    rows = F.array(
        row("schema", s, F.lit("tables present"), F.lit(None)),
        row("taxonomy", F.when(t == 0, "warn").otherwise("ok"),
            F.when(t == 0, F.lit("no taxonomy rows")).otherwise(F.concat(t.cast("string"), F.lit(" tags seeded"))), t),
        row("prompts", F.when(p == 0, "warn").otherwise("ok"),
            F.when(p == 0, F.lit("no prompts ingested")).otherwise(F.concat(p.cast("string"), F.lit(" prompts in DB"))), p),
        row("models", F.when(m == 0, "warn").otherwise("ok"),
            F.when(m == 0, F.lit("no models registered")).otherwise(F.concat(m.cast("string"), F.lit(" models registered"))), m),
        row("classification",
            F.when(p == 0, "warn").when(g == 0, "warn").when(pct < 0.5, "warn").otherwise("ok"),
            F.when(p == 0, F.lit("no prompts to classify")).when(g == 0, F.lit("no prompts have tags yet"))
             .otherwise(F.concat(g.cast("string"), F.lit("/"), p.cast("string"), F.lit(" prompts tagged"))), pct),
        row("evaluations", F.when(e == 0, "warn").otherwise("ok"),
            F.when(e == 0, F.lit("no evaluations yet")).otherwise(F.concat(e.cast("string"), F.lit(" evaluations recorded"))), e),
    )
    return one.select(F.inline(rows))


def summarize_checks(checks: DataFrame) -> DataFrame:
    """(ok, warn, fail) totals."""
    st = F.col("status")
    return checks.agg(F.count_if(st == "ok").alias("ok"), F.count_if(st == "warn").alias("warn"),
                      F.count_if(st == "fail").alias("fail"))


# ---------------------------------------------------------------- whole report

def build_report(prompts, prompt_tags, models, runs, evaluations, agg, as_of,
                 threshold: float = DEFAULT_THRESHOLD, min_samples: int = DEFAULT_MIN_SAMPLES,
                 staleness_days: float = 30.0, taxonomy: DataFrame | None = None) -> dict[str, DataFrame]:
    """All sections with shared thresholds; ``agg`` is over the authoritative rubrics."""
    from evalspark.operators import aggregate as A
    act = tag_activity(prompt_tags, runs, evaluations)
    return {
        "headline": A.headline(prompts, models, runs, evaluations),
        "prompts_by_source": A.prompts_by_source(prompts),
        "evals_by_rubric": A.evals_by_rubric(evaluations),
        "scorecards": scorecards(act, agg, threshold, min_samples, taxonomy),
        "gaps": coverage_gaps(act, agg, threshold, min_samples),
        "rubric_freshness": freshness_rows(evaluations, as_of, staleness_days),
    }


def _iso(c) -> F.Column:
    """UTC time as ISO text, with microseconds where there are any."""
    t = F.col(c).cast("timestamp")
    utc = F.to_utc_timestamp(t, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(t) % 1_000_000 == 0, F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))


def report_json(sections: dict[str, DataFrame], generated_at: str, taxonomy: DataFrame | None = None) -> DataFrame:
    """One-row DataFrame holding the versioned JSON document.

    Sources, rubrics and rubric freshness stand largest count first (ties by
    name), scorecards and gaps by tag with the tags of ``taxonomy`` before others.
    Unknown values are JSON nulls, their keys stay; times are ISO text in UTC.
    Every list in it is bounded by a dimension (tags, rubrics, sources), never
    by the number of prompts or runs.
    """
    def listed(name, df, order):
        rows = df.agg(F.array_sort(F.collect_list(F.struct(
            *[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c for c in df.columns if c != "_extra"]).alias("row")))).alias("_l"))
        return rows.select(F.transform("_l", lambda x: x["row"]).alias(name))

    def by_tag(df):
        if taxonomy is None:
            return df.withColumn("_extra", F.lit(0))
        t = taxonomy.select("tag").distinct().withColumn("_in", F.lit(0))
        return df.join(t, "tag", "left").withColumn("_extra", F.coalesce("_in", F.lit(1))).drop("_in")

    def counted(name, key):
        return listed(name, sections[name].withColumnRenamed("n", "count"), [-F.col("count"), F.col(key)])

    h = sections["headline"]
    fresh = sections["rubric_freshness"].withColumn("last_scored_at", _iso("last_scored_at"))
    tag = [F.col("_extra"), F.col("tag")]
    doc = one_row(h.select(F.struct(*h.columns).alias("_h")),
                  counted("prompts_by_source", "source"), counted("evals_by_rubric", "rubric"),
                  listed("scorecards", by_tag(sections["scorecards"]), tag),
                  listed("gaps", by_tag(sections["gaps"]), tag),
                  listed("rubric_freshness", fresh, [-F.col("n_evals"), F.col("rubric")]))
    headline = F.struct(*[F.col("_h")[c].alias(c) for c in h.columns],
                        F.col("prompts_by_source"), F.col("evals_by_rubric"))
    return doc.select(F.to_json(F.struct(
        F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        headline.alias("headline"), "scorecards", "gaps", "rubric_freshness"),
        {"ignoreNullFields": "false"}).alias("report"))
