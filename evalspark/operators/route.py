"""Routing: score candidate models and pick one per prompt, in batch.

Prompts are routed per *tag set*: every prompt whose (non-unknown) tags are the
same set gets the same candidates and the same pick. So the candidate work is
(distinct tag sets x models), independent of the number of prompts, and the
prompts meet their pick in one join on the tag-set key (broadcast by AQE when
the pick table is small, which it is: one row per tag set).

Axes are normalised by grouped minima and maxima joined back, never by a window
over a tag or a tag set; tag sets are arrays, so a tag may hold any sign.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.metrics import lower_is_better
from evalspark.operators.aggregate import stats_by_model
from evalspark.operators.classify import classify_heuristic, ensemble_vote
from evalspark.schemas import DEFAULT_MIN_SAMPLES, DEFAULT_THRESHOLD


@dataclass(frozen=True)
class Weights:
    size: float = 1.0
    cost: float = 0.0
    latency: float = 0.0

    def normalize(self) -> "Weights":
        total = self.size + self.cost + self.latency
        if total == 0:
            return Weights(1.0, 0.0, 0.0)
        return Weights(self.size / total, self.cost / total, self.latency / total)


# Weight presets (size, cost, latency).
PRESETS: dict[str, Weights] = {
    "size": Weights(1.0, 0.0, 0.0),
    "balanced": Weights(0.34, 0.33, 0.33),
    "cheap": Weights(0.0, 1.0, 0.0),
    "fast": Weights(0.0, 0.0, 1.0),
}


def weights_from(preset: str | Weights | None = None, *, size: float | None = None,
                 cost: float | None = None, latency: float | None = None) -> Weights:
    """Preset name (default 'size') overlaid with explicit per-axis overrides."""
    if isinstance(preset, Weights):
        base = preset
    else:
        name = preset or "size"
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}; known: {sorted(PRESETS)}")
        base = PRESETS[name]
    return Weights(size if size is not None else base.size,
                   cost if cost is not None else base.cost,
                   latency if latency is not None else base.latency)


def score_candidates(cands: DataFrame, weights: Weights, partition_cols: list[str],
                     where=None) -> DataFrame:
    """Add ``composite_score`` = weighted sum of three lower-is-better axes,
    each min-max normalised within ``partition_cols`` over the rows where
    ``where`` holds (all rows if None); other rows get NULL.

    Unknown size counts as the largest known size in the group (1e9 if none);
    unknown cost / latency count as 0.0, i.e. best.
    """
    w = weights.normalize()
    sel = F.lit(True) if where is None else where
    cost, latency = F.coalesce(F.col("avg_cost_usd"), F.lit(0.0)), F.coalesce(F.col("avg_latency_ms"), F.lit(0.0))
    ends = [f(c).alias(f"_{n}_{c0}") for c0, c in (("size", F.col("size_params_b")), ("cost", cost), ("latency", latency))
            for n, f in (("min", F.min), ("max", F.max))]
    limits = cands.where(sel).groupBy(*partition_cols).agg(*ends)  # partial minima and maxima, one row per group
    out = cands.join(limits, partition_cols, "left")
    unknown = F.lit(1e9)
    axes = (w.size * lower_is_better(F.coalesce("size_params_b", "_max_size", unknown), F.coalesce("_min_size", unknown),
                                     F.coalesce("_max_size", unknown))
            + w.cost * lower_is_better(cost, F.col("_min_cost"), F.col("_max_cost"))
            + w.latency * lower_is_better(latency, F.col("_min_latency"), F.col("_max_latency")))
    return out.select(*cands.columns, F.when(sel, axes).alias("composite_score"))


def prompt_tag_sets(prompt_tags: DataFrame) -> DataFrame:
    """prompt_id -> sorted array of its non-unknown tags."""
    return (prompt_tags.filter(F.col("tag") != "unknown")
            .groupBy("prompt_id")
            .agg(F.array_sort(F.collect_set("tag")).alias("tagset")))


def tag_set_members(tag_sets: DataFrame) -> DataFrame:
    """(tagset, tag) for every distinct tag set."""
    return (tag_sets.select("tagset").distinct()
            .select("tagset", F.explode("tagset").alias("tag")))


def route_candidates(agg: DataFrame, tag_sets: DataFrame, weights: Weights | str = "size",
                     threshold: float = DEFAULT_THRESHOLD,
                     min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """All candidate models per tag set with qualification and composite score."""
    w = weights_from(weights) if isinstance(weights, str) else weights
    members = tag_set_members(tag_sets)
    stats = stats_by_model(agg.join(members, "tag"), group_cols=["tagset"])
    qual = (F.col("sample_count") >= min_samples) & (F.col("pass_rate") >= threshold)
    stats = stats.withColumn("qualifying", qual)
    return score_candidates(stats, w, ["tagset"], where=F.col("qualifying"))


def pick_per_tag_set(cands: DataFrame) -> DataFrame:
    """One pick per tag set: best composite among qualifying models (ties by
    model name), else fall back to best pass rate, then sample count, then name.
    One ``min_by`` aggregate per tag set (partial aggregation, no sort)."""
    q = F.col("qualifying")
    key = F.struct((~q).alias("k0"),
                   (-F.when(q, F.col("composite_score")).otherwise(F.col("pass_rate"))).alias("k1"),
                   (-F.when(q, F.lit(0)).otherwise(F.col("sample_count"))).alias("k2"),
                   F.col("model").alias("k3"))
    cols = [c for c in cands.columns if c != "tagset"]
    return (cands.groupBy("tagset")
                 .agg(F.min_by(F.struct(*cols), key).alias("_p"),
                      F.count(F.lit(1)).alias("n_candidates"), F.count_if(q).alias("n_qualifying"))
                 .select("tagset", "_p.*", "n_candidates", "n_qualifying")
                 .withColumn("fallback", ~F.col("qualifying")))


def recommend(prompts: DataFrame, prompt_tags: DataFrame, agg: DataFrame,
              weights: Weights | str = "size", threshold: float = DEFAULT_THRESHOLD,
              min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """Route every prompt in ``prompts`` (needs ``prompt_id``).

    ``agg`` is ``agg_tag_model`` over the authoritative rubrics. Prompts with no
    tags or no history keep a row with a NULL model and reason 'no_stats'.
    """
    tag_sets = prompt_tag_sets(prompt_tags)
    picks = pick_per_tag_set(route_candidates(agg, tag_sets, weights, threshold, min_samples))
    per_prompt = prompts.select("prompt_id").join(tag_sets, "prompt_id", "left")
    return (per_prompt.join(picks, "tagset", "left")
            .select("prompt_id", F.array_join("tagset", ",").alias("tagset"), "model", "fallback",
                    F.when(F.col("model").isNull(), F.lit("no_stats"))
                     .when(F.col("fallback"), F.lit("fallback"))
                     .otherwise(F.lit("qualified")).alias("reason"),
                    "composite_score", "pass_rate", "sample_count",
                    "avg_cost_usd", "avg_latency_ms", "size_params_b",
                    "n_candidates", "n_qualifying"))


# fixed values: the stored sentences of the reason
NO_HISTORY = "no historical evaluations for these tags"
QUALIFIED = ("best composite score under weights (size={size:.2f}, cost={cost:.2f}, latency={latency:.2f}) among models "
             "with pass_rate >= {threshold:.0%} over >= {min_samples} runs on tags ")
FALLBACK = "no model met threshold {threshold:.0%} with >= {min_samples} samples; falling back to best available"


def ranked_tags(predictions: DataFrame) -> DataFrame:
    """prompt_id -> its non-unknown tags, surest first (of a tag's predictions the surest counts, ties by tag)."""
    best = (predictions.filter((F.col("tag") != "unknown") & F.col("tag").isNotNull())
            .groupBy("prompt_id", "tag").agg(F.max("confidence").alias("_c")))
    return (best.groupBy("prompt_id")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("o"), F.col("tag").alias("tag")))).alias("_t"))
            .select("prompt_id", F.transform("_t", lambda x: x["tag"]).alias("tags")))


def route_texts(prompts: DataFrame, agg: DataFrame, text_col: str = "content", votes: DataFrame | None = None,
                members=("heuristic",), llm_votes: DataFrame | None = None, weights: Weights | str = "size",
                threshold: float = DEFAULT_THRESHOLD, min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """From prompt texts to picks: classify, vote, route, and say why.

    The heuristic tagger reads ``text_col`` (of rows with ``prompt_id``); ``votes`` are
    predictions of further classifiers (a trained tagger's, recorded ones), ``members``
    the classifiers that vote, ``llm_votes`` join in where the members disagree. Every prompt keeps one row, also
    with a NULL or empty text; a prompt without tags or history has a NULL model.
    """
    w = (weights_from(weights) if isinstance(weights, str) else weights).normalize()
    preds = classify_heuristic(prompts, text_col)
    if votes is not None:
        preds = preds.unionByName(votes.select(*preds.columns))
    tags = ranked_tags(ensemble_vote(preds, members, llm_votes)).withColumn("tagset", F.array_sort("tags"))
    picks = pick_per_tag_set(route_candidates(agg, tags, w, threshold, min_samples))
    named = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    said = {"threshold": threshold, "min_samples": min_samples}
    return (prompts.select("prompt_id").join(tags, "prompt_id", "left").join(picks, "tagset", "left")
            .select("prompt_id", F.array_join("tags", ",").alias("tags"), "model", F.coalesce("fallback", F.lit(False)).alias("fallback"),
                    F.when(F.col("model").isNull(), F.lit(NO_HISTORY))
                     .when(F.col("fallback"), F.lit(FALLBACK.format(**said)))
                     .otherwise(F.concat(F.lit(QUALIFIED.format(size=w.size, cost=w.cost, latency=w.latency, **said)), named)).alias("reason"),
                    "composite_score", "pass_rate", "sample_count", "n_candidates", "n_qualifying"))
