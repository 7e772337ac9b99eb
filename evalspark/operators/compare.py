"""Head-to-head model comparison per tag, generalised to a table of model pairs.

Both inputs are small (the per-(tag, model) aggregate and the pair list), so
the self-join below is cheap whatever the size of the runs behind them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.metrics import intervals_disjoint, wilson_bounds


def _side(agg: DataFrame, p: str) -> DataFrame:
    lo, hi = wilson_bounds("n_passed", "n_passed_known")
    return agg.select(F.col("tag"), F.col("model").alias(f"model_{p.lower()}"),
                      F.col("n_evals").alias(f"{p}_n"),
                      F.col("pass_rate").alias(f"{p}_pass_rate"),
                      lo.alias(f"{p}_ci_lo"), hi.alias(f"{p}_ci_hi"),
                      F.col("avg_score").alias(f"{p}_avg_score"),
                      F.col("avg_cost_usd").alias(f"{p}_avg_cost"),
                      F.col("avg_latency_ms").alias(f"{p}_avg_latency"))


def compare(agg: DataFrame, pairs: DataFrame, min_samples: int = 1,
            tie_threshold: float = 0.05, require_significance: bool = True) -> DataFrame:
    """Per (model_a, model_b, tag): Wilson intervals, delta and winner.

    ``agg`` is ``agg_tag_model`` for one rubric; ``pairs`` has model_a, model_b.
    Only tags present for both models with n_evals >= min_samples appear.
    """
    a = _side(agg, "a").withColumnRenamed("model_a", "model_a")
    b = _side(agg, "b")
    j = (pairs.select("model_a", "model_b")
         .join(a, "model_a")
         .join(b, ["model_b", "tag"])
         .filter((F.col("a_n") >= min_samples) & (F.col("b_n") >= min_samples)))
    delta = F.col("a_pass_rate") - F.col("b_pass_rate")
    sig = intervals_disjoint("a_ci_lo", "a_ci_hi", "b_ci_lo", "b_ci_hi")
    j = j.withColumn("delta_pass_rate", delta).withColumn("significant", sig)
    gate = (~F.col("significant")) if require_significance else F.lit(False)
    winner = (F.when(gate, "tie")
               .when(F.abs(F.col("delta_pass_rate")) <= tie_threshold, "tie")
               .when(F.col("delta_pass_rate") > 0, "A").otherwise("B"))
    cols = ["model_a", "model_b", "tag",
            "a_n", "a_pass_rate", "a_ci_lo", "a_ci_hi", "a_avg_score", "a_avg_cost", "a_avg_latency",
            "b_n", "b_pass_rate", "b_ci_lo", "b_ci_hi", "b_avg_score", "b_avg_cost", "b_avg_latency",
            "delta_pass_rate", "significant"]
    return j.select(*cols, winner.alias("winner"))


def compare_overall(cmp: DataFrame) -> DataFrame:
    """Wins, ties and the overall winner per pair."""
    a = F.count_if(F.col("winner") == "A")
    b = F.count_if(F.col("winner") == "B")
    return (cmp.groupBy("model_a", "model_b")
               .agg(a.alias("a_wins"), b.alias("b_wins"),
                    F.count_if(F.col("winner") == "tie").alias("ties"))
               .withColumn("overall_winner",
                           F.when(F.col("a_wins") > F.col("b_wins"), "A")
                            .when(F.col("b_wins") > F.col("a_wins"), "B").otherwise("tie")))


def unknown_models(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Names in ``pairs`` that are not in the model table (the reference raises)."""
    names = pairs.select(F.explode(F.array("model_a", "model_b")).alias("name")).distinct()
    return names.join(models.select("name"), "name", "left_anti")


def compare_pair(agg: DataFrame, models: DataFrame, model_a: str, model_b: str, **kw) -> DataFrame:
    """One pair, validated: raises ValueError for unknown model names."""
    spark = agg.sparkSession
    pairs = spark.createDataFrame([(model_a, model_b)], "model_a string, model_b string")
    missing = [r.name for r in unknown_models(pairs, models).collect()]  # at most two rows
    if missing:
        raise ValueError(f"unknown model(s): {sorted(missing)}")
    return compare(agg, pairs, **kw).orderBy("tag")
