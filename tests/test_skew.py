"""Hot keys: one text copied for a third of all rows, one model owning a third
of all runs. Results must stay whole and exact; plans must aggregate before
the shuffle so the hot key never travels as one group."""
from pyspark.sql import functions as F

from evalspark.operators import aggregate as A
from evalspark.operators import ingest as IG


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_duplicate_text(spark):
    n = 30000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("the same prompt")).otherwise(
            F.concat(F.lit("prompt "), F.col("id").cast("string"))).alias("content"),
        F.lit("s").alias("source"), F.col("id").cast("string").alias("source_ref"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("metadata"),
        F.col("id").alias("order")).repartition(8)
    out = IG.dedup_prompts(base, None, ingested_at="2024-01-01 00:00:00")
    c = out["counters"].first()
    assert (c.inserted, c.duplicates, c.skipped) == (1 + 2 * n // 3, n // 3 - 1, 0)
    hot = out["new"].filter(F.col("content") == "the same prompt").first()
    assert hot.source_ref == "0"                      # first wins, whole input considered
    p = _plan(IG.first_per_hash(base))
    assert "partial_min_by" in p or "partial_" in p


def test_hot_model(spark):
    n = 30000
    runs = spark.range(n).select(F.col("id").cast("string").alias("run_id"),
                                 (F.col("id") % 1000).cast("string").alias("prompt_id"),
                                 F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                                     F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))).alias("model"),
                                 F.lit(0.5).alias("cost_usd"), F.lit(10).cast("long").alias("latency_ms"))
    ev = runs.select("run_id", F.lit("human_pass").alias("rubric"), F.lit(1.0).alias("score"),
                     (F.col("run_id").cast("long") % 2 == 0).alias("passed"))
    tags = spark.range(1000).select(F.col("id").cast("string").alias("prompt_id"), F.lit("t").alias("tag"),
                                    F.lit("h").alias("classifier"), F.lit(1.0).alias("confidence"))
    models = runs.select(F.col("model").alias("name")).distinct().withColumn("size_params_b", F.lit(1.0)) \
                 .withColumn("context_window", F.lit(1).cast("long"))
    agg = A.agg_tag_model(tags, runs, models, ev, ["human_pass"])
    hot = agg.filter(F.col("model") == "hot").first()
    assert hot.n_evals == n // 3 and hot.n_passed == n // 6 and hot.n_passed_known == n // 3
    assert agg.agg(F.sum("n_evals")).first()[0] == n
    assert "partial_count" in _plan(agg)
