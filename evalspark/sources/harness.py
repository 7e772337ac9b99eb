"""Import a wide agent-run log into prompts, models, runs and evaluations.

One pass over the log: anti-join on already imported ids, first-wins prompt
per content hash (``min_by`` — partial aggregation, skew-safe), new model
names, runs, and evaluations by unpivoting the score columns (NULLs dropped).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.jsontext import json_value
from evalspark.functions.judges import is_blank, strip_ws
from evalspark.functions.rows import one_row
from evalspark.functions.text import content_hash, normalize_prompt, parse_timestamp, provider_family

SOURCE_NAME = "ai_harness"
# Judge model credited for the imported scores, the score columns, and the
# notes stored with imported evaluations.
SCORER_MODEL = "google/gemini-2.0-flash-001"
AUTO_RUBRICS = ("complexity", "usefulness", "data_value", "scalability")
HUMAN_NOTE = "Imported from AI Harness `success` column."
AUTO_NOTE = "Imported from AI Harness Gemini-Flash scorer."
ARR = "array<variant>"


def _final_response(conv_json) -> F.Column:
    """Last non-blank assistant message, else last non-blank message of any role."""
    msgs = F.try_variant_get(F.try_parse_json(conv_json), "$", ARR)

    def content(m):
        c = F.try_variant_get(m, "$.content", "variant")
        return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))

    def ok(m):
        return F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)) & ~is_blank(content(m))
    asst = F.filter(msgs, lambda m: ok(m) & (F.try_variant_get(m, "$.role", "string") == "assistant"))
    anyr = F.filter(msgs, lambda m: ok(m))
    pick = F.coalesce(F.try_element_at(asst, F.lit(-1)), F.try_element_at(anyr, F.lit(-1)))
    return strip_ws(F.try_variant_get(F.try_variant_get(pick, "$.content", "variant"), "$", "string"))


def _json_or_text(name: str) -> F.Column:
    """A column's JSON value; a text that is no JSON stays a string."""
    return F.coalesce(json_value(F.col(name)), F.col(name).cast("variant")).alias(name)


def import_harness_log(log: DataFrame, stored_prompts: DataFrame | None, stored_models: DataFrame | None,
                       known_ids: DataFrame | None, order: str = "id") -> dict[str, DataFrame]:
    """Returns new prompts, models, runs, evaluations and one counters row.

    Order quirk kept: a row with a task but no model still creates its prompt. Tasks
    are stripped before they are hashed and counted.
    """
    rows = log.withColumn("task", strip_ws(F.col("task")))
    if known_ids is not None:
        rows = rows.join(known_ids.select(F.col("ai_harness_id").alias("id")), "id", "left_anti")
    task_ok = ~is_blank(F.col("task"))
    model = F.coalesce(F.nullif(F.col("worker_model"), F.lit("")), F.nullif(F.col("supervisor_model"), F.lit("")))
    rows = rows.withColumn("_task_ok", task_ok).withColumn("_model", model) \
               .withColumn("_hash", F.when(task_ok, content_hash(F.col("task"))))
    with_task = rows.filter("_task_ok")
    firsts = (with_task.groupBy("_hash")
              .agg(F.min_by(F.struct("id", "task", "project_id", "timestamp"), F.col(order)).alias("f")))
    if stored_prompts is not None:
        known_h = stored_prompts.select(F.col("content_hash").alias("_hash")).withColumn("_known", F.lit(True))
        firsts = firsts.join(known_h, "_hash", "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    new_prompts = (firsts.filter(F.col("_known").isNull())
                   .select(F.col("_hash").alias("prompt_id"), normalize_prompt(F.col("f.task")).alias("content"),
                           F.col("_hash").alias("content_hash"), F.lit(None).cast("bigint").alias("token_count"),
                           F.length("f.task").cast("bigint").alias("char_count"), F.lit(SOURCE_NAME).alias("source"),
                           F.col("f.id").cast("string").alias("source_ref"),
                           F.to_json(F.struct(F.col("f.project_id").alias("project_id"))).alias("source_metadata"),
                           parse_timestamp(F.col("f.timestamp")).alias("created_at")))
    runnable = with_task.filter(F.col("_model").isNotNull())
    names = runnable.select(F.col("_model").alias("name")).distinct()
    if stored_models is not None:
        names = names.join(stored_models.select("name"), "name", "left_anti")
    prov, fam = provider_family(F.col("name"))
    new_models = names.select("name", prov.alias("provider"), fam.alias("family"), F.lit(False).alias("local"))
    meta = F.to_json(F.struct(
        F.col("id").cast("string").alias("ai_harness_id"), F.col("supervisor_model"),
        _json_or_text("worker_sequence"), F.col("num_loops"),
        F.col("total_tokens"), _json_or_text("tools_used"),
        _json_or_text("tool_results"),
        F.coalesce(F.col("coder_flagged_complete").cast("boolean"), F.lit(False)).alias("coder_flagged_complete")))
    run_id = F.concat(F.lit("ai_harness:"), F.col("id").cast("string"))
    runs = runnable.select(run_id.alias("run_id"), F.col("_hash").alias("prompt_id"), F.col("_model").alias("model"),
                           _final_response(F.col("conversation_messages")).alias("response"),
                           F.lit(None).cast("bigint").alias("tokens_in"), F.lit(None).cast("bigint").alias("tokens_out"),
                           (F.col("run_duration_seconds") * 1000).cast("bigint").alias("latency_ms"),
                           F.col("estimated_api_cost_usd").cast("double").alias("cost_usd"),
                           meta.alias("run_metadata"), F.lit(None).cast("string").alias("error"),
                           parse_timestamp(F.col("timestamp")).alias("created_at"))
    human = (runnable.filter(F.col("success").isNotNull())
             .select(run_id.alias("run_id"), F.lit("human_pass").alias("rubric"),
                     F.col("success").cast("double").alias("score"), F.col("success").cast("boolean").alias("passed"),
                     F.lit("human").alias("scored_by"), F.lit(None).cast("string").alias("judge_model"),
                     F.lit(HUMAN_NOTE).alias("notes")))
    score_cols = [f"{r}_score" for r in AUTO_RUBRICS]
    auto = (runnable.select(run_id.alias("run_id"), *[F.col(c).cast("double") for c in score_cols])
            .unpivot("run_id", score_cols, "rubric", "score")
            .filter(F.col("score").isNotNull())
            .select("run_id", F.regexp_replace("rubric", "_score$", "").alias("rubric"), "score",
                    F.lit(None).cast("boolean").alias("passed"), F.lit("llm").alias("scored_by"),
                    F.lit(SCORER_MODEL).alias("judge_model"),
                    F.lit(AUTO_NOTE).alias("notes")))
    evals = human.unionByName(auto)
    counters = (one_row(log.agg(F.count(F.lit(1)).alias("runs_seen")),
                        rows.agg(F.count(F.lit(1)).alias("_left"),
                                 F.count_if(~F.col("_task_ok") | F.col("_model").isNull()).alias("errors")),
                        runs.agg(F.count(F.lit(1)).alias("runs_imported")),
                        firsts.agg(F.count_if(F.col("_known").isNull()).alias("prompts_inserted"),
                                   F.count_if(F.col("_known")).alias("prompts_deduped")),
                        new_models.agg(F.count(F.lit(1)).alias("models_registered")),
                        evals.agg(F.count(F.lit(1)).alias("evaluations_inserted")))
                .select("runs_seen", "runs_imported", (F.col("runs_seen") - F.col("_left")).alias("runs_skipped_existing"),
                        "prompts_inserted", "prompts_deduped", "models_registered", "evaluations_inserted", "errors"))
    return {"prompts": new_prompts, "models": new_models, "runs": runs, "evaluations": evals,
            "counters": counters}
