"""Fan-out work items, replaying recorded completions into runs, parsing
chat-completion payloads, and the recent-runs listing.

Model calls themselves are outside Spark (network clients are not rebuilt);
their outcomes arrive as data — a table of recorded payloads or errors — and
everything after the call is a Spark job.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.jsontext import json_value, let
from evalspark.functions.text import estimate_cost

#: models that one row of the fan-out's table of model blocks holds, about
FANOUT_BLOCK = 1000


def fanout_work(prompts: DataFrame, models: DataFrame, runs: DataFrame | None = None,
                prompt_ids: Sequence | None = None, model_names: Sequence[str] | None = None,
                skip_existing: bool = True) -> DataFrame:
    """(prompt_id, model) work items: every selected prompt x every selected
    model, minus pairs that already have a run unless ``skip_existing=False``.

    The models are packed into blocks of names, one row each; a prompt row is repeated
    once per block and opened into the block's names. No model name comes to the driver,
    only their number. The blocks are a table that Spark broadcasts where it has
    measured it to be small; beyond that it joins on the block, splitting the partitions
    that all prompts of a block make.
    """
    p = prompts.select("prompt_id")
    if prompt_ids is not None:
        p = p.filter(F.col("prompt_id").isin(list(prompt_ids)))
    m = models.select("name").where("name is not null").distinct()
    if model_names is not None:
        m = m.filter(F.col("name").isin(list(model_names)))
    n = max(1, -(-m.count() // FANOUT_BLOCK))
    blocks = m.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list("name").alias("names"))
    each = p.select("prompt_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    work = each.join(blocks, "block").select("prompt_id", F.explode("names").alias("model"))
    if skip_existing and runs is not None:
        work = work.join(runs.select("prompt_id", "model").distinct(), ["prompt_id", "model"], "left_anti")
    return work


def _first_line(c: Column) -> Column:
    return F.trim(F.substring_index(c, "\n", 1))


def parse_chat_payload(payload: Column) -> Column:
    """STRUCT<text, tokens_in, tokens_out, parse_error> from one completion body,
    which must be one JSON value with nothing after it."""
    return let(json_value(payload), _chat_payload)


def _chat_payload(v: Column) -> Column:
    choices = F.try_variant_get(v, "$.choices", "array<variant>")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    first = F.try_element_at(choices, F.lit(1))
    first_obj = F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False))
    msg = F.try_variant_get(first, "$.message", "variant")
    msg_obj = F.coalesce(F.schema_of_variant(msg).startswith("OBJECT"), F.lit(False))
    content_v = F.try_variant_get(msg, "$.content", "variant")
    has_content = F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(msg, "$", "map<string,variant>")),
                                              F.lit("content")), F.lit(False))
    err = (F.when(v.isNull(), F.lit("parse_error: JSONDecodeError('invalid JSON')"))
            .when(~is_obj | F.try_variant_get(v, "$.choices", "variant").isNull(), F.lit("parse_error: KeyError('choices')"))
            .when(choices.isNull(), F.lit("parse_error: TypeError('choices is not a list')"))
            .when(F.size(choices) == 0, F.lit("parse_error: IndexError('list index out of range')"))
            .when(~first_obj | msg.isNull(), F.lit("parse_error: KeyError('message')"))
            .when(~msg_obj | ~has_content, F.lit("parse_error: KeyError('content')")))
    text = F.coalesce(F.try_variant_get(content_v, "$", "string"), F.lit(""))
    usage = F.try_variant_get(v, "$.usage", "variant")
    return F.struct(F.when(err.isNull(), text).alias("text"),
                    F.when(err.isNull(), F.try_variant_get(usage, "$.prompt_tokens", "bigint")).alias("tokens_in"),
                    F.when(err.isNull(), F.try_variant_get(usage, "$.completion_tokens", "bigint")).alias("tokens_out"),
                    err.alias("parse_error"))


def parse_chat_replies(replies: DataFrame, models: DataFrame) -> DataFrame:
    """Recorded call outcomes (prompt_id, model, payload, http_error, latency_ms)
    -> run fields. An HTTP error keeps only its first line, prefixed
    ``http_error:``; a malformed body becomes a ``parse_error:`` row instead of
    failing the job. Cost comes from the model's per-token prices."""
    m = models.select(F.col("name").alias("model"), "cost_in_per_mtok", "cost_out_per_mtok")
    p = replies.withColumn("_p", parse_chat_payload(F.col("payload"))).join(m, "model", "left")
    error = F.when(F.col("http_error").isNotNull(), F.concat(F.lit("http_error: "), _first_line(F.col("http_error")))) \
             .otherwise(F.col("_p.parse_error"))
    ok = error.isNull()
    return p.select("prompt_id", "model",
                    F.when(ok, F.col("_p.text")).alias("response"),
                    F.when(ok, F.col("_p.tokens_in")).alias("tokens_in"),
                    F.when(ok, F.col("_p.tokens_out")).alias("tokens_out"),
                    F.when(ok, F.col("latency_ms")).cast("bigint").alias("latency_ms"),
                    F.when(ok, estimate_cost(F.col("_p.tokens_in"), F.col("_p.tokens_out"),
                                             F.col("cost_in_per_mtok"), F.col("cost_out_per_mtok"))).alias("cost_usd"),
                    error.alias("error"))


def fanout_replay(work: DataFrame, replies: DataFrame, models: DataFrame, created_at,
                  temperature: float = 0.0, system: str | None = None,
                  extra_metadata: dict | None = None) -> dict[str, DataFrame]:
    """Runs for work items from recorded replies (left join on prompt, model:
    a work item without a reply becomes a failed run). ``run_metadata`` is
    NULL unless a system prompt or extra metadata was given."""
    # one recorded outcome per work item: if a pair was recorded more than once,
    # keep the smallest (payload, error, latency) so reruns give the same runs
    one = (replies.groupBy("prompt_id", "model")
           .agg(F.min(F.struct("payload", "http_error", "latency_ms")).alias("_r"))
           .select("prompt_id", "model", "_r.*"))
    parsed = parse_chat_replies(one, models)
    j = work.join(parsed, ["prompt_id", "model"], "left")
    err = F.coalesce(F.col("error"), F.when(F.col("response").isNull(), F.lit("http_error: no recorded reply")))
    meta = {}
    if system is not None:
        meta["system"] = system
    meta.update(extra_metadata or {})
    import json
    meta_col = F.lit(json.dumps(meta) if meta else None).cast("string")
    ts = F.to_timestamp(F.lit(str(created_at)))
    run_id = F.sha2(F.concat_ws("|", F.col("prompt_id").cast("string"), F.col("model"), F.lit(str(created_at))), 256)
    runs = j.select(run_id.alias("run_id"), "prompt_id", "model", "response", "tokens_in", "tokens_out",
                    "latency_ms", "cost_usd", F.lit(temperature).alias("temperature"),
                    F.lit(None).cast("double").alias("top_p"), F.lit(None).cast("bigint").alias("seed"),
                    meta_col.alias("run_metadata"), err.alias("error"), ts.alias("created_at"))
    counters = runs.agg(F.count(F.lit(1)).alias("attempted"),
                        F.count_if(F.col("error").isNull()).alias("succeeded"),
                        F.count_if(F.col("error").isNotNull()).alias("failed"))
    return {"runs": runs, "counters": counters}


def recent_runs(runs: DataFrame, models: DataFrame, prompts: DataFrame, limit: int = 20,
                preview: int = 80) -> DataFrame:
    """Newest runs of known models and prompts with an 80-character prompt
    preview. The top N are taken over keys (a per-partition top-k merged once);
    only those N rows meet the prompts' texts."""
    r = runs.select("run_id", "prompt_id", "model", "created_at", "latency_ms", "cost_usd", "error")
    newest = [F.desc("created_at"), F.asc("run_id")]
    top = (r.join(models.select(F.col("name").alias("model")), "model", "left_semi")
            .join(prompts.select("prompt_id"), "prompt_id", "left_semi").orderBy(*newest).limit(limit))
    p = prompts.select("prompt_id", F.substring("content", 1, preview).alias("prompt_preview"))
    return top.join(p, "prompt_id").orderBy(*newest)
