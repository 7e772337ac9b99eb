"""Fan-out, replay, payload parsing and recent runs (F1 conversation turns, F2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import runs as RU
from evalspark.plans.fixtures import F2, f1_turn_runs, with_views
from evalspark.plans.registry import register

AS_OF = "2024-06-01 00:00:00"
F1_MODELS = [f"m-{i}" for i in range(5)]


def f1_prompts(spark, d):
    r = f1_turn_runs(spark, d)
    return r.select(F.col("run_id").alias("prompt_id"), F.col("prompt").alias("content"))


def f1_models(spark, d):
    r = f1_turn_runs(spark, d)
    k = F.substring("model", 3, 2).cast("int")
    return (r.select("model").distinct()
             .select(F.col("model").alias("name"), ((k + 1) * F.lit(0.5)).alias("cost_in_per_mtok"),
                     F.when(k == 2, F.lit(None).cast("double")).otherwise((k + 1) * F.lit(1.5)).alias("cost_out_per_mtok")))


def f1_runs(spark, d):
    r = f1_turn_runs(spark, d)
    return r.select("run_id", F.col("run_id").alias("prompt_id"), "model")


def f1_replies(spark, d):
    """One recorded outcome per (prompt, model) pair, in the shapes APIs return."""
    r = f1_turn_runs(spark, d)
    x = r.select(F.col("run_id").alias("prompt_id"), "prompt", "response", "conv_id", "turn",
                 F.explode(F.array(*[F.lit(m) for m in F1_MODELS])).alias("model"))
    k = (F.col("conv_id") + F.col("turn") + F.substring("model", 3, 2).cast("int"))
    body = F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": '),
                    F.regexp_replace(F.to_json(F.array("response")), r"^\[|\]$", ""),
                    F.lit('}}], "usage": {"prompt_tokens": '), F.floor(F.length("prompt") / 4).cast("string"),
                    F.lit(', "completion_tokens": '), F.floor(F.length("response") / 4).cast("string"), F.lit("}}"))
    payload = (F.when(k % 7 == 0, F.lit(None).cast("string"))
                .when(k % 11 == 0, F.lit('{"choices": []}'))
                .when(k % 13 == 0, F.lit('{"error": {"message": "rate limited"}}'))
                .when(k % 17 == 0, F.lit('{"choices": [{"message": {"content": null}}], "usage": {"prompt_tokens": 5}}'))
                .otherwise(body))
    http = F.when(k % 7 == 0, F.lit("HTTPStatusError: 500 Internal Server Error\nFor more information check: x"))
    return x.select("prompt_id", "model", payload.alias("payload"), http.alias("http_error"),
                    ((F.col("conv_id") * 37 + F.col("turn")) % 900 + 100).cast("int").alias("latency_ms"))


F1_SQL = {
    "f1_prompts": "select run_id as prompt_id, prompt as content from f1_turn_runs",
    "f1_models": """select distinct model as name, (cast(substr(model, 3, 2) as int) + 1) * 0.5e0 as cost_in_per_mtok,
                    case when cast(substr(model, 3, 2) as int) = 2 then null
                         else (cast(substr(model, 3, 2) as int) + 1) * 1.5e0 end as cost_out_per_mtok from f1_turn_runs""",
    "f1_runs": "select run_id, run_id as prompt_id, model from f1_turn_runs",
    "f1_x": """select r.run_id as prompt_id, r.prompt, r.response, r.conv_id, r.turn, m.model,
                      r.conv_id + r.turn + cast(substr(m.model, 3, 2) as int) as k
               from f1_turn_runs r, (select unnest(['m-0', 'm-1', 'm-2', 'm-3', 'm-4']) as model) m""",
    "f1_replies": """
select prompt_id, model,
       case when k % 7 = 0 then null
            when k % 11 = 0 then '{"choices": []}'
            when k % 13 = 0 then '{"error": {"message": "rate limited"}}'
            when k % 17 = 0 then '{"choices": [{"message": {"content": null}}], "usage": {"prompt_tokens": 5}}'
            else concat('{"choices": [{"message": {"role": "assistant", "content": ', to_json(response),
                        '}}], "usage": {"prompt_tokens": ', cast(floor(length(prompt) / 4) as bigint),
                        ', "completion_tokens": ', cast(floor(length(response) / 4) as bigint), '}}') end as payload,
       case when k % 7 = 0 then 'HTTPStatusError: 500 Internal Server Error' end as http_error,
       cast((conv_id * 37 + turn) % 900 + 100 as int) as latency_ms,
       k
from f1_x""",
    "parsed": """
select r.prompt_id, r.model,
       case when r.http_error is not null then 'http_error: ' || r.http_error
            when r.k % 11 = 0 then 'parse_error: IndexError(''list index out of range'')'
            when r.k % 13 = 0 then 'parse_error: KeyError(''choices'')' end as error,
       json_extract_string(r.payload, '$.choices[0].message.content') as content,
       cast(json_extract(r.payload, '$.usage.prompt_tokens') as bigint) as tokens_in,
       cast(json_extract(r.payload, '$.usage.completion_tokens') as bigint) as tokens_out,
       r.latency_ms, m.cost_in_per_mtok as ci, m.cost_out_per_mtok as co
from f1_replies r left join f1_models m on m.name = r.model""",
    "chat": """
select prompt_id, model,
       case when error is null then coalesce(content, '') end as response,
       case when error is null then tokens_in end as tokens_in,
       case when error is null then tokens_out end as tokens_out,
       case when error is null then cast(latency_ms as bigint) end as latency_ms,
       case when error is null then
         (case when tokens_in is null or tokens_out is null then null
               when ci is null and co is null then null
               else 0e0 + (case when ci is not null then (tokens_in / 1000000e0) * ci else 0e0 end)
                        + (case when co is not null then (tokens_out / 1000000e0) * co else 0e0 end) end) end as cost_usd,
       error
from parsed""",
}
F1V = ("f1_turn_runs",)


@register("fanout_work", with_views("""
select p.prompt_id, m.name as model from f1_prompts p, f1_models m
where not exists (select 1 from f1_runs r where r.prompt_id = p.prompt_id and r.model = m.name)""", *F1V, extra=F1_SQL))
def q_fanout_work(spark, d):
    return RU.fanout_work(f1_prompts(spark, d), f1_models(spark, d), f1_runs(spark, d))


@register("parse_chat_replies", with_views("select * from chat", *F1V, extra=F1_SQL))
def q_parse_chat(spark, d):
    return RU.parse_chat_replies(f1_replies(spark, d), f1_models(spark, d))


@register("fanout_replay", with_views(f"""
select sha256(concat_ws('|', w.prompt_id, w.model, '{AS_OF}')) as run_id, w.prompt_id, w.model, c.response,
       c.tokens_in, c.tokens_out, c.latency_ms, c.cost_usd,
       coalesce(c.error, case when c.response is null then 'http_error: no recorded reply' end) as error
from (select p.prompt_id, m.name as model from f1_prompts p, f1_models m
      where not exists (select 1 from f1_runs r where r.prompt_id = p.prompt_id and r.model = m.name)) w
left join chat c on c.prompt_id = w.prompt_id and c.model = w.model""", *F1V, extra=F1_SQL))
def q_fanout_replay(spark, d):
    work = RU.fanout_work(f1_prompts(spark, d), f1_models(spark, d), f1_runs(spark, d))
    out = RU.fanout_replay(work, f1_replies(spark, d), f1_models(spark, d), AS_OF)
    return out["runs"].select("run_id", "prompt_id", "model", "response", "tokens_in", "tokens_out",
                              "latency_ms", "cost_usd", "error")


@register("fanout_replay_counters", with_views("""
select count(*) as attempted, count(*) filter (where error is null) as succeeded,
       count(*) filter (where error is not null) as failed
from (select c.error from f1_prompts p cross join f1_models m
      left join chat c on c.prompt_id = p.prompt_id and c.model = m.name) t""", *F1V, extra=F1_SQL))
def q_fanout_counters(spark, d):
    work = RU.fanout_work(f1_prompts(spark, d), f1_models(spark, d), None, skip_existing=False)
    return RU.fanout_replay(work, f1_replies(spark, d), f1_models(spark, d), AS_OF)["counters"]


@register("recent_runs", with_views("""
select r.run_id, r.prompt_id, r.model, r.created_at, r.latency_ms, r.cost_usd, r.error,
       substr(p.content, 1, 80) as prompt_preview
from f2_runs r join f2_models m on m.name = r.model join f2_prompts p on p.prompt_id = r.prompt_id
order by r.created_at desc, r.run_id asc limit 25""", "f2_runs", "f2_models", "f2_prompts"))
def q_recent(spark, d):
    f = F2(spark, d)
    return RU.recent_runs(f.runs, f.models, f.prompts, 25)
