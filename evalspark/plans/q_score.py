"""Judge, scoring, bench and refusal queries on F4 (templated prompts with
scripted replies) and on a judge-reply table derived from orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.judges import build_judge
from evalspark.functions.rubrics import BENCH_RUBRIC, shipped
from evalspark.operators import bench as B
from evalspark.operators.scoring import Rubric, score_runs
from evalspark.plans.fixtures import f4_prompts, f4_runs, table, with_views
from evalspark.plans.registry import register

NO_REFUSAL = shipped("no_refusal")
SCOPED = Rubric(name="coding_contains", judge_kind="contains",
                judge_config={"any_of": ["answer", "sized"], "all_of": ["partial"]},
                applies_to_tags=["coding", "math"], description="scoped contains")
AS_OF = "2024-06-01 00:00:00"
F4V = ("f4_prompts", "f4_runs")


# ---------------------------------------------------------------- F4 side tables

def f4_prompt_tags(spark, d):
    p = f4_prompts(spark, d)
    return (p.select("prompt_id", F.get_json_object("source_metadata", "$.intended_tag").alias("tag"),
                     F.lit("bench").alias("classifier"), F.lit(1.0).alias("confidence"))
             .filter(F.col("tag") != "other"))


def f4_models(spark, d):
    r = f4_runs(spark, d)
    k = F.substring("model", 3, 2).cast("int")
    return (r.select("model").distinct()
             .select(F.col("model").alias("name"), F.lit("local").alias("provider"),
                     ((k + 1) * F.lit(3.5)).alias("size_params_b"),
                     F.lit(8192).cast("int").alias("context_window")))


def f4_existing_evals(spark, d, rubric: Rubric = NO_REFUSAL):
    r = f4_runs(spark, d)
    k = F.col("prompt_id") % 5
    cur = rubric.config_hash()
    return (r.filter(k < 4)
             .select("run_id",
                     F.when(k == 3, F.lit("other_rubric")).otherwise(F.lit(rubric.name)).alias("rubric"),
                     F.when(k == 1, F.lit("stale-hash")).when(k == 2, F.lit(cur))
                      .otherwise(F.lit(None).cast("string")).alias("rubric_hash"),
                     F.lit(1.0).alias("score"), F.lit(True).alias("passed"),
                     F.lit("auto").alias("scored_by"),
                     F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at")))


def f4_runs_store(spark, d):
    return f4_runs(spark, d).withColumn("cost_usd", (F.col("prompt_id") % 7) / F.lit(64.0)) \
                            .withColumn("latency_ms", (F.col("prompt_id") % 11 * 100).cast("int"))


def _sql_ctes(rubric: Rubric = NO_REFUSAL) -> dict[str, str]:
    cur = rubric.config_hash()
    return {
        "f4_prompt_tags": """select prompt_id, json_extract_string(source_metadata, '$.intended_tag') as tag,
                             1e0 as confidence, 'bench' as classifier from f4_prompts
                             where json_extract_string(source_metadata, '$.intended_tag') <> 'other'""",
        "f4_models": """select distinct model as name, 'local' as provider,
                        (cast(substr(model, 3, 2) as int) + 1) * 3.5e0 as size_params_b,
                        cast(8192 as int) as context_window from f4_runs""",
        "f4_store_runs": """select *, (prompt_id % 7) / 64e0 as cost_usd, cast(prompt_id % 11 * 100 as int) as latency_ms
                            from f4_runs""",
        "f4_existing": f"""select run_id, case when prompt_id % 5 = 3 then 'other_rubric' else '{rubric.name}' end as rubric,
                    case when prompt_id % 5 = 1 then 'stale-hash' when prompt_id % 5 = 2 then '{cur}' end as rubric_hash,
                    1e0 as score, true as passed, 'auto' as scored_by, timestamp '2024-01-01 00:00:00' as created_at
                    from f4_runs where prompt_id % 5 < 4""",
    }


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_sql(resp: str, all_of=(), any_of=(), none_of=()) -> dict[str, str]:
    """Score/passed/notes of the contains judge (case-insensitive) in DuckDB."""
    hay = f"lower({resp})"
    has = (lambda n: f"contains({hay}, {_sql_str(n.lower())})")
    forb = " or ".join(has(n) for n in none_of) or "false"
    hits = " + ".join(f"(case when {has(n)} then 1 else 0 end)" for n in all_of) or "0"
    anyh = " or ".join(has(n) for n in any_of) or "true"
    base = f"({hits}) / {len(all_of)}" if all_of else "1e0"
    fnote = "concat('forbidden tokens present: [', concat_ws(', ', " + ", ".join(
        f"case when {has(n)} then {_sql_str(repr(n))} end" for n in none_of) + "), ']')" if none_of else "null"
    return {
        "score": f"case when {forb} then 0e0 when not ({anyh}) then 0e0 else cast({base} as double) end",
        "passed": f"case when {forb} then false else (({hits}) = {len(all_of)} and ({anyh})) end",
        "notes": f"case when {forb} then {fnote} else concat('all_of matched ', cast(({hits}) as varchar), "
                 f"'/{len(all_of)}; any_of satisfied=', case when {anyh} then 'True' else 'False' end) end",
    }


def _judge_query(spark, d, kind, config, cols=("score", "passed", "notes")):
    r = f4_runs(spark, d)
    v = build_judge(kind, config)(F.col("prompt"), F.col("response"), F.col("source_metadata"))
    return r.select("run_id", *[v[c].alias(c) for c in cols])


# ---------------------------------------------------------------- judges

_NR = contains_sql("response", none_of=NO_REFUSAL.judge_config["none_of"])


@register("judge_contains", with_views(
    f"select run_id, {_NR['score']} as score, {_NR['passed']} as passed, {_NR['notes']} as notes from f4_runs", *F4V))
def q_judge_contains(spark, d):
    return _judge_query(spark, d, "contains", NO_REFUSAL.judge_config)


_CA = contains_sql("response", all_of=["partial", "sized"], any_of=["answer", "json"])


@register("judge_contains_all_any", with_views(
    f"select run_id, {_CA['score']} as score, {_CA['passed']} as passed, {_CA['notes']} as notes from f4_runs", *F4V))
def q_judge_contains2(spark, d):
    return _judge_query(spark, d, "contains", {"all_of": ["Partial", "sized"], "any_of": ["answer", "JSON"]})


@register("judge_exact_match", with_views("""
select run_id, case when m then 1e0 else 0e0 end as score, m as passed,
       case when not m then 'expected=''I cannot  help with that. ''' end as notes
from (select run_id, coalesce(lower(trim(regexp_replace(response, '\\s+', ' ', 'g'))) = 'i cannot help with that.', false) as m
      from f4_runs) x""", *F4V))
def q_judge_exact(spark, d):
    return _judge_query(spark, d, "exact_match", {"expected": "I cannot  help with that. "})


@register("judge_expected_contains", with_views("""
select run_id,
       case when n is null or n = 0 then 0e0 else hits / n end as score,
       case when n is null or n = 0 then null else hits = n end as passed
from (select run_id,
             case when json_type(source_metadata, '$.expected_contains') = 'ARRAY'
                  then json_array_length(source_metadata, '$.expected_contains') end as n,
             len(list_filter(json_extract_string(source_metadata, '$.expected_contains[*]'),
                             lambda x: contains(lower(response), lower(x)))) as hits
      from f4_runs) t""", *F4V))
def q_judge_expected(spark, d):
    return _judge_query(spark, d, "expected_contains", {"metadata_key": "expected_contains"}, ("score", "passed"))


@register("judge_expected_contains_fail", with_views("""
select run_id,
       case when n is null or n = 0 then 0e0 else hits / n end as score,
       case when n is null or n = 0 then false else hits = n end as passed
from (select run_id,
             case when json_type(source_metadata, '$.expected_contains') = 'ARRAY'
                  then json_array_length(source_metadata, '$.expected_contains') end as n,
             len(list_filter(json_extract_string(source_metadata, '$.expected_contains[*]'),
                             lambda x: contains(response, x))) as hits
      from f4_runs) t""", *F4V))
def q_judge_expected_fail(spark, d):
    return _judge_query(spark, d, "expected_contains",
                        {"metadata_key": "expected_contains", "on_missing": "fail", "case_sensitive": True},
                        ("score", "passed"))


@register("judge_json_valid", with_views("""
select run_id,
       case when not json_valid(trim(response)) then 0e0
            when json_type(trim(response)) <> 'OBJECT' then 0e0
            else 1e0 - ((case when json_exists(trim(response), '$.answer') then 0 else 1 end)
                       + (case when json_exists(trim(response), '$.size') then 0 else 1 end)
                       + (case when json_exists(trim(response), '$.price') then 0 else 1 end)) / 3 end as score,
       case when not json_valid(trim(response)) then false
            when json_type(trim(response)) <> 'OBJECT' then false
            else json_exists(trim(response), '$.answer') and json_exists(trim(response), '$.size')
                 and json_exists(trim(response), '$.price') end as passed
from f4_runs""", *F4V))
def q_judge_json(spark, d):
    return _judge_query(spark, d, "json_valid", {"required_keys": ["answer", "size", "price"]}, ("score", "passed"))


@register("judge_regex", with_views("""
select run_id, case when m then 1e0 else 0e0 end as score, m as passed,
       case when m then concat('matched: ''', substr(regexp_extract(response, '(?i)sized \\d+'), 1, 80), '''')
            else 'no match for /SIZED \\d+/' end as notes
from (select run_id, response, regexp_matches(response, '(?i)sized \\d+') as m from f4_runs) x""", *F4V))
def q_judge_regex(spark, d):
    return _judge_query(spark, d, "regex", {"pattern": "SIZED \\d+", "flags": "i"})


def judge_replies(spark, d):
    """Recorded judge-model replies, one per order, in the shapes models emit."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    s = (k % 6).cast("string")
    reply = (F.when(k % 5 == 0, F.concat(F.lit('{"score": '), s, F.lit(', "reasoning": "ok"}')))
              .when(k % 5 == 1, F.concat(F.lit('Verdict: {"score": '), s, F.lit(', "passed": false} done')))
              .when(k % 5 == 2, F.lit('{"score": "high", "passed": null}'))
              .when(k % 5 == 3, F.concat(F.lit('{"score": "'), s, F.lit('", "passed": true}')))
              .otherwise(F.lit("no json here")))
    return o.select(k.cast("string").alias("run_id"), reply.alias("reply"))


@register("judge_llm_reply", """
select cast(o_orderkey as varchar) as run_id,
       case when k5 in (0, 1, 3) then cast(s as double) else 0e0 end as score,
       case k5 when 0 then s >= 4 when 1 then false when 2 then false when 3 then true end as passed,
       case k5 when 0 then 'ok' when 4 then 'judge returned unparseable: ''no json here''' end as notes
from (select o_orderkey, o_orderkey % 5 as k5, o_orderkey % 6 as s from orders) t""")
def q_judge_llm(spark, d):
    r = judge_replies(spark, d)
    v = build_judge("llm", {"pass_threshold": 4, "model": "judge-m"})(F.lit(""), F.col("reply"))
    return r.select("run_id", v["score"].alias("score"), v["passed"].alias("passed"), v["notes"].alias("notes"))


# ---------------------------------------------------------------- scoring

def _score(spark, d, mode, rubric=NO_REFUSAL, with_tags=False):
    return score_runs(rubric, f4_runs(spark, d), f4_prompts(spark, d), f4_existing_evals(spark, d, rubric),
                      prompt_tags=f4_prompt_tags(spark, d) if with_tags else None, as_of=AS_OF, mode=mode)


def _score_sql(mode: str, rubric: Rubric = NO_REFUSAL, scoped=False) -> dict[str, str]:
    cur = rubric.config_hash()
    c = _sql_ctes(rubric)
    if rubric.judge_kind == "contains":
        js = contains_sql("r.response", **{k: v for k, v in rubric.judge_config.items() if k != "case_sensitive"})
    else:  # pragma: no cover
        raise ValueError(rubric.judge_kind)
    fresh = (f"select distinct run_id from f4_existing where rubric = '{rubric.name}' "
             f"and (rubric_hash is null or rubric_hash = '{cur}')")
    if mode != "skip":
        fresh = "select run_id from f4_existing where false"
    tag_ok = ("select distinct prompt_id from f4_prompt_tags where tag in ("
              + ", ".join(_sql_str(t) for t in rubric.applies_to_tags) + ")") if scoped else "select prompt_id from f4_prompts"
    c["dec"] = f"""
select r.run_id, r.prompt_id, r.response,
       case when r.run_id in (select run_id from ({fresh})) then 'skipped_existing'
            when r.response is null or trim(r.response) = '' then 'skipped_no_response'
            when r.prompt_id not in ({tag_ok}) then 'skipped_tag_mismatch'
            else 'evaluated' end as decision,
       {js['score']} as score, {js['passed']} as passed, {js['notes']} as notes
from f4_runs r"""
    c["new"] = f"""
select run_id, '{rubric.name}' as rubric, '{cur}' as rubric_hash, score, passed,
       '{'llm' if rubric.judge_kind == 'llm' else 'auto'}' as scored_by, timestamp '{AS_OF}' as created_at
from dec where decision = 'evaluated'"""
    if mode == "replace":
        deleted = f"rubric = '{rubric.name}'"
    elif mode == "skip":
        deleted = f"rubric = '{rubric.name}' and rubric_hash is not null and rubric_hash <> '{cur}'"
    else:
        deleted = "false"
    c["kept"] = f"select run_id, rubric, rubric_hash, score, passed, scored_by, created_at from f4_existing where not ({deleted})"
    c["removed"] = f"select count(*) as n from f4_existing where {deleted}"
    return c


EVAL_COLS = ["run_id", "rubric", "rubric_hash", "score", "passed", "scored_by", "created_at"]


@register("score_runs", with_views("select * from new", *F4V, extra=_score_sql("skip", SCOPED, True)))
def q_score_runs(spark, d):
    return _score(spark, d, "skip", SCOPED, True)["new"].select(*EVAL_COLS)


@register("score_counters", with_views("""
select count(*) as runs_seen, count(*) filter (where decision = 'evaluated') as runs_evaluated,
       count(*) filter (where decision = 'evaluated') as evaluations_written,
       count(*) filter (where decision = 'skipped_existing') as skipped_existing,
       count(*) filter (where decision = 'skipped_no_response') as skipped_no_response,
       count(*) filter (where decision = 'skipped_tag_mismatch') as skipped_tag_mismatch,
       cast(0 as bigint) as errors, cast(0 as bigint) as replaced, (select n from removed) as stale_replaced
from dec""", *F4V, extra=_score_sql("skip", SCOPED, True)))
def q_score_counters(spark, d):
    return _score(spark, d, "skip", SCOPED, True)["counters"]


@register("score_stale", with_views("select * from kept union all select * from new", *F4V,
                                    extra=_score_sql("skip")))
def q_score_stale(spark, d):
    return _score(spark, d, "skip")["evaluations"].select(*EVAL_COLS)


@register("score_replay", with_views("select * from kept union all select * from new", *F4V,
                                     extra=_score_sql("replace")))
def q_score_replay(spark, d):
    return _score(spark, d, "replace")["evaluations"].select(*EVAL_COLS)


@register("score_append", with_views("select * from kept union all select * from new", *F4V,
                                     extra=_score_sql("append")))
def q_score_append(spark, d):
    return _score(spark, d, "append")["evaluations"].select(*EVAL_COLS)


# ---------------------------------------------------------------- bench and refusal

@register("refusal_rate", with_views("""
select r.model, count(*) as n, count(*) filter (where not coalesce(n.passed, false)) as n_refused,
       count(*) filter (where not coalesce(n.passed, false)) / count(*) as refusal_rate
from new n join f4_runs r on r.run_id = n.run_id group by r.model""", *F4V, extra=_score_sql("append")))
def q_refusal(spark, d):
    new = _score(spark, d, "append")["new"]
    return B.refusal_rate(f4_runs(spark, d), new, "no_refusal")


@register("refused_prompts", with_views("""
select r.model, r.prompt_id, substring(p.content, 1, 65) as preview
from new n join f4_runs r on r.run_id = n.run_id join f4_prompts p on p.prompt_id = r.prompt_id
where n.rubric = 'no_refusal' and not coalesce(n.passed, false)""", *F4V, extra=_score_sql("append")))
def q_refused_prompts(spark, d):
    new = _score(spark, d, "append")["new"]
    return B.refused_prompts(f4_runs(spark, d), f4_prompts(spark, d), new, "no_refusal")


@register("bench_breakdown", with_views("""
select category, model, n_runs, pass_count, avg_score, pass_rate, avg_cost_usd,
       case when avg_cost_usd is not null and pass_rate > 0 then avg_cost_usd / pass_rate end as cost_per_pass,
       avg_latency_ms
from (select *, case when n_known > 0 then pass_count / n_known else 0.0 end as pass_rate
      from (select coalesce(json_extract_string(p.source_metadata, '$.intended_tag'), 'uncategorized') as category,
                   r.model, count(*) as n_runs,
                   cast(sum(case when e.passed then 1 else 0 end) as bigint) as pass_count,
                   cast(sum(case when e.passed is not null then 1 else 0 end) as bigint) as n_known,
                   coalesce(avg(e.score), 0.0) as avg_score, avg(r.cost_usd) as avg_cost_usd,
                   avg(r.latency_ms) as avg_latency_ms
            from bench_evals e join f4_store_runs r on r.run_id = e.run_id
            join f4_prompts p on p.prompt_id = r.prompt_id
            join f4_models m on m.name = r.model
            where p.source = 'bench:f4'
            group by 1, 2) x) y""", *F4V, extra={**_sql_ctes(), "bench_evals": """
select run_id,
       case when n is null or n = 0 then 0e0 else hits / n end as score,
       case when n is null or n = 0 then null else hits = n end as passed
from (select r.run_id,
             case when json_type(p.source_metadata, '$.expected_contains') = 'ARRAY'
                  then json_array_length(p.source_metadata, '$.expected_contains') end as n,
             len(list_filter(json_extract_string(p.source_metadata, '$.expected_contains[*]'),
                             lambda x: contains(lower(r.response), lower(x)))) as hits
      from f4_runs r join f4_prompts p on p.prompt_id = r.prompt_id) t"""}))
def q_bench_breakdown(spark, d):
    runs = f4_runs_store(spark, d)
    prompts = f4_prompts(spark, d)
    ev = score_runs(BENCH_RUBRIC, runs, prompts, _no_evals(spark), as_of=AS_OF, mode="skip")["new"]
    bench = B.bench_prompts(prompts, source="bench:f4")
    return B.bench_breakdown(bench, runs, f4_models(spark, d), ev)


def _no_evals(spark):
    from evalspark.sources.store import empty
    return empty(spark, "evaluations")


def bench_replies(spark, d, models):
    """Recorded replies for every (bench item, model): some echo the item, some refuse."""
    from evalspark.functions.text import content_hash
    b = table(spark, d, "benchmark")
    x = b.select(content_hash(F.col("text")).alias("prompt_id"), "item_id", "text",
                 F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    k = F.col("item_id") + F.substring("model", 3, 2).cast("int")
    text = F.when(k % 3 == 0, F.lit("I cannot help with that.")).otherwise(F.col("text"))
    payload = F.concat(F.lit('{"choices": [{"message": {"content": '),
                       F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""),
                       F.lit('}}], "usage": {"prompt_tokens": 1000000, "completion_tokens": 3000000}}'))
    return x.select("prompt_id", "model", payload.alias("payload"), F.lit(None).cast("string").alias("http_error"),
                    (F.col("item_id") % 500 + 50).cast("int").alias("latency_ms"))


BENCH_RUN_SQL = """
with b as (select item_id, text, item_id % 4 as k,
                  sha256(trim(regexp_replace(text, '[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) as pid,
                  row_number() over (partition by item_id % 4 order by item_id) - 1 as idx
           from benchmark),
     firsts as (select pid, arg_min(item_id, k * 1000000000 + idx) as first_item from b group by pid),
     bp as (select f.pid, b.item_id, b.text,
                   case when b.item_id % 9 = 0 then 'uncategorized' else concat('cat', cast(b.k as varchar)) end as category,
                   case when b.item_id % 9 = 0 then null else split_part(b.text, ' ', 1) end as needle
            from firsts f join b on b.item_id = f.first_item),
     rep as (select bp.*, m.model, cast(substr(m.model, 3, 2) as int) as mk
             from bp, (select unnest(['m-0', 'm-1', 'm-2', 'm-3', 'm-4']) as model) m),
     ev as (select category, model,
                   case when (item_id + mk) % 3 = 0 then 'I cannot help with that.' else text end as resp,
                   needle, cast(item_id % 500 + 50 as bigint) as lat,
                   0e0 + (1000000 / 1000000e0) * ((mk + 1) * 0.5e0) + (3000000 / 1000000e0) * ((mk + 1) * 1.5e0) as cost
            from rep),
     sc as (select *, case when needle is null then null else contains(lower(resp), lower(needle)) end as passed,
                   case when needle is null then 0e0 when contains(lower(resp), lower(needle)) then 1e0 else 0e0 end as score
            from ev),
     g as (select category, model, count(*) as n_runs,
                  cast(sum(case when passed then 1 else 0 end) as bigint) as pass_count,
                  cast(sum(case when passed is not null then 1 else 0 end) as bigint) as n_known,
                  coalesce(avg(score), 0.0) as avg_score, avg(cost) as avg_cost_usd, avg(lat) as avg_latency_ms
           from sc group by category, model)
select category, model, n_runs, pass_count, avg_score,
       case when n_known > 0 then pass_count / n_known else 0.0 end as pass_rate, avg_cost_usd,
       case when avg_cost_usd is not null and (case when n_known > 0 then pass_count / n_known else 0.0 end) > 0
            then avg_cost_usd / (case when n_known > 0 then pass_count / n_known else 0.0 end) end as cost_per_pass,
       avg_latency_ms
from g"""


@register("bench_run", BENCH_RUN_SQL)
def q_bench_run(spark, d):
    from evalspark.functions.rubrics import BENCH_DIR_META_KEY
    from evalspark.plans.q_ingest import seed_docs
    from evalspark.plans.q_runs import F1_MODELS
    from evalspark.sources.seeds import parse_seed_prompts
    from evalspark.sources.store import empty
    marker = "/bench/f1"
    raw = parse_seed_prompts(seed_docs(spark, d), {BENCH_DIR_META_KEY: marker})
    models = spark.createDataFrame([(m, (i + 1) * 0.5, (i + 1) * 1.5) for i, m in enumerate(F1_MODELS)],
                                   "name string, cost_in_per_mtok double, cost_out_per_mtok double") \
                  .withColumn("size_params_b", F.lit(None).cast("double")) \
                  .withColumn("context_window", F.lit(None).cast("bigint"))
    out = B.bench_run(raw, marker, None, None, models, None, empty(spark, "evaluations"),
                      bench_replies(spark, d, F1_MODELS), AS_OF, extra_rubrics=[NO_REFUSAL])
    return out["breakdown"]


def _duck_repr(x: str) -> str:
    """DuckDB spelling of the Python-repr quoting used in judge notes."""
    e = (f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), "
         f"chr(9), '\\t')")
    return (f"case when contains({x}, '''') and not contains({x}, '\"') then concat('\"', {e}, '\"') "
            f"else concat('''', replace({e}, '''', '\\'''), '''') end")


TURN_PATTERN = r"[a-z]+\.\n[A-Za-z]+"


@register("judge_regex_turns", with_views(f"""
select run_id, case when m then 1e0 else 0e0 end as score, m as passed,
       case when m then concat('matched: ', {_duck_repr("substr(regexp_extract(response, '" + TURN_PATTERN + "'), 1, 80)")})
            else 'no match for /{TURN_PATTERN}/' end as notes
from (select run_id, response, regexp_matches(response, '{TURN_PATTERN}') as m from f1_turn_runs) x""",
    "f1_turn_runs"))
def q_judge_regex_turns(spark, d):
    """Regex judge over whole conversation replies (multi-line, accented prose)."""
    from evalspark.plans.fixtures import f1_turn_runs
    r = f1_turn_runs(spark, d)
    v = build_judge("regex", {"pattern": TURN_PATTERN})(F.col("prompt"), F.col("response"))
    return r.select("run_id", v["score"].alias("score"), v["passed"].alias("passed"), v["notes"].alias("notes"))


_NRT = contains_sql("response", none_of=NO_REFUSAL.judge_config["none_of"])


@register("judge_contains_turns", with_views(
    f"select run_id, {_NRT['score']} as score, {_NRT['passed']} as passed, {_NRT['notes']} as notes "
    f"from f1_turn_runs", "f1_turn_runs"))
def q_judge_contains_turns(spark, d):
    """The shipped no_refusal rubric over whole conversation replies."""
    from evalspark.plans.fixtures import f1_turn_runs
    r = f1_turn_runs(spark, d)
    v = NO_REFUSAL.judge()(F.col("prompt"), F.col("response"))
    return r.select("run_id", v["score"].alias("score"), v["passed"].alias("passed"), v["notes"].alias("notes"))
