"""Core queries on F2: aggregation, routing, statistics, comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.metrics import intervals_disjoint, lower_is_better, wilson_bounds
from evalspark.operators import aggregate as A
from evalspark.operators import compare as C
from evalspark.operators import route as R
from evalspark.plans.fixtures import F2, with_views
from evalspark.plans.registry import register

AUTH = ["human_pass"]
ROUTE_TAGS = ["1-URGENT", "2-HIGH", "status_F"]
BAL = R.PRESETS["balanced"].normalize()


def f2_agg(spark, d, rubrics=AUTH):
    f = F2(spark, d)
    return A.agg_tag_model(f.prompt_tags, f.runs, f.models, f.evaluations, rubrics)


# ---------------------------------------------------------------- SQL pieces

AGG_SQL = """
select pt.tag, m.name as model, m.size_params_b, m.context_window,
       count(*) as n_evals,
       cast(sum(case when e.passed then 1 else 0 end) as bigint) as n_passed,
       cast(sum(case when e.passed is not null then 1 else 0 end) as bigint) as n_passed_known,
       coalesce(avg(e.score), 0.0) as avg_score,
       avg(r.cost_usd) as avg_cost_usd, avg(r.latency_ms) as avg_latency_ms
from (select distinct prompt_id, tag from f2_prompt_tags) pt
join f2_runs r on r.prompt_id = pt.prompt_id
join f2_models m on m.name = r.model
join f2_evaluations e on e.run_id = r.run_id
where e.rubric in ({rubrics})
group by pt.tag, m.name, m.size_params_b, m.context_window"""

DERIVED_SQL = """
select *, case when n_passed_known > 0 then n_passed / n_passed_known else 0.0 end as pass_rate
from {src}"""

CPP_SQL = """
select *, case when avg_cost_usd is not null and pass_rate > 0 then avg_cost_usd / pass_rate end as cost_per_pass
from {src}"""


def agg_ctes(rubrics=AUTH) -> dict[str, str]:
    rl = ", ".join(f"'{r}'" for r in rubrics)
    return {"agg0": AGG_SQL.format(rubrics=rl),
            "agg1": DERIVED_SQL.format(src="agg0"),
            "agg": CPP_SQL.format(src="agg1")}


STATS_SQL = """
select {keys} a.model, a.size_params_b, a.context_window,
       cast(sum(a.n_evals) as bigint) as sample_count,
       cast(sum(a.n_passed) as bigint) as n_passed,
       cast(sum(a.n_passed_known) as bigint) as n_passed_known,
       round(sum(a.avg_score * a.n_evals) / sum(a.n_evals), 9) as avg_score,
       round(sum(case when a.avg_cost_usd is not null then a.avg_cost_usd * a.n_evals end)
             / sum(case when a.avg_cost_usd is not null then a.n_evals end), 9) as avg_cost_usd,
       round(sum(case when a.avg_latency_ms is not null then a.avg_latency_ms * a.n_evals end)
             / sum(case when a.avg_latency_ms is not null then a.n_evals end), 9) as avg_latency_ms
from {src}
group by {keys} a.model, a.size_params_b, a.context_window"""


def route_ctes(weights, threshold=0.7, min_samples=3, rubrics=AUTH) -> dict[str, str]:
    w = weights
    ctes = agg_ctes(rubrics)
    ctes.update({
        "pt": "select distinct prompt_id, tag from f2_prompt_tags where tag <> 'unknown'",
        "ps": "select prompt_id, string_agg(tag, ',' order by tag) as tagset from pt group by prompt_id",
        "ex": "select distinct ps.tagset, pt.tag from ps join pt on pt.prompt_id = ps.prompt_id",
        "cand0": STATS_SQL.format(keys="ex.tagset,", src="agg a join ex on ex.tag = a.tag"),
        "cand1": DERIVED_SQL.format(src="cand0"),
        "q": f"select *, (sample_count >= {min_samples} and pass_rate >= {threshold!r}) as qualifying from cand1",
        "g": """
select tagset,
       max(size_params_b) filter (where qualifying) as max_known,
       min(size_params_b) filter (where qualifying) as min_known,
       min(coalesce(avg_cost_usd, 0.0)) filter (where qualifying) as lo_c,
       max(coalesce(avg_cost_usd, 0.0)) filter (where qualifying) as hi_c,
       min(coalesce(avg_latency_ms, 0.0)) filter (where qualifying) as lo_l,
       max(coalesce(avg_latency_ms, 0.0)) filter (where qualifying) as hi_l
from q group by tagset""",
        "v": """
select q.*, coalesce(q.size_params_b, g.max_known, 1e9) as size_v,
       coalesce(g.min_known, 1e9) as lo_s, coalesce(g.max_known, 1e9) as hi_s,
       coalesce(q.avg_cost_usd, 0.0) as cost_v, g.lo_c, g.hi_c,
       coalesce(q.avg_latency_ms, 0.0) as lat_v, g.lo_l, g.hi_l
from q join g on g.tagset = q.tagset""",
        "cands": f"""
select tagset, model, size_params_b, context_window, sample_count, n_passed, n_passed_known,
       avg_score, avg_cost_usd, avg_latency_ms, pass_rate, qualifying,
       case when qualifying then
         {w.size!r} * (case when hi_s = lo_s then 1.0 else (hi_s - size_v) / (hi_s - lo_s) end)
         + {w.cost!r} * (case when hi_c = lo_c then 1.0 else (hi_c - cost_v) / (hi_c - lo_c) end)
         + {w.latency!r} * (case when hi_l = lo_l then 1.0 else (hi_l - lat_v) / (hi_l - lo_l) end)
       end as composite_score
from v""",
        "ranked": """
select *, row_number() over (partition by tagset order by qualifying desc,
            case when qualifying then composite_score else pass_rate end desc,
            case when qualifying then 0 else sample_count end desc, model asc) as rn,
       count(*) over (partition by tagset) as n_candidates,
       count(*) filter (where qualifying) over (partition by tagset) as n_qualifying
from cands""",
        "picks": "select * exclude (rn), not qualifying as fallback from ranked where rn = 1",
    })
    return ctes


# ---------------------------------------------------------------- queries

@register("agg_tag_model", with_views("select * from agg", "f2_prompt_tags", "f2_runs", "f2_models",
                                      "f2_evaluations", extra=agg_ctes()))
def q_agg_tag_model(spark, d):
    return f2_agg(spark, d)


@register("agg_tag_model_two_rubrics", with_views(
    "select * from agg", "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations",
    extra=agg_ctes(["human_pass", "usefulness"])))
def q_agg_two(spark, d):
    return f2_agg(spark, d, ["human_pass", "usefulness"])


@register("pass_rate", with_views(
    "select tag, model, n_passed, n_passed_known, pass_rate from agg",
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_pass_rate(spark, d):
    return f2_agg(spark, d).select("tag", "model", "n_passed", "n_passed_known", "pass_rate")


@register("cost_per_pass", with_views(
    "select tag, model, avg_cost_usd, pass_rate, cost_per_pass from agg",
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_cost_per_pass(spark, d):
    return f2_agg(spark, d).select("tag", "model", "avg_cost_usd", "pass_rate", "cost_per_pass")


@register("agg_intended_tag", with_views("""
select tag, model, size_params_b, context_window, n_evals, n_passed, n_passed_known, avg_score,
       avg_cost_usd, avg_latency_ms, pass_rate,
       case when avg_cost_usd is not null and pass_rate > 0 then avg_cost_usd / pass_rate end as cost_per_pass
from (select *, case when n_passed_known > 0 then n_passed / n_passed_known else 0.0 end as pass_rate
      from (select coalesce(json_extract_string(p.source_metadata, '$.intended_tag'), 'uncategorized') as tag,
                   m.name as model, m.size_params_b, m.context_window, count(*) as n_evals,
                   cast(sum(case when e.passed then 1 else 0 end) as bigint) as n_passed,
                   cast(sum(case when e.passed is not null then 1 else 0 end) as bigint) as n_passed_known,
                   coalesce(avg(e.score), 0.0) as avg_score,
                   avg(r.cost_usd) as avg_cost_usd, avg(r.latency_ms) as avg_latency_ms
            from f2_evaluations e join f2_runs r on r.run_id = e.run_id
            join f2_prompts p on p.prompt_id = r.prompt_id
            join f2_models m on m.name = r.model
            where e.rubric in ('human_pass')
            group by 1, 2, 3, 4) x) y""", "f2_prompts", "f2_runs", "f2_models", "f2_evaluations"))
def q_agg_intended(spark, d):
    f = F2(spark, d)
    return A.agg_intended_tag(f.prompts, f.runs, f.models, f.evaluations, AUTH)


@register("stats_by_model", with_views(
    DERIVED_SQL.format(src="(" + STATS_SQL.format(
        keys="", src="agg a where a.tag in (" + ", ".join(f"'{t}'" for t in ROUTE_TAGS) + ")") + ") s"),
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_stats_by_model(spark, d):
    return A.stats_by_model(f2_agg(spark, d), tags=ROUTE_TAGS)


@register("route_candidates", with_views(
    "select * from cands", "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations",
    extra=route_ctes(BAL)))
def q_route_candidates(spark, d):
    f = F2(spark, d)
    agg = f2_agg(spark, d)
    return R.route_candidates(agg, R.prompt_tag_sets(f.prompt_tags), BAL).withColumn("tagset", F.array_join("tagset", ","))


RECOMMEND_BODY = """
select p.prompt_id, ps.tagset, k.model, k.fallback,
       case when k.model is null then 'no_stats' when k.fallback then 'fallback' else 'qualified' end as reason,
       k.composite_score, k.pass_rate, k.sample_count, k.avg_cost_usd, k.avg_latency_ms, k.size_params_b,
       k.n_candidates, k.n_qualifying
from f2_prompts p left join ps on ps.prompt_id = p.prompt_id left join picks k on k.tagset = ps.tagset"""


@register("recommend", with_views(RECOMMEND_BODY, "f2_prompts", "f2_prompt_tags", "f2_runs", "f2_models",
                                  "f2_evaluations", extra=route_ctes(BAL)))
def q_recommend(spark, d):
    f = F2(spark, d)
    return R.recommend(f.prompts, f.prompt_tags, f2_agg(spark, d), weights=BAL)


@register("recommend_size", with_views(RECOMMEND_BODY, "f2_prompts", "f2_prompt_tags", "f2_runs", "f2_models",
                                       "f2_evaluations", extra=route_ctes(R.PRESETS["size"])))
def q_recommend_size(spark, d):
    f = F2(spark, d)
    return R.recommend(f.prompts, f.prompt_tags, f2_agg(spark, d), weights="size")


@register("score_candidates", with_views(
    "select tagset, model, qualifying, composite_score from cands",
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=route_ctes(R.PRESETS["fast"])))
def q_score_candidates(spark, d):
    f = F2(spark, d)
    c = R.route_candidates(f2_agg(spark, d), R.prompt_tag_sets(f.prompt_tags), "fast")
    return c.select(F.array_join("tagset", ",").alias("tagset"), "model", "qualifying", "composite_score")


@register("minmax_lower_better", with_views("""
select tag, model, avg_latency_ms,
       case when max(avg_latency_ms) over (partition by tag) = min(avg_latency_ms) over (partition by tag) then 1.0
            else (max(avg_latency_ms) over (partition by tag) - avg_latency_ms)
                 / (max(avg_latency_ms) over (partition by tag) - min(avg_latency_ms) over (partition by tag))
       end as latency_axis
from agg""", "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_minmax(spark, d):
    a = f2_agg(spark, d)
    ends = a.groupBy("tag").agg(F.min("avg_latency_ms").alias("lo"), F.max("avg_latency_ms").alias("hi"))
    return a.join(ends, "tag").select("tag", "model", "avg_latency_ms",
                                      lower_is_better("avg_latency_ms", F.col("lo"), F.col("hi")).alias("latency_axis"))


PAIRS_SQL = """
select m1.name as model_a, m2.name as model_b
from f2_models m1 join f2_models m2 on m2.model_key = m1.model_key + 1
where m1.model_key % 2 = 1"""


WILSON_SQL = """
case when {n} > 0 then greatest(0.0, (({s} / {n}) + {z2!r} / (2 * {n})) / (1.0 + {z2!r} / {n})
     - {z!r} * sqrt(({s} / {n}) * (1.0 - ({s} / {n})) / {n} + {z2!r} / (4 * {n} * {n})) / (1.0 + {z2!r} / {n}))
     else 0.0 end"""
WILSON_HI_SQL = """
case when {n} > 0 then least(1.0, (({s} / {n}) + {z2!r} / (2 * {n})) / (1.0 + {z2!r} / {n})
     + {z!r} * sqrt(({s} / {n}) * (1.0 - ({s} / {n})) / {n} + {z2!r} / (4 * {n} * {n})) / (1.0 + {z2!r} / {n}))
     else 1.0 end"""


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    from evalspark.schemas import WILSON_Z95 as z
    return (WILSON_SQL.format(s=s, n=n, z=z, z2=z * z).strip(),
            WILSON_HI_SQL.format(s=s, n=n, z=z, z2=z * z).strip())


@register("wilson_interval", with_views(
    "select tag, model, n_passed, n_passed_known, {lo} as ci_lo, {hi} as ci_hi from agg".format(
        lo=wilson_sql("n_passed", "n_passed_known")[0], hi=wilson_sql("n_passed", "n_passed_known")[1]),
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_wilson(spark, d):
    a = f2_agg(spark, d)
    lo, hi = wilson_bounds("n_passed", "n_passed_known")
    return a.select("tag", "model", "n_passed", "n_passed_known", lo.alias("ci_lo"), hi.alias("ci_hi"))


@register("intervals_disjoint", with_views("""
select a.tag, a.model as model_a, b.model as model_b,
       ({ahi} < {blo}) or ({bhi} < {alo}) as disjoint
from pairs p join agg a on a.model = p.model_a join agg b on b.model = p.model_b and b.tag = a.tag""".format(
        alo=wilson_sql("a.n_passed", "a.n_passed_known")[0], ahi=wilson_sql("a.n_passed", "a.n_passed_known")[1],
        blo=wilson_sql("b.n_passed", "b.n_passed_known")[0], bhi=wilson_sql("b.n_passed", "b.n_passed_known")[1]),
    "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes() | {"pairs": PAIRS_SQL}))
def q_disjoint(spark, d):
    """Given pairs of models, over all tags both have."""
    a = f2_agg(spark, d, AUTH)
    lo, hi = wilson_bounds("n_passed", "n_passed_known")
    a = a.select("tag", "model", lo.alias("lo"), hi.alias("hi"))
    x = f2_pairs(spark, d).join(a.select("tag", F.col("model").alias("model_a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), "model_a")
    y = a.select("tag", F.col("model").alias("model_b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return x.join(y, ["tag", "model_b"]).select("tag", "model_a", "model_b", intervals_disjoint("alo", "ahi", "blo", "bhi").alias("disjoint"))


@register("group_by_first_key", with_views("""
select a.tag, a.model, a.n_evals, a.pass_rate, t.n_models, t.tag_evals
from agg a join (select tag, count(*) as n_models, cast(sum(n_evals) as bigint) as tag_evals from agg group by tag) t on t.tag = a.tag""",
                                           "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations", extra=agg_ctes()))
def q_group_first(spark, d):
    return A.group_by_first_key(f2_agg(spark, d))


HEAT_SQL = "select tag, model, {v} as value from agg"


@register("heatmap", with_views(HEAT_SQL.format(v="pass_rate"), "f2_prompt_tags", "f2_runs", "f2_models",
                                "f2_evaluations", extra=agg_ctes()))
def q_heatmap(spark, d):
    return A.heatmap_cells(f2_agg(spark, d), "pass_rate")


@register("heatmap_n", with_views(HEAT_SQL.format(v="n_evals"), "f2_prompt_tags", "f2_runs", "f2_models",
                                  "f2_evaluations", extra=agg_ctes()))
def q_heatmap_n(spark, d):
    return A.heatmap_cells(f2_agg(spark, d), "n_evals")


def compare_ctes(pairs_sql: str, min_samples=1, tie=0.05, require_sig=True) -> dict[str, str]:
    alo, ahi = wilson_sql("a.n_passed", "a.n_passed_known")
    blo, bhi = wilson_sql("b.n_passed", "b.n_passed_known")
    ctes = agg_ctes()
    ctes["pairs"] = pairs_sql
    ctes["cmp0"] = f"""
select p.model_a, p.model_b, a.tag,
       a.n_evals as a_n, a.pass_rate as a_pass_rate, {alo} as a_ci_lo, {ahi} as a_ci_hi,
       a.avg_score as a_avg_score, a.avg_cost_usd as a_avg_cost, a.avg_latency_ms as a_avg_latency,
       b.n_evals as b_n, b.pass_rate as b_pass_rate, {blo} as b_ci_lo, {bhi} as b_ci_hi,
       b.avg_score as b_avg_score, b.avg_cost_usd as b_avg_cost, b.avg_latency_ms as b_avg_latency,
       a.pass_rate - b.pass_rate as delta_pass_rate
from pairs p join agg a on a.model = p.model_a join agg b on b.model = p.model_b and b.tag = a.tag
where a.n_evals >= {min_samples} and b.n_evals >= {min_samples}"""
    ctes["cmp1"] = "select *, (a_ci_hi < b_ci_lo) or (b_ci_hi < a_ci_lo) as significant from cmp0"
    sig = "not significant" if require_sig else "false"
    ctes["cmp"] = f"""
select *, case when {sig} then 'tie' when abs(delta_pass_rate) <= {tie!r} then 'tie'
               when delta_pass_rate > 0 then 'A' else 'B' end as winner
from cmp1"""
    return ctes


def f2_pairs(spark, d):
    m = F2(spark, d).models
    a = m.filter(F.col("model_key") % 2 == 1).select(F.col("name").alias("model_a"),
                                                     (F.col("model_key") + 1).alias("k"))
    b = m.select(F.col("name").alias("model_b"), F.col("model_key").alias("k"))
    return a.join(b, "k").select("model_a", "model_b")


@register("compare", with_views("select * from cmp", "f2_prompt_tags", "f2_runs", "f2_models",
                                "f2_evaluations", extra=compare_ctes(PAIRS_SQL)))
def q_compare(spark, d):
    return C.compare(f2_agg(spark, d), f2_pairs(spark, d))


@register("compare_no_ci", with_views("select * from cmp", "f2_prompt_tags", "f2_runs", "f2_models",
                                      "f2_evaluations", extra=compare_ctes(PAIRS_SQL, 3, 0.05, False)))
def q_compare_no_ci(spark, d):
    return C.compare(f2_agg(spark, d), f2_pairs(spark, d), min_samples=3, require_significance=False)


@register("compare_overall", with_views("""
select model_a, model_b, count(*) filter (where winner = 'A') as a_wins,
       count(*) filter (where winner = 'B') as b_wins, count(*) filter (where winner = 'tie') as ties,
       case when count(*) filter (where winner = 'A') > count(*) filter (where winner = 'B') then 'A'
            when count(*) filter (where winner = 'B') > count(*) filter (where winner = 'A') then 'B'
            else 'tie' end as overall_winner
from cmp group by model_a, model_b""", "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations",
    extra=compare_ctes(PAIRS_SQL, 1, 0.05, False)))
def q_compare_overall(spark, d):
    return C.compare_overall(C.compare(f2_agg(spark, d), f2_pairs(spark, d), require_significance=False))


F1_AGG_SQL = """
select tag, model, count(*) as n, cast(sum(case when passed then 1 else 0 end) as bigint) as n_passed,
       cast(sum(case when passed is not null then 1 else 0 end) as bigint) as n_known, avg(score) as avg_score
from f1_doc_evals group by tag, model"""


@register("f1_agg", with_views(F1_AGG_SQL, "f1_doc_evals"))
def q_f1_agg(spark, d):
    """The core aggregate over the text tables: documents are runs tagged by
    language, sources are models, labels are human verdicts."""
    from evalspark.plans.fixtures import f1_doc_evals
    ev = f1_doc_evals(spark, d)
    tags = ev.select(F.col("run_id").alias("prompt_id"), "tag")
    runs = ev.select("run_id", F.col("run_id").alias("prompt_id"), "model",
                     F.lit(None).cast("double").alias("cost_usd"), F.lit(None).cast("bigint").alias("latency_ms"))
    evals = ev.select("run_id", "rubric", "score", "passed")
    models = ev.select(F.col("model").alias("name")).distinct() \
               .select("name", F.lit(None).cast("double").alias("size_params_b"),
                       F.lit(None).cast("bigint").alias("context_window"))
    a = A.agg_tag_model(tags, runs, models, evals, ["human_pass"])
    return a.select("tag", "model", F.col("n_evals").alias("n"), "n_passed",
                    F.col("n_passed_known").alias("n_known"), "avg_score")
