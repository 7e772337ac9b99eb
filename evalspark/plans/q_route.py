"""Routing from prompt texts: classify, vote, score the recorded replies, aggregate, pick."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import aggregate as A
from evalspark.operators import classify as CL
from evalspark.operators import route as R
from evalspark.operators import scoring as SC
from evalspark.plans.fixtures import f4_prompts, f4_runs, with_views
from evalspark.plans.q_classify import ENSEMBLE_CTES, f4_prompt_tags, heur, llm_votes
from evalspark.plans.q_core import BAL, route_ctes
from evalspark.plans.q_score import AS_OF, F4V, NO_REFUSAL, _NR
from evalspark.plans.registry import register

THRESHOLD, MIN_SAMPLES = 0.66, 5

# the views that routing reads, over the tags, replies and scores of F4
ROUTE_CTES = ENSEMBLE_CTES | {
    "said": """select prompt_id, tag, confidence, classifier from votes
               union all select * from llm where prompt_id not in (select prompt_id from agreed)""",
    "f2_prompt_tags": "select prompt_id, tag from said",
    "f2_runs": "select run_id, prompt_id, model, length(response) / 1024e0 as cost_usd, cast(length(prompt) as int) as latency_ms from f4_runs",
    "f2_models": """select distinct model as name, case when model <> 'm-0' then cast(substr(model, 3) as double) end as size_params_b,
                           4096 as context_window from f4_runs""",
    "f2_evaluations": f"""select run_id, '{NO_REFUSAL.name}' as rubric, {_NR['score']} as score, {_NR['passed']} as passed
                          from f4_runs where trim(response) <> ''""",
} | route_ctes(BAL, THRESHOLD, MIN_SAMPLES, [NO_REFUSAL.name]) | {
    "ranked_tags": """select prompt_id, string_agg(tag, ',' order by c desc, tag) as tags,
                             '[' || string_agg('''' || tag || '''', ', ' order by c desc, tag) || ']' as named
                      from (select prompt_id, tag, max(confidence) as c from said where tag <> 'unknown' group by prompt_id, tag)
                      group by prompt_id"""}


@register("route_texts", with_views(f"""
select p.prompt_id, t.tags, k.model, coalesce(k.fallback, false) as fallback,
       case when k.model is null then 'no historical evaluations for these tags'
            when k.fallback then 'no model met threshold 66% with >= 5 samples; falling back to best available'
            else 'best composite score under weights (size={BAL.size:.2f}, cost={BAL.cost:.2f}, latency={BAL.latency:.2f})'
                 || ' among models with pass_rate >= 66% over >= 5 runs on tags ' || t.named end as reason,
       k.composite_score, k.pass_rate, k.sample_count, k.n_candidates, k.n_qualifying
from f4_prompts p left join ps on ps.prompt_id = p.prompt_id left join ranked_tags t on t.prompt_id = p.prompt_id
left join picks k on k.tagset = ps.tagset""", *F4V, extra=ROUTE_CTES))
def q_route_texts(spark, d):
    """Every prompt text classified by vote and routed by the scores of all recorded replies."""
    prompts = f4_prompts(spark, d)
    bench, llm = f4_prompt_tags(spark, d), llm_votes(spark, d)
    runs = f4_runs(spark, d).withColumns({"cost_usd": F.length("response") / F.lit(1024.0),
                                          "latency_ms": F.length("prompt").cast("int")})
    models = runs.select(F.col("model").alias("name")).distinct().select(
        "name", F.when(F.col("name") != "m-0", F.substring("name", 3, 9).cast("double")).alias("size_params_b"),
        F.lit(4096).alias("context_window"))
    none = spark.createDataFrame([], "run_id string, rubric string, rubric_hash string, score double, passed boolean, "
                                     "scored_by string, created_at timestamp")
    scored = SC.score_runs(NO_REFUSAL, runs, prompts, none, as_of=AS_OF)["new"]
    known = CL.ensemble_vote(heur(spark, d).unionByName(bench), ["heuristic", "bench"], llm)
    agg = A.agg_tag_model(known, runs, models, scored, [NO_REFUSAL.name])
    return R.route_texts(prompts, agg, votes=bench, members=("heuristic", "bench"), llm_votes=llm, weights=BAL,
                         threshold=THRESHOLD, min_samples=MIN_SAMPLES)
