"""Report, headline and data-quality queries on F2."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import aggregate as A
from evalspark.operators import report as RP
from evalspark.plans.fixtures import F2, f4_prompts, with_views
from evalspark.plans.q_core import STATS_SQL, DERIVED_SQL, agg_ctes, f2_agg
from evalspark.plans.registry import register
from evalspark.schemas import DEFAULT_TAXONOMY
from evalspark.sources import store as S

AS_OF = "1999-01-01 00:00:00"
F2V = ("f2_prompts", "f2_prompt_tags", "f2_runs", "f2_models", "f2_evaluations")

TAXONOMY_SQL = "select * from (values " + ", ".join(
    "('{}', '{}', cast(null as varchar))".format(t, d.replace("'", "''")) for t, d in DEFAULT_TAXONOMY
) + ") as t(tag, description, parent)"

ACTIVITY_SQL = {
    "act_p": "select tag, count(distinct prompt_id) as n_prompts from f2_prompt_tags group by tag",
    "act_r": "select t.tag, count(*) as n_runs from f2_prompt_tags t join f2_runs r on r.prompt_id = t.prompt_id group by t.tag",
    "act_e": """select t.tag, count(*) as n_evals from f2_prompt_tags t join f2_runs r on r.prompt_id = t.prompt_id
                join f2_evaluations e on e.run_id = r.run_id group by t.tag""",
    "activity": """select p.tag, p.n_prompts, coalesce(r.n_runs, 0) as n_runs, coalesce(e.n_evals, 0) as n_evals
                   from act_p p left join act_r r on r.tag = p.tag left join act_e e on e.tag = p.tag""",
}


def tag_cand_ctes(threshold=0.7, min_samples=3) -> dict[str, str]:
    from evalspark.operators.route import PRESETS
    w = PRESETS["balanced"].normalize()
    c = dict(agg_ctes())
    c.update(ACTIVITY_SQL)
    c.update({
        "tc0": STATS_SQL.format(keys="a.tag,", src="agg a"),
        "tc1": DERIVED_SQL.format(src="tc0"),
        "tq": f"select *, (sample_count >= {min_samples} and pass_rate >= {threshold!r}) as qualifying from tc1",
        "tg": """
select tag, max(size_params_b) filter (where qualifying) as max_known,
       min(size_params_b) filter (where qualifying) as min_known,
       min(coalesce(avg_cost_usd, 0.0)) filter (where qualifying) as lo_c,
       max(coalesce(avg_cost_usd, 0.0)) filter (where qualifying) as hi_c,
       min(coalesce(avg_latency_ms, 0.0)) filter (where qualifying) as lo_l,
       max(coalesce(avg_latency_ms, 0.0)) filter (where qualifying) as hi_l
from tq group by tag""",
        "tc": f"""
select q.*, case when qualifying then
  {w.size!r} * (case when coalesce(g.max_known, 1e9) = coalesce(g.min_known, 1e9) then 1.0
         else (coalesce(g.max_known, 1e9) - coalesce(q.size_params_b, g.max_known, 1e9))
              / (coalesce(g.max_known, 1e9) - coalesce(g.min_known, 1e9)) end)
  + {w.cost!r} * (case when g.hi_c = g.lo_c then 1.0 else (g.hi_c - coalesce(q.avg_cost_usd, 0.0)) / (g.hi_c - g.lo_c) end)
  + {w.latency!r} * (case when g.hi_l = g.lo_l then 1.0 else (g.hi_l - coalesce(q.avg_latency_ms, 0.0)) / (g.hi_l - g.lo_l) end)
  end as composite_score,
  coalesce(q.avg_cost_usd, 'inf'::double) as cost_inf
from tq q join tg g on g.tag = q.tag""",
        "pq": """select * from (select tag, model, pass_rate, sample_count, row_number() over
                 (partition by tag order by pass_rate desc, cost_inf asc, model) as rn from tc where qualifying) where rn = 1""",
        "pf": """select * from (select tag, model, pass_rate, sample_count, row_number() over
                 (partition by tag order by pass_rate desc, sample_count desc, model) as rn from tc) where rn = 1""",
        "pc": """select * from (select tag, model, avg_cost_usd, row_number() over
                 (partition by tag order by cost_inf asc, model) as rn from tc where qualifying) where rn = 1""",
        "pb": """select * from (select tag, model, row_number() over
                 (partition by tag order by coalesce(composite_score, 0.0) desc, model) as rn from tc where qualifying) where rn = 1""",
        "nq": "select tag, count(*) as n_cand, count(*) filter (where qualifying) as qualifying_models from tc group by tag",
    })
    return c


SCORECARD_BODY = """
select a.tag, a.n_prompts, a.n_runs, a.n_evals,
       case when nq.qualifying_models > 0 then pq.model else pf.model end as quality_pick,
       case when nq.qualifying_models > 0 then pq.pass_rate else pf.pass_rate end as quality_pass_rate,
       case when nq.qualifying_models > 0 then pq.sample_count else pf.sample_count end as quality_n,
       pc.model as cost_pick, pc.avg_cost_usd as cost_pick_avg_cost, pb.model as balanced_pick,
       nq.qualifying_models > 0 as has_qualifying, nq.qualifying_models
from activity a join nq on nq.tag = a.tag
left join pq on pq.tag = a.tag left join pf on pf.tag = a.tag
left join pc on pc.tag = a.tag left join pb on pb.tag = a.tag
where a.n_prompts > 0"""

GAPS_BODY = """
select a.tag, a.n_prompts,
       case when nq.tag is null then (case when a.n_runs = 0 then 'no_runs' else 'no_evals' end)
            else 'no_qualifying' end as reason
from activity a left join nq on nq.tag = a.tag
where a.n_prompts > 0 and (nq.tag is null or nq.qualifying_models = 0)"""


def _act(f):
    return RP.tag_activity(f.prompt_tags, f.runs, f.evaluations)


@register("tag_activity", with_views("select * from activity", *F2V, extra=ACTIVITY_SQL))
def q_tag_activity(spark, d):
    return _act(F2(spark, d))


@register("scorecards", with_views(SCORECARD_BODY, *F2V, extra=tag_cand_ctes()))
def q_scorecards(spark, d):
    f = F2(spark, d)
    return RP.scorecards(_act(f), f2_agg(spark, d), taxonomy=S.default_taxonomy(spark))


@register("scorecards_strict", with_views(SCORECARD_BODY, *F2V, extra=tag_cand_ctes(0.75, 400)))
def q_scorecards_strict(spark, d):
    f = F2(spark, d)
    return RP.scorecards(_act(f), f2_agg(spark, d), threshold=0.75, min_samples=400)


@register("coverage_gaps", with_views(GAPS_BODY, *F2V, extra=tag_cand_ctes(0.75, 400)))
def q_gaps(spark, d):
    f = F2(spark, d)
    return RP.coverage_gaps(_act(f), f2_agg(spark, d), threshold=0.75, min_samples=400)


@register("rubric_freshness", with_views(f"""
select b.rubric, b.n_evals, b.last_scored_at,
       (epoch_us(timestamp '{AS_OF}') - epoch_us(b.last_scored_at)) / 86400e6 as age_days,
       coalesce((epoch_us(timestamp '{AS_OF}') - epoch_us(b.last_scored_at)) / 86400e6 > 30.0, false) as stale,
       s.scored_by_breakdown
from (select rubric, count(*) as n_evals, max(created_at) as last_scored_at from f2_evaluations group by rubric) b
join (select rubric, string_agg(scored_by || ':' || cast(cnt as varchar), ',' order by cnt desc, scored_by) as scored_by_breakdown
      from (select rubric, scored_by, count(*) as cnt from f2_evaluations group by rubric, scored_by) x
      group by rubric) s on s.rubric = b.rubric""", *F2V))
def q_freshness(spark, d):
    return RP.rubric_freshness(F2(spark, d).evaluations, AS_OF, 30.0)


@register("headline", with_views("""
select (select count(*) from f2_prompts) as n_prompts, (select count(*) from f2_models) as n_models,
       (select count(*) from f2_runs) as n_runs, (select count(*) from f2_evaluations) as n_evals,
       (select count(*) from f2_runs where error is not null) as n_runs_with_error,
       (select coalesce(sum(cost_usd), 0.0) from f2_runs) as total_cost_usd""", *F2V))
def q_headline(spark, d):
    f = F2(spark, d)
    return A.headline(f.prompts, f.models, f.runs, f.evaluations)


@register("run_errors", with_views(
    "select count(*) filter (where error is not null) as n_runs_with_error from f2_runs", *F2V))
def q_run_errors(spark, d):
    return A.run_errors(F2(spark, d).runs)


@register("prompts_by_source", with_views(
    "select source, count(*) as n from f2_prompts group by source", *F2V))
def q_pbs(spark, d):
    return A.prompts_by_source(F2(spark, d).prompts)


@register("evals_by_rubric", with_views(
    "select rubric, count(*) as n from f2_evaluations group by rubric", *F2V))
def q_ebr(spark, d):
    return A.evals_by_rubric(F2(spark, d).evaluations)


@register("tags_by_classifier", with_views(
    "select tag, classifier, count(*) as n from f2_prompt_tags group by tag, classifier", *F2V))
def q_tbc(spark, d):
    return A.tags_by_classifier(F2(spark, d).prompt_tags)


@register("distinct_rubrics", with_views(
    "select distinct rubric, case when rubric = 'human_pass' then 0 else 1 end as rank from f2_evaluations", *F2V))
def q_distinct_rubrics(spark, d):
    return A.distinct_rubrics(F2(spark, d).evaluations)


@register("models_by_size", with_views(
    "select name, provider, size_params_b, context_window, model_key from f2_models", *F2V))
def q_models_by_size(spark, d):
    return A.models_by_size(F2(spark, d).models)


CHECKS_SQL = f"""
select * from (
with c as (select (select count(*) from ({TAXONOMY_SQL})) as t, (select count(*) from f2_prompts) as p,
                  (select count(distinct prompt_id) from f2_prompt_tags) as g,
                  (select count(*) from f2_models) as m, (select count(*) from f2_evaluations) as e)
select 'schema' as "check", 'ok' as status, 'tables present' as detail, cast(null as double) as value from c
union all select 'taxonomy', case when t = 0 then 'warn' else 'ok' end,
                 case when t = 0 then 'no taxonomy rows' else cast(t as varchar) || ' tags seeded' end, t from c
union all select 'prompts', case when p = 0 then 'warn' else 'ok' end,
                 case when p = 0 then 'no prompts ingested' else cast(p as varchar) || ' prompts in DB' end, p from c
union all select 'models', case when m = 0 then 'warn' else 'ok' end,
                 case when m = 0 then 'no models registered' else cast(m as varchar) || ' models registered' end, m from c
union all select 'classification',
                 case when p = 0 or g = 0 or g / p < 0.5 then 'warn' else 'ok' end,
                 case when p = 0 then 'no prompts to classify' when g = 0 then 'no prompts have tags yet'
                      else cast(g as varchar) || '/' || cast(p as varchar) || ' prompts tagged' end,
                 case when p > 0 then g / p end from c
union all select 'evaluations', case when e = 0 then 'warn' else 'ok' end,
                 case when e = 0 then 'no evaluations yet' else cast(e as varchar) || ' evaluations recorded' end, e from c
) q"""


@register("quality_checks", with_views(CHECKS_SQL, *F2V))
def q_quality(spark, d):
    f = F2(spark, d)
    return RP.quality_checks(f.prompts, f.prompt_tags, f.models, f.evaluations, S.default_taxonomy(spark))


@register("quality_check_totals", with_views(f"""
select count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'warn') as warn,
       count(*) filter (where status = 'fail') as fail from ({CHECKS_SQL})""", *F2V))
def q_quality_totals(spark, d):
    return RP.summarize_checks(q_quality(spark, d))



@register("taxonomy_seed", with_views(f"""
select * from existing
union all
select d.* from ({TAXONOMY_SQL}) d where d.tag not in (select tag from existing)""", "f4_prompts", extra={
    "existing": """select distinct json_extract_string(source_metadata, '$.intended_tag') as tag,
                   cast(null as varchar) as description, cast(null as varchar) as parent from f4_prompts"""}))
def q_taxonomy_seed(spark, d):
    p = f4_prompts(spark, d)
    existing = (p.select(F.get_json_object("source_metadata", "$.intended_tag").alias("tag")).distinct()
                 .select("tag", F.lit(None).cast("string").alias("description"),
                         F.lit(None).cast("string").alias("parent")))
    return S.taxonomy_after_seed(existing)


def _report(spark, d):
    f = F2(spark, d)
    return RP.build_report(f.prompts, f.prompt_tags, f.models, f.runs, f.evaluations, f2_agg(spark, d),
                           AS_OF, taxonomy=S.default_taxonomy(spark))


@register("build_report", with_views(f"""
select 'headline' as section, cast(1 as bigint) as n_rows
union all select 'prompts_by_source', count(*) from (select source from f2_prompts group by source) x
union all select 'evals_by_rubric', count(*) from (select rubric from f2_evaluations group by rubric) x
union all select 'scorecards', count(*) from ({SCORECARD_BODY}) x
union all select 'gaps', count(*) from ({GAPS_BODY}) x
union all select 'rubric_freshness', count(*) from (select rubric from f2_evaluations group by rubric) x""",
    *F2V, extra=tag_cand_ctes()))
def q_build_report(spark, d):
    secs = _report(spark, d)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("section"), "n_rows")
             for k, df in secs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("report_json")
def q_report_json(spark, d):
    return RP.report_json(_report(spark, d), generated_at=AS_OF, taxonomy=S.default_taxonomy(spark))


@register("report_fields", with_views(f"""
select 'headline' as section, 0 as pos, cast(null as varchar) as key, cast(p as double) as a, cast(r as double) as b, c,
       cast(m as varchar) || '|' || cast(e as varchar) || '|' || cast(x as varchar) as detail, cast(null as boolean) as flag
from (select (select count(*) from f2_prompts) as p, (select count(*) from f2_models) as m, (select count(*) from f2_runs) as r,
             (select count(*) from f2_evaluations) as e, (select count(*) from f2_runs where error is not null) as x,
             (select coalesce(sum(cost_usd), 0e0) from f2_runs) as c)
union all select 'prompts_by_source', row_number() over (order by n desc, source) - 1, source, n, null, null, null, null
          from (select source, count(*) as n from f2_prompts group by source)
union all select 'evals_by_rubric', row_number() over (order by n desc, rubric) - 1, rubric, n, null, null, null, null
          from (select rubric, count(*) as n from f2_evaluations group by rubric)
union all select 'scorecards', row_number() over (order by tag not in (select tag from ({TAXONOMY_SQL})), tag) - 1, tag, n_prompts,
                 quality_pass_rate, cost_pick_avg_cost, concat_ws('|', quality_pick, cost_pick, balanced_pick,
                 cast(qualifying_models as varchar)), has_qualifying from ({SCORECARD_BODY})
union all select 'gaps', row_number() over (order by tag not in (select tag from ({TAXONOMY_SQL})), tag) - 1, tag, n_prompts,
                 null, null, reason, null from ({GAPS_BODY})
union all select 'rubric_freshness', row_number() over (order by b.n_evals desc, b.rubric) - 1, b.rubric, b.n_evals,
                 (epoch_us(timestamp '{AS_OF}') - epoch_us(b.last)) / 86400e6, null,
                 strftime(b.last, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || s.who,
                 coalesce((epoch_us(timestamp '{AS_OF}') - epoch_us(b.last)) / 86400e6 > 30.0, false)
          from (select rubric, count(*) as n_evals, max(created_at) as last from f2_evaluations group by rubric) b
          join (select rubric, string_agg(scored_by || ':' || cast(n as varchar), ',' order by n desc, scored_by) as who
                from (select rubric, scored_by, count(*) as n from f2_evaluations group by rubric, scored_by) group by rubric) s
            on s.rubric = b.rubric""", *F2V, extra=tag_cand_ctes(0.75, 400)))
def q_report_fields(spark, d):
    """The report document of a strict threshold (so that there are gaps), read back by its paths in their order."""
    f = F2(spark, d)
    secs = RP.build_report(f.prompts, f.prompt_tags, f.models, f.runs, f.evaluations, f2_agg(spark, d), AS_OF,
                           threshold=0.75, min_samples=400, taxonomy=S.default_taxonomy(spark))
    doc = (RP.report_json(secs, generated_at=AS_OF, taxonomy=S.default_taxonomy(spark))
           .select(F.parse_json("report").alias("v")))
    lists = ("headline.prompts_by_source", "headline.evals_by_rubric", "scorecards", "gaps", "rubric_freshness")
    none = F.lit(None)
    paths = {"headline": (none, "n_prompts", "n_runs", "total_cost_usd", ("n_models", "n_evals", "n_runs_with_error"), none),
             "prompts_by_source": ("source", "count", none, none, (), none),
             "evals_by_rubric": ("rubric", "count", none, none, (), none),
             "scorecards": ("tag", "n_prompts", "quality_pass_rate", "cost_pick_avg_cost",
                            ("quality_pick", "cost_pick", "balanced_pick", "qualifying_models"), "has_qualifying"),
             "gaps": ("tag", "n_prompts", none, none, ("reason",), none),
             "rubric_freshness": ("rubric", "n_evals", "age_days", none, ("last_scored_at", "who"), "stale")}

    def entries(path):
        name = F.lit(path.split(".")[-1]).alias("section")
        return F.transform(F.variant_get("v", f"$.{path}", "array<variant>"), lambda x, i: F.struct(name, i.alias("pos"), x.alias("x")))

    head = F.struct(F.lit("headline").alias("section"), F.lit(0).alias("pos"), F.variant_get("v", "$.headline", "variant").alias("x"))
    one = doc.select(F.explode(F.concat(F.array(head), *[entries(p) for p in lists])).alias("r"))

    def at(field, kind):
        if not isinstance(field, str):
            return field.cast(kind)
        if field == "who":
            return F.array_join(F.transform(F.variant_get("r.x", "$.scored_by_breakdown", "array<struct<scored_by:string,count:bigint>>"),
                                            lambda s: F.concat(s["scored_by"], F.lit(":"), s["count"].cast("string"))), ",")
        return F.variant_get("r.x", f"$.{field}", kind)

    def choose(pick, kind):
        c = F.lit(None).cast(kind)
        for name, fields in paths.items():
            c = F.when(F.col("r.section") == name, pick(fields)).otherwise(c)
        return c
    detail = lambda fs: F.concat_ws("|", *[at(x, "string") for x in fs]) if fs else F.lit(None).cast("string")
    return one.select("r.section", F.col("r.pos").cast("bigint").alias("pos"), choose(lambda x: at(x[0], "string"), "string").alias("key"),
                      *[choose(lambda x, i=i: at(x[i], "double"), "double").alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))],
                      choose(lambda x: detail(x[4]), "string").alias("detail"),
                      choose(lambda x: at(x[5], "boolean"), "boolean").alias("flag"))
