"""Classification queries on F4 prompts."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import classify as CL
from evalspark.operators import ml as ML
from evalspark.plans.fixtures import f4_prompts, with_views
from evalspark.plans.q_score import f4_prompt_tags
from evalspark.plans.registry import register
from evalspark.sources.store import default_taxonomy

F4V = ("f4_prompts",)


def _duck_scores() -> str:
    items = []
    for tag, sigs in CL.signal_patterns("duckdb").items():
        terms = " + ".join(f"{w!r}e0 * len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}'))"
                           for p, w in sigs)
        items.append(f"{{'tag': '{tag}', 'score': 0e0 + {terms}}}")
    return "[" + ", ".join(items) + "]"


HEUR_CTES = {
    "hs": f"select prompt_id, {_duck_scores()} as scores from f4_prompts where content is not null and length(content) > 0",
    "hk": "select prompt_id, list_filter(scores, lambda x: x.score >= 1e0) as kept from hs",
    "heur": """
select prompt_id, p.tag as tag, p.confidence as confidence, 'heuristic' as classifier
from (select prompt_id, unnest(case when len(kept) > 0
        then list_transform(kept, lambda x: {'tag': x.tag, 'confidence': least(x.score / 5e0, 1e0)})
        else [{'tag': 'unknown', 'confidence': 0.1e0}] end) as p from hk) t""",
    "f4_prompt_tags": """select prompt_id, json_extract_string(source_metadata, '$.intended_tag') as tag,
                             1e0 as confidence, 'bench' as classifier from f4_prompts
                             where json_extract_string(source_metadata, '$.intended_tag') <> 'other'""",
}


def heur(spark, d):
    return CL.classify_heuristic(f4_prompts(spark, d))


@register("classify_heuristic", with_views("select * from heur", *F4V, extra=HEUR_CTES))
def q_heuristic(spark, d):
    return heur(spark, d)


def llm_votes(spark, d):
    p = f4_prompts(spark, d)
    tag = F.get_json_object("source_metadata", "$.intended_tag")
    return p.select("prompt_id", F.when(tag == "other", "creative").otherwise(tag).alias("tag"),
                    F.lit(0.6).alias("confidence"), F.lit("llm").alias("classifier"))


ENSEMBLE_CTES = dict(HEUR_CTES)
ENSEMBLE_CTES.update({
    "votes": "select * from heur union all select * from f4_prompt_tags",
    "agreed": """select distinct prompt_id from (select prompt_id, tag, count(distinct classifier) as n from votes
                 where tag <> 'unknown' group by prompt_id, tag) x where n = 2""",
    "llm": """select prompt_id, case when json_extract_string(source_metadata, '$.intended_tag') = 'other' then 'creative'
                 else json_extract_string(source_metadata, '$.intended_tag') end as tag, 0.6e0 as confidence,
                 'llm' as classifier from f4_prompts""",
})


@register("ensemble_vote", with_views("""
select prompt_id, tag, confidence, classifier from votes
union all select * from llm where prompt_id not in (select prompt_id from agreed)""", *F4V, extra=ENSEMBLE_CTES))
def q_ensemble(spark, d):
    votes = heur(spark, d).unionByName(f4_prompt_tags(spark, d))
    return CL.ensemble_vote(votes, ["heuristic", "bench"], llm_votes(spark, d))


@register("ensemble_vote_always", with_views("""
select prompt_id, tag, confidence, classifier from votes union all select * from llm""", *F4V, extra=ENSEMBLE_CTES))
def q_ensemble_always(spark, d):
    votes = heur(spark, d).unionByName(f4_prompt_tags(spark, d))
    return CL.ensemble_vote(votes, ["heuristic", "bench"], llm_votes(spark, d), llm_only_on_disagreement=False)


def existing_tags(spark, d):
    h = heur(spark, d).filter(F.col("prompt_id") % 4 == 0)
    return f4_prompt_tags(spark, d).unionByName(h)


UNL_CTES = dict(HEUR_CTES)
UNL_CTES.update({
    "existing": "select * from f4_prompt_tags union all select * from heur where prompt_id % 4 = 0",
    "considered": "select prompt_id from f4_prompts where prompt_id not in (select prompt_id from existing where classifier = 'heuristic')",
    "preds": """select prompt_id, tag, classifier, max(confidence) as confidence from heur
                where prompt_id in (select prompt_id from considered) group by prompt_id, tag, classifier""",
    "newtags": """select p.* from preds p where not exists (select 1 from existing e where e.prompt_id = p.prompt_id
                  and e.tag = p.tag and e.classifier = p.classifier)""",
})


@register("classify_unlabeled", with_views("select prompt_id, tag, classifier, confidence from newtags", *F4V,
                                           extra=UNL_CTES))
def q_unlabeled(spark, d):
    return CL.classify_unlabeled(f4_prompts(spark, d), existing_tags(spark, d), heur(spark, d),
                                 only_missing_classifier="heuristic")["new"]


@register("classify_unlabeled_counters", with_views("""
select (select count(*) from f4_prompts) as prompts_seen,
       (select count(distinct prompt_id) from preds) as prompts_classified,
       (select count(*) from newtags) as tags_written,
       (select count(*) from preds) - (select count(*) from newtags) as tags_skipped_existing""", *F4V,
    extra={**UNL_CTES, "preds": """select prompt_id, tag, classifier, max(confidence) as confidence from heur
                group by prompt_id, tag, classifier""",
           "newtags": """select p.* from preds p where not exists (select 1 from existing e where e.prompt_id = p.prompt_id
                  and e.tag = p.tag and e.classifier = p.classifier)"""}))
def q_unlabeled_counters(spark, d):
    return CL.classify_unlabeled(f4_prompts(spark, d), existing_tags(spark, d), heur(spark, d))["counters"]


@register("tag_intended", with_views("""
select prompt_id, json_extract_string(source_metadata, '$.intended_tag') as tag, 'bench' as classifier,
       1e0 as confidence
from f4_prompts
where source = 'bench:f4' and json_type(source_metadata, '$.intended_tag') = 'VARCHAR'
  and json_extract_string(source_metadata, '$.intended_tag') <> ''
  and not (prompt_id % 3 = 0 and json_extract_string(source_metadata, '$.intended_tag') <> 'other')""", *F4V,
    extra=HEUR_CTES))
def q_tag_intended(spark, d):
    have = f4_prompt_tags(spark, d).filter(F.col("prompt_id") % 3 == 0)
    return CL.tag_intended(f4_prompts(spark, d), have, source="bench:f4")


@register("top_predictions", with_views("""
select * from (select prompt_id, tag, confidence, classifier,
       cast(row_number() over (partition by prompt_id order by confidence desc, tag, classifier) as integer) as rank from heur) t
where rank <= 2""", *F4V, extra=HEUR_CTES))
def q_top(spark, d):
    return CL.top_predictions(heur(spark, d), 2)


def ladder_input(spark, d):
    p = f4_prompts(spark, d)
    bench = f4_prompt_tags(spark, d).filter(F.col("prompt_id") % 2 == 0)
    human = (p.filter(F.col("prompt_id") % 13 == 0)
              .select("prompt_id", F.lit("reasoning").alias("tag"), F.lit(1.0).alias("confidence"),
                      F.lit("human").alias("classifier")))
    return heur(spark, d).unionByName(bench).unionByName(human)


LADDER_CTES = dict(HEUR_CTES)
LADDER_CTES.update({
    "lin": """select * from heur union all select * from f4_prompt_tags where prompt_id % 2 = 0
              union all select prompt_id, 'reasoning', 1e0, 'human' from f4_prompts where prompt_id % 13 = 0""",
    "rt": """select prompt_id, tag, confidence, case when classifier = 'human' then 1 when classifier = 'bench' then 2
                 when classifier = 'heuristic' and tag <> 'unknown' then 3 end as rung from lin""",
    "best": "select prompt_id, min(rung) as rung from rt where rung is not null group by prompt_id",
    "top3": """select prompt_id, tag, 3 as rung from (select prompt_id, tag, row_number() over
               (partition by prompt_id order by confidence desc, tag) as rn from rt where rung = 3) x where rn = 1""",
    "labels": """select u.prompt_id, u.tag, u.rung from (select distinct prompt_id, tag, rung from rt where rung < 3
                 union all select * from top3) u join best b on b.prompt_id = u.prompt_id and b.rung = u.rung""",
    "balance": "select tag, count(*) as n from labels group by tag",
})


@register("label_examples", with_views("""
select l.prompt_id, l.tag, p.content from labels l join f4_prompts p on p.prompt_id = l.prompt_id
where l.tag in (select tag from balance where n >= 3)""", *F4V, extra=LADDER_CTES))
def q_label_examples(spark, d):
    return CL.label_examples(f4_prompts(spark, d), ladder_input(spark, d))


@register("label_balance", with_views("select * from balance", *F4V, extra=LADDER_CTES))
def q_label_balance(spark, d):
    return CL.label_balance(CL.ladder_labels(ladder_input(spark, d)))


def llm_replies(spark, d):
    p = f4_prompts(spark, d)
    k = F.col("prompt_id") % 4
    tag = F.get_json_object("source_metadata", "$.intended_tag")
    reply = (F.when(k == 0, F.concat(F.lit('{"tags": [{"tag": "'), tag, F.lit('", "confidence": 0.9}, '
                                                                           '{"tag": "planning", "confidence": 0.2}]}')))
              .when(k == 1, F.concat(F.lit('Sure: {"tags": [{"tag": "'), tag, F.lit('"}, {"tag": "not_a_tag"}]} ok')))
              .when(k == 2, F.lit('{"tags": [{"tag": "math", "confidence": "high"}, {"tag": "coding", "confidence": 7}]}'))
              .otherwise(F.lit("I think it is coding")))
    return p.select("prompt_id", reply.alias("reply"))


@register("parse_llm_tags", with_views("""
select prompt_id, tag, confidence, 'llm' as classifier from (
  select prompt_id, json_extract_string(source_metadata, '$.intended_tag') as tag, 0.9e0 as confidence
  from f4_prompts where prompt_id % 4 = 0
  union all
  select prompt_id, json_extract_string(source_metadata, '$.intended_tag'), 0.5e0 from f4_prompts where prompt_id % 4 = 1
  union all
  select prompt_id, 'coding', 1e0 from f4_prompts where prompt_id % 4 = 2) t
where tag in ('coding', 'reasoning', 'math', 'summarization', 'extraction', 'classification', 'creative',
              'conversation', 'instruction', 'translation', 'qa_factual', 'rewrite', 'planning', 'unknown')""",
    *F4V))
def q_parse_llm_tags(spark, d):
    return CL.parse_llm_tags(llm_replies(spark, d), default_taxonomy(spark))


_MODELS: dict = {}


def _train(spark, d):
    """Train once per (application, sf_dir); both ML queries share the models."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = ML.train(CL.label_examples(f4_prompts(spark, d), ladder_input(spark, d)))
    return _MODELS[key]


@register("classify_ml_train", with_views("""
select tag, cast(n as bigint) as n_examples, true as converged from balance where n >= 3""", *F4V, extra=LADDER_CTES))
def q_ml_train(spark, d):
    """Examples of each trained tag, and that its regression reached the tolerance."""
    return _train(spark, d).tags.select("tag", "n_examples", "converged")


@register("classify_ml_predict")
def q_ml_predict(spark, d):
    return ML.predict(f4_prompts(spark, d), _train(spark, d))


#: terms as the tagger reads them; f4 prompts have no accents
TERM_CTES = {
    "words": "select prompt_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}') as w from f4_prompts",
    "each": """select prompt_id, unnest(w) as term from words
               union all select prompt_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words""",
    "tfs": "select prompt_id, term, count(*) as tf from each group by all",
    "size": "select count(*) as n from f4_prompts",
    "voc": """select term, count(*) as df, ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0 as idf from tfs, size
              group by term having count(*) >= 2 and count(*) <= 0.95 * any_value(n)""",
    "val": "select prompt_id, term, (1e0 + ln(tf)) * idf as v from tfs join voc using (term)",
    "len": "select prompt_id, sqrt(sum(v * v)) as l from val group by prompt_id",
}


@register("ml_vocabulary", with_views("select term, df, round(idf, 9) as idf from voc", *F4V, extra=TERM_CTES))
def q_ml_vocabulary(spark, d):
    docs = f4_prompts(spark, d)
    return ML.vocabulary(ML.terms(docs), docs.count()).select("term", "df", F.round("idf", 9).alias("idf"))


@register("ml_tfidf", with_views("select prompt_id, term, round(v / l, 9) as value from val join len using (prompt_id)", *F4V, extra=TERM_CTES))
def q_ml_tfidf(spark, d):
    docs = f4_prompts(spark, d)
    found = ML.terms(docs)
    return ML.tfidf(found, ML.vocabulary(found, docs.count())).select("prompt_id", "term", F.round("value", 9).alias("value"))


@register("classify_ml_declared", with_views("""
select prompt_id, json_extract_string(source_metadata, '$.intended_tag') as tag from f4_prompts
where (prompt_id // 8) % 2 = 1 and json_extract_string(source_metadata, '$.intended_tag') is not null""", *F4V))
def q_ml_declared(spark, d):
    """Declared tags of half the prompts are learned, those of the other half predicted: the texts tell the tags apart."""
    docs = f4_prompts(spark, d).withColumn("tag", F.get_json_object("source_metadata", "$.intended_tag")).where("tag is not null")
    models = ML.train(docs.where("(prompt_id div 8) % 2 = 0").select("prompt_id", "tag", "content"))
    return ML.predict(docs.where("(prompt_id div 8) % 2 = 1"), models, threshold=0.5).select("prompt_id", "tag")
