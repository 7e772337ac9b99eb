from evalspark.functions.rubrics import shipped
from evalspark.operators.scoring import Rubric, score_runs


def _frames(spark):
    runs = spark.createDataFrame([("r1", "p1", "Sure, here it is"), ("r2", "p1", "I cannot do that"),
                                  ("r3", "p2", "   "), ("r4", "p2", "fine")],
                                 "run_id string, prompt_id string, response string")
    prompts = spark.createDataFrame([("p1", "write code", None), ("p2", "a poem", None)],
                                    "prompt_id string, content string, source_metadata string")
    tags = spark.createDataFrame([("p1", "coding", "heuristic", 0.5)],
                                 "prompt_id string, tag string, classifier string, confidence double")
    return runs, prompts, tags


def test_stale_and_fresh_rows(spark):
    runs, prompts, tags = _frames(spark)
    rub = shipped("no_refusal")
    cur = rub.config_hash()
    ev = spark.createDataFrame([("r1", "no_refusal", "old-hash", 1.0, True, "auto"),
                                ("r1", "no_refusal", cur, 1.0, True, "auto"),
                                ("r4", "no_refusal", None, 1.0, True, "auto")],
                               "run_id string, rubric string, rubric_hash string, score double, passed boolean, scored_by string")
    out = score_runs(rub, runs, prompts, ev, as_of="2024-01-01 00:00:00")
    c = out["counters"].first()
    assert (c.runs_seen, c.skipped_existing, c.skipped_no_response, c.evaluations_written, c.stale_replaced) == \
        (4, 2, 1, 1, 1)
    table = out["evaluations"].collect()
    assert sorted((r.run_id, r.rubric_hash) for r in table) == sorted(
        [("r1", cur), ("r4", None), ("r2", cur)])
    new = out["new"].first()
    assert new.run_id == "r2" and new.passed is False and new.score == 0.0 and new.scored_by == "auto"


def test_replay_append_and_tag_scope(spark):
    runs, prompts, tags = _frames(spark)
    rub = shipped("no_refusal")
    ev = spark.createDataFrame([("r1", "no_refusal", None, 1.0, True, "auto"),
                                ("r1", "other", None, 1.0, True, "auto")],
                               "run_id string, rubric string, rubric_hash string, score double, passed boolean, scored_by string")
    rep = score_runs(rub, runs, prompts, ev, mode="replace")
    c = rep["counters"].first()
    assert c.replaced == 1 and c.evaluations_written == 3
    assert rep["evaluations"].count() == 4
    app = score_runs(rub, runs, prompts, ev, mode="append")
    assert app["evaluations"].count() == 5
    scoped = Rubric("coding_only", "contains", {"none_of": ["cannot"]}, applies_to_tags=["coding"])
    c = score_runs(scoped, runs, prompts, ev, prompt_tags=tags)["counters"].first()
    assert (c.evaluations_written, c.skipped_tag_mismatch, c.skipped_no_response) == (2, 1, 1)


def test_rubric_hash_ignores_description():
    a = Rubric("x", "contains", {"none_of": ["a"]}, description="one", applies_to_tags=["b", "a"])
    b = Rubric("x", "contains", {"none_of": ["a"]}, description="two", applies_to_tags=["a", "b"])
    assert a.config_hash() == b.config_hash()
    assert a.config_hash() != Rubric("x", "contains", {"none_of": ["b"]}).config_hash()


def test_a_part_of_the_runs_leaves_other_rows_alone(spark):
    runs, prompts, _ = _frames(spark)
    rub = shipped("no_refusal")
    ev = spark.createDataFrame([("r1", "no_refusal", "old", 1.0, True, "auto"), ("r4", "no_refusal", "old", 1.0, True, "auto")],
                               "run_id string, rubric string, rubric_hash string, score double, passed boolean, scored_by string")
    cur = rub.config_hash()
    part = runs.where("run_id in ('r1', 'r2')")
    for out in (score_runs(rub, part, prompts, ev), score_runs(rub, runs, prompts, ev, run_ids=["r1", "r2"]),
                score_runs(rub, runs, prompts, ev, run_ids=part, mode="replace")):
        assert sorted((r.run_id, r.rubric_hash) for r in out["evaluations"].collect()) == [("r1", cur), ("r2", cur), ("r4", "old")]
        c = out["counters"].first()
        assert (c.runs_seen, c.stale_replaced + c.replaced) == (2, 1)


def test_llm_rubric_needs_replies_and_keeps_them(spark):
    import json

    import pytest
    runs, prompts, _ = _frames(spark)
    rub = Rubric("graded", "llm", {"model": "m", "pass_threshold": 3}, description="how good")
    ev = spark.createDataFrame([], "run_id string, rubric string, rubric_hash string, score double, passed boolean, scored_by string")
    with pytest.raises(ValueError):
        score_runs(rub, runs, prompts, ev)
    replies = spark.createDataFrame([("r1", 'x {"score": 3} y')], "run_id string, reply string")
    out = score_runs(rub, runs, prompts, ev, replies=replies)
    new = out["new"].collect()
    assert [(r.run_id, r.score, r.passed, r.judge_model, r.scored_by) for r in new] == [("r1", 3.0, True, "m", "llm")]
    assert json.loads(new[0].eval_metadata) == {"rubric_description": "how good", "raw": 'x {"score": 3} y'}
    c = out["counters"].first()
    assert (c.errors, c.evaluations_written, c.skipped_no_response) == (2, 1, 1)


def test_judge_runs_once_and_counters_without_it(spark):
    runs, prompts, _ = _frames(spark)
    ev = spark.createDataFrame([], "run_id string, rubric string, rubric_hash string, score double, passed boolean, scored_by string")
    out = score_runs(Rubric("j", "json_valid", {"required_keys": ["a"]}), runs, prompts, ev)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(out["new"]).count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in plan(out["counters"])
