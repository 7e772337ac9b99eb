"""Routing from texts: votes decide the tags, tags the history, history the pick and its reason."""
import pytest

from evalspark.operators import route as R

AGG = ("tag string, model string, size_params_b double, context_window int, n_evals bigint, n_passed bigint, n_passed_known bigint, "
       "avg_score double, avg_cost_usd double, avg_latency_ms double")
VOTE = "prompt_id bigint, tag string, confidence double, classifier string"


@pytest.fixture(scope="module")
def agg(spark):
    return spark.createDataFrame([("coding", "big", 70.0, 1, 10, 9, 10, 0.9, 0.5, 9.0), ("coding", "small", 7.0, 1, 10, 8, 10, 0.8, 0.1, 5.0),
                                  ("math", "big", 70.0, 1, 2, 2, 2, 1.0, 0.5, 9.0), ("math", "small", 7.0, 1, 10, 1, 10, 0.1, 0.1, 5.0)], AGG)


def test_votes_history_and_reasons(spark, agg):
    prompts = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, None), (4, ""), (5, "hello"), (6, "hello")], "prompt_id bigint, content string")
    votes = spark.createDataFrame([(1, "coding", 0.9, "ml"), (2, "math", 0.4, "ml"), (2, "unknown", 0.9, "ml"), (5, "poetry", 1.0, "ml"),
                                   (6, "math", 0.2, "ml"), (6, "coding", 0.7, "ml"), (6, "math", 0.3, "ml"), (1, "math", 1.0, "stray")], VOTE)
    got = {r.prompt_id: r for r in R.route_texts(prompts, agg, votes=votes, members=("ml",), weights="size").collect()}
    assert len(got) == 6
    assert got[1].model == "small" and not got[1].fallback and got[1].tags == "coding"     # the stray classifier has no vote
    assert got[1].reason == ("best composite score under weights (size=1.00, cost=0.00, latency=0.00) among models with "
                             "pass_rate >= 70% over >= 3 runs on tags ['coding']")
    assert got[2].model == "big" and got[2].fallback and got[2].sample_count == 2
    assert got[2].reason == "no model met threshold 70% with >= 3 samples; falling back to best available"
    for i in (3, 4, 5):
        assert got[i].model is None and not got[i].fallback and got[i].reason == "no historical evaluations for these tags"
    assert got[5].tags == "poetry" and got[3].tags is None
    assert got[6].tags == "coding,math" and got[6].sample_count == 12 and got[6].model == "big"    # surest tag first; both tags' runs


def test_llm_votes_only_on_disagreement(spark, agg):
    prompts = spark.createDataFrame([(1, "x"), (2, "x")], "prompt_id bigint, content string")
    votes = spark.createDataFrame([(1, "coding", 0.9, "a"), (1, "coding", 0.5, "b"), (2, "coding", 0.9, "a"), (2, "poetry", 0.9, "b")], VOTE)
    llm = spark.createDataFrame([(1, "math", 1.0, "llm"), (2, "math", 1.0, "llm")], VOTE)
    got = {r.prompt_id: r.tags for r in R.route_texts(prompts, agg, votes=votes, members=("a", "b"), llm_votes=llm).collect()}
    assert got == {1: "coding", 2: "math,coding,poetry"}


def test_heuristic_reads_the_texts(spark, agg):
    from evalspark.operators.classify import classify_heuristic
    prompts = spark.createDataFrame([(1, "Write a python function def f(x): return x and fix the bug in this code"), (2, "qqq")],
                                    "prompt_id bigint, content string")
    seen = {r.prompt_id for r in classify_heuristic(prompts).filter("tag = 'coding'").collect()}
    got = {r.prompt_id: r for r in R.route_texts(prompts, agg).collect()}
    assert seen == {1} and got[1].model is not None and "coding" in got[1].tags and got[2].model is None
