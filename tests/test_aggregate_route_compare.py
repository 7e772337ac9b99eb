from pyspark.sql import functions as F

from evalspark.operators import aggregate as A
from evalspark.operators import compare as C
from evalspark.operators import route as R


def _history(spark, rows):
    """rows: (model, size, cost, latency, tag, [passes]) -> P, T, M, R, E frames."""
    prompts, tags, models, runs, evals = [], [], {}, [], []
    for i, (model, size, cost, lat, tag, results) in enumerate(rows):
        pid = f"p{i}"
        prompts.append((pid, f"prompt {i}"))
        tags.append((pid, tag, "heuristic", 0.9))
        models[model] = (model, size, 4096)
        for j, ok in enumerate(results):
            rid = f"r{i}-{j}"
            runs.append((rid, pid, model, cost, lat))
            evals.append((rid, "human_pass", 1.0 if ok else 0.0, ok))
    P = spark.createDataFrame(prompts, "prompt_id string, content string")
    T = spark.createDataFrame(tags, "prompt_id string, tag string, classifier string, confidence double")
    M = spark.createDataFrame(list(models.values()), "name string, size_params_b double, context_window long")
    Rn = spark.createDataFrame(runs, "run_id string, prompt_id string, model string, cost_usd double, latency_ms long")
    E = spark.createDataFrame(evals, "run_id string, rubric string, score double, passed boolean")
    return P, T, M, Rn, E


def test_three_classifiers_count_once(spark):
    P, T, M, Rn, E = _history(spark, [("m", 3.0, 0.01, 100, "coding", [True, True, False])])
    extra = T.select("prompt_id", "tag", F.lit("ml").alias("classifier"), "confidence").unionByName(
        T.select("prompt_id", "tag", F.lit("llm").alias("classifier"), "confidence"))
    agg = A.agg_tag_model(T.unionByName(extra), Rn, M, E, ["human_pass"]).collect()
    assert len(agg) == 1 and agg[0].n_evals == 3 and agg[0].n_passed == 2
    assert A.agg_tag_model(T, Rn, M, E, []).count() == 0
    assert A.agg_tag_model(T, Rn, M, E, ["human_pass"], tags=[]).count() == 0


def test_pass_rate_ignores_unknown_verdicts(spark):
    P, T, M, Rn, E = _history(spark, [("m", 3.0, None, None, "qa", [True, True, True, False, False])])
    E2 = E.unionByName(spark.createDataFrame([(f"r0-{j}", "human_pass", 0.5, None) for j in range(5)],
                                             "run_id string, rubric string, score double, passed boolean"))
    a = A.agg_tag_model(T, Rn, M, E2, ["human_pass"]).first()
    assert (a.n_evals, a.n_passed, a.n_passed_known, a.pass_rate) == (10, 3, 5, 0.6)
    assert a.avg_cost_usd is None and a.cost_per_pass is None


def test_router_smallest_fallback_and_weights(spark):
    P, T, M, Rn, E = _history(spark, [
        ("local/tiny-3b", 3.0, 0.004, 900, "coding", [True, True, True]),
        ("local/big-70b", 70.0, 0.001, 100, "coding", [True, True, True]),
        ("local/poor-7b", 7.0, 0.0, 10, "math", [False, False, True]),
        ("local/one-3b", 3.0, 0.0, 10, "translation", [True]),
    ])
    agg = A.agg_tag_model(T, Rn, M, E, ["human_pass"])
    rec = {r.prompt_id: r for r in R.recommend(P, T, agg).collect()}
    assert rec["p0"].model == "local/tiny-3b" and rec["p0"].fallback is False
    assert rec["p2"].model == "local/poor-7b" and rec["p2"].fallback is True
    assert rec["p3"].fallback is True                      # 1 sample < min_samples
    cheap = {r.prompt_id: r.model for r in R.recommend(P, T, agg, weights="cheap").collect()}
    fast = {r.prompt_id: r.model for r in R.recommend(P, T, agg, weights="fast").collect()}
    assert cheap["p0"] == "local/big-70b" and fast["p0"] == "local/big-70b"
    none = spark.createDataFrame([("zz",)], "prompt_id string")
    r = R.recommend(none, T, agg).first()
    assert r.model is None and r.reason == "no_stats"
    try:
        R.weights_from("nope")
        raise AssertionError("unknown preset must fail")
    except ValueError:
        pass
    assert R.Weights(0, 0, 0).normalize() == R.Weights(1.0, 0.0, 0.0)


def _cmp(spark, a, b, **kw):
    P, T, M, Rn, E = _history(spark, [("A", 1.0, None, None, "t", a), ("B", 1.0, None, None, "t", b)])
    agg = A.agg_tag_model(T, Rn, M, E, ["human_pass"])
    pairs = spark.createDataFrame([("A", "B")], "model_a string, model_b string")
    return C.compare(agg, pairs, **kw).first()


def test_compare_cases(spark):
    r = _cmp(spark, [True] * 20, [False] * 20)
    assert r.significant and r.winner == "A"
    assert _cmp(spark, [True] * 3, [True, True, False]).winner == "tie"
    assert _cmp(spark, [True] * 3, [True, True, False], require_significance=False).winner == "A"
    r = _cmp(spark, [True] * 19 + [False], [True] * 18 + [False] * 2, require_significance=False)
    assert r.winner == "tie"                       # delta == threshold counts as a tie
    P, T, M, Rn, E = _history(spark, [("A", 1.0, None, None, "t", [True])])
    agg = A.agg_tag_model(T, Rn, M, E, ["human_pass"])
    try:
        C.compare_pair(agg, M, "A", "missing")
        raise AssertionError("unknown model must fail")
    except ValueError as e:
        assert "missing" in str(e)
