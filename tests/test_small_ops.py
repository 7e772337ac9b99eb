from evalspark.operators import aggregate as A
from evalspark.operators import classify as CL


def _agg(spark):
    return spark.createDataFrame(
        [("coding", "a", 3, 0.5), ("coding", "b", 2, 1.0), ("math", "a", 1, 0.0)],
        "tag string, model string, n_evals long, pass_rate double")


def test_heatmap_and_fill(spark):
    h = {r.tag: r for r in A.heatmap(_agg(spark), ["a", "b"], "pass_rate").collect()}
    assert h["coding"]["a"] == 0.5 and h["math"]["b"] is None
    n = {r.tag: r for r in A.heatmap(_agg(spark), ["a", "b"], "n_evals", fill=0).collect()}
    assert n["math"]["b"] == 0 and n["coding"]["b"] == 2


def test_group_by_first_key(spark):
    g = {(r.tag, r.model): r for r in A.group_by_first_key(_agg(spark)).collect()}
    assert set(g) == {("coding", "a"), ("coding", "b"), ("math", "a")}
    for model, n, rate in (("a", 3, 0.5), ("b", 2, 1.0)):
        r = g["coding", model]
        assert (r.n_models, r.tag_evals, r.n_evals, r.pass_rate) == (2, 5, n, rate)
    assert (g["math", "a"].n_models, g["math", "a"].tag_evals) == (1, 1)
    assert A.group_by_first_key(_agg(spark).limit(0)).count() == 0


def test_top_predictions_all_and_n(spark):
    v = spark.createDataFrame([(1, "x", 0.2, "h"), (1, "y", 0.9, "h"), (1, "z", 0.5, "ml"), (2, "x", 0.1, "h")],
                              "prompt_id long, tag string, confidence double, classifier string")
    assert CL.top_predictions(v, 0).count() == 4
    top = [(r.prompt_id, r.tag) for r in CL.top_predictions(v, 1).orderBy("prompt_id").collect()]
    assert top == [(1, "y"), (2, "x")]
