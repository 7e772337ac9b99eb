import json

from evalspark.sources import store as ST

SF = "/root/testdata/sf0.001"


def test_report_json_document(spark):
    import __spark_entry__ as E
    doc = json.loads(E.queries()["report_json"](spark, SF).first().report)
    assert doc["schema_version"] == 1 and doc["generated_at"]
    h = doc["headline"]
    assert h["n_prompts"] > 0 and h["n_runs"] > 0 and h["n_evals"] > 0
    assert {"source", "count"} <= set(h["prompts_by_source"][0])
    assert sum(x["count"] for x in h["evals_by_rubric"]) == h["n_evals"]
    assert doc["scorecards"] and {"tag", "quality_pick", "has_qualifying"} <= set(doc["scorecards"][0])
    assert {f["rubric"] for f in doc["rubric_freshness"]} == {x["rubric"] for x in h["evals_by_rubric"]}


def test_report_json_keeps_nulls_order_and_times(spark):
    import datetime as dt

    from evalspark.operators import report as RP
    ev = spark.createDataFrame([("r1", "few", 1.0, True, "auto", None), ("r2", "many", 1.0, True, "llm", dt.datetime(2024, 1, 2, 3, 4, 5)),
                                ("r2", "many", 1.0, True, "human", dt.datetime(2024, 1, 2, 3, 4, 5, 60)), ("r3", "many", 0.0, False, "llm", None)],
                               "run_id string, rubric string, score double, passed boolean, scored_by string, created_at timestamp")
    cards = spark.createDataFrame([("alpha", 1, None), ("zeta", 2, 0.25), ("beta", 3, None)], "tag string, n_prompts bigint, cost_pick_avg_cost double")
    counts = spark.createDataFrame([("b", 2), ("c", 5), ("a", 2)], "source string, n bigint")
    secs = {"headline": spark.createDataFrame([(0, None)], "n_prompts bigint, total_cost_usd double"), "prompts_by_source": counts,
            "evals_by_rubric": counts.withColumnRenamed("source", "rubric").limit(0), "scorecards": cards, "gaps": cards.limit(0),
            "rubric_freshness": RP.freshness_rows(ev, "2024-01-12 03:04:05")}
    doc = json.loads(RP.report_json(secs, "now", spark.createDataFrame([("zeta",)], "tag string")).first().report)
    assert list(doc) == ["schema_version", "generated_at", "headline", "scorecards", "gaps", "rubric_freshness"]
    assert doc["headline"] == {"n_prompts": 0, "total_cost_usd": None, "evals_by_rubric": [],
                               "prompts_by_source": [{"source": "c", "count": 5}, {"source": "a", "count": 2}, {"source": "b", "count": 2}]}
    assert [c["tag"] for c in doc["scorecards"]] == ["zeta", "alpha", "beta"] and doc["gaps"] == []
    assert doc["scorecards"][1] == {"tag": "alpha", "n_prompts": 1, "cost_pick_avg_cost": None}
    many, few = doc["rubric_freshness"]
    assert many["last_scored_at"] == "2024-01-02T03:04:05.000060+00:00" and few["last_scored_at"] is None and few["age_days"] is None
    assert many["scored_by_breakdown"] == [{"scored_by": "llm", "count": 2}, {"scored_by": "human", "count": 1}]
    again = json.loads(RP.report_json(secs | {"rubric_freshness": RP.freshness_rows(ev.filter("created_at < '2024-01-02 03:04:05.00001'"), "2024-01-12 03:04:05")},
                                      "now").first().report)
    assert again["rubric_freshness"][0]["last_scored_at"] == "2024-01-02T03:04:05+00:00" and again["rubric_freshness"][0]["age_days"] == 10.0
    assert [c["tag"] for c in again["scorecards"]] == ["alpha", "beta", "zeta"]


def test_taxonomy_seed_inserts_missing_only(spark):
    existing = spark.createDataFrame([("coding", "my words", None), ("custom", "x", "coding")],
                                     "tag string, description string, parent string")
    seeded = ST.taxonomy_after_seed(existing)
    rows = {r.tag: r for r in seeded.collect()}
    assert len(rows) == 15 and rows["coding"].description == "my words" and rows["custom"].parent == "coding"
    assert ST.taxonomy_seed(seeded).count() == 0          # idempotent
