import json

from pyspark.sql import functions as F

from evalspark.operators import report as RP
from evalspark.sources import harness as HA
from evalspark.sources.store import default_taxonomy

COLS = ("id string, task string, supervisor_model string, worker_model string, worker_sequence string, "
        "coder_flagged_complete int, success int, total_tokens long, num_loops int, timestamp string, "
        "estimated_api_cost_usd double, run_duration_seconds double, complexity_score double, "
        "usefulness_score double, data_value_score double, scalability_score double, project_id string, "
        "conversation_messages string, tools_used string, tool_results string")


def _row(i, task, worker="openai/gpt-4o-mini", sup="anthropic/claude-x", success=1, msgs=None, dur=1.2345,
         scores=(4.0, None, 2.0, None)):
    return (i, task, sup, worker, '["a"]', 1, success, 10, 2, "2024-05-01T10:00:00Z", 0.01, dur, *scores,
            "proj", json.dumps(msgs if msgs is not None else [
                {"role": "user", "content": task}, {"role": "assistant", "content": "  final  "},
                {"role": "tool", "content": "later"}]), None, None)


def test_harness_plain_text_fields_and_padded_tasks(spark):
    row = list(_row("p", "  hi \n"))
    row[4], row[-2], row[-1] = "coder then tester", "not json", '["x"] and more'
    out = HA.import_harness_log(spark.createDataFrame([tuple(row)], COLS), None, None, None)
    prompt, run = out["prompts"].first(), json.loads(out["runs"].first().run_metadata)
    assert prompt.char_count == 2 and prompt.content == "hi"
    assert (run["worker_sequence"], run["tools_used"], run["tool_results"]) == ("coder then tester", "not json", '["x"] and more')


def test_harness_import(spark):
    rows = [_row("a", "Do X"), _row("b", "  "), _row("c", "Do Y", worker=None, sup=None),
            _row("d", "Do  X", success=None, dur=0.0019,
                 msgs=[{"role": "assistant", "content": "  "}, {"role": "user", "content": "only user"}]),
            _row("e", "Do Z")]
    log = spark.createDataFrame(rows, COLS)
    known = spark.createDataFrame([("e",)], "ai_harness_id string")
    out = HA.import_harness_log(log, None, None, known)
    c = out["counters"].first()
    assert (c.runs_seen, c.runs_imported, c.runs_skipped_existing, c.errors) == (5, 2, 1, 2)
    assert c.prompts_inserted == 2              # "Do X" == "Do  X"; "Do Y" created before its model check
    assert c.models_registered == 1
    runs = {r.run_id: r for r in out["runs"].collect()}
    assert runs["ai_harness:a"].response == "final" and runs["ai_harness:a"].latency_ms == 1234
    assert runs["ai_harness:d"].response == "only user" and runs["ai_harness:d"].latency_ms == 1
    ev = {(r.run_id, r.rubric): r for r in out["evaluations"].collect()}
    assert ev[("ai_harness:a", "human_pass")].passed is True and ("ai_harness:d", "human_pass") not in ev
    assert ev[("ai_harness:a", "complexity")].score == 4.0 and ev[("ai_harness:a", "complexity")].passed is None
    assert ("ai_harness:a", "usefulness") not in ev and ev[("ai_harness:a", "data_value")].scored_by == "llm"
    models = {r.name: r for r in out["models"].collect()}
    assert models["openai/gpt-4o-mini"].provider == "openai" and models["openai/gpt-4o-mini"].family == "gpt"


def test_freshness_and_quality(spark):
    ev = spark.createDataFrame([
        ("r1", "fresh", "auto", "2024-05-30 00:00:00"), ("r2", "fresh", "auto", "2024-05-31 00:00:00"),
        ("r3", "fresh", "human", "2024-05-01 00:00:00"), ("r4", "old", "llm", "2024-03-01 00:00:00")],
        "run_id string, rubric string, scored_by string, created_at string").withColumn(
        "created_at", F.to_timestamp("created_at"))
    f = {r.rubric: r for r in RP.rubric_freshness(ev, "2024-06-01 00:00:00", 30).collect()}
    assert f["fresh"].n_evals == 3 and f["fresh"].stale is False and f["fresh"].age_days == 1.0
    assert f["fresh"].scored_by_breakdown == "auto:2,human:1"
    assert f["old"].stale is True and round(f["old"].age_days) == 92
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt_id string")
    tags = spark.createDataFrame([("p1", "x")], "prompt_id string, tag string")
    models = spark.createDataFrame([], "name string")
    checks = {r.check: r for r in RP.quality_checks(prompts, tags, models, ev, default_taxonomy(spark)).collect()}
    assert checks["classification"].status == "warn" and checks["models"].status == "warn"
    assert checks["taxonomy"].detail == "14 tags seeded" and checks["evaluations"].status == "ok"
    s = RP.summarize_checks(RP.quality_checks(prompts, tags, models, ev, default_taxonomy(spark))).first()
    assert (s.ok, s.warn, s.fail) == (4, 2, 0)


def test_check_totals_of_an_empty_store(spark):
    """Without rows every data check but the schema warns."""
    none = lambda ddl: spark.createDataFrame([], ddl)
    checks = RP.quality_checks(none("prompt_id long"), none("prompt_id long, tag string"), none("name string"), none("run_id string"), default_taxonomy(spark))
    assert tuple(RP.summarize_checks(checks).first()) == (2, 4, 0)
