"""Reference test cases for cost estimation, names, catalogs and payloads."""
import json

from pyspark.sql import functions as F

from evalspark.functions import text as TX
from evalspark.operators import runs as RU
from evalspark.sources import catalog as CA


def test_estimate_cost_cases(spark):
    rows = [(None, 100, 1.0, 2.0), (100, None, 1.0, 2.0), (100, 50, None, None), (1000, 0, 2.0, None),
            (1_000_000, 1_000_000, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "ti long, to long, ci double, co double")
    got = [r.c for r in df.select(TX.estimate_cost("ti", "to", "ci", "co").alias("c")).collect()]
    assert got[:3] == [None, None, None]
    assert abs(got[3] - 0.002) < 1e-12 and abs(got[4] - 3.0) < 1e-12


def test_size_and_family_from_names(spark):
    cases = {"qwen3.5-2b": 2.0, "qwen3.5-0.8b": 0.8, "google/gemma-3-4b": 4.0, "google/gemma-4-26b-a4b": 26.0,
             "qwen/qwen3.5-35b-a3b": 35.0, "smollm2-135m-instruct": 0.135,
             "text-embedding-nomic-embed-text-v1.5": None, "randomthing": None}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    prov, fam = TX.provider_family("name")
    out = {r.name: r for r in df.select("name", TX.size_from_name("name").alias("s"), prov.alias("p"),
                                        fam.alias("f")).collect()}
    for k, v in cases.items():
        assert out[k].s == v, k
    assert (out["google/gemma-3-4b"].p, out["google/gemma-3-4b"].f) == ("google", "gemma")
    assert (out["randomthing"].p, out["randomthing"].f) == ("unknown", "randomthing")
    assert TX.provider_family  # (provider, family) of 'a/' -> family NULL
    e = spark.createDataFrame([("anthropic/",)], "name string").select(fam.alias("f")).first()
    assert e.f is None


def test_model_provider(spark):
    df = spark.createDataFrame([(True, "x"), (False, "lm_studio"), (False, "openrouter"), (False, "anthropic"),
                                (None, "meta")], "local boolean, provider string")
    got = [r.p for r in df.select(TX.model_provider("local", "provider").alias("p")).collect()]
    assert got == ["lm_studio", "lm_studio", "openrouter", "openrouter", "openrouter"]


def test_catalog_cases(spark):
    priced = {"id": "north/claude-lake-2", "context_length": 65536, "pricing": {"prompt": "0.00000025", "completion": "0.00000075"}}
    odd_prices = {"bare": None, "words": {"prompt": "ask us", "completion": []}, "text": "0.5", "list": [1, 2]}
    lengths = {"digits": ("4096", 4096), "whole": (8192.0, 8192), "truth": (False, None), "word": ("long", None)}
    entries = [priced, {"id": "south/cheap", "pricing": {"prompt": "0.000002", "completion": "0"}}, {"id": ["no", "name"]}, 3.5]
    entries += [{"id": f"odd/{k}", **({"pricing": v} if v is not None else {})} for k, v in odd_prices.items()]
    entries += [{"id": f"len/{k}", "context_length": v} for k, (v, _) in lengths.items()]
    docs = spark.createDataFrame([("/listing.json", json.dumps({"data": entries}))], "path string, text string")
    m = {r.name: r for r in CA.parse_model_catalog(docs).collect()}
    assert len(m) == 2 + len(odd_prices) + len(lengths)
    c = m["north/claude-lake-2"]
    assert (c.context_window, c.family) == (65536, "claude")
    assert abs(c.cost_in_per_mtok - 0.25) < 1e-9 and abs(c.cost_out_per_mtok - 0.75) < 1e-9
    assert m["south/cheap"].cost_in_per_mtok == 2.0
    assert all(m[f"odd/{k}"].cost_in_per_mtok is None for k in odd_prices)
    assert {k: m[f"len/{k}"].context_window for k in lengths} == {k: w for k, (_, w) in lengths.items()}


def test_chat_payloads_and_replay(spark):
    models = spark.createDataFrame([("m", 1.0, 2.0)], "name string, cost_in_per_mtok double, cost_out_per_mtok double")
    rows = [("p1", '{"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}', None),
            ("p2", '{"choices": [{"message": {"content": null}}]}', None),
            ("p3", '{"choices": []}', None),
            ("p4", '{"choices": [{"text": "x"}]}', None),
            ("p5", '{"error": "x"}', None),
            ("p6", None, "HTTPStatusError: 500\nFor more information check: url")]
    rep = spark.createDataFrame([(p, "m", pl, e, 5) for p, pl, e in rows],
                                "prompt_id string, model string, payload string, http_error string, latency_ms int")
    out = {r.prompt_id: r for r in RU.parse_chat_replies(rep, models).collect()}
    assert (out["p1"].response, out["p1"].tokens_in, out["p1"].tokens_out) == ("hi", 7, 3)
    assert abs(out["p1"].cost_usd - (7 / 1e6 * 1.0 + 3 / 1e6 * 2.0)) < 1e-15
    assert out["p2"].response == "" and out["p2"].cost_usd is None
    assert out["p3"].error == "parse_error: IndexError('list index out of range')"
    assert out["p4"].error == "parse_error: KeyError('message')"
    assert out["p5"].error == "parse_error: KeyError('choices')"
    assert out["p6"].error == "http_error: HTTPStatusError: 500" and out["p6"].response is None
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(1, 8)], "prompt_id string")
    work = RU.fanout_work(prompts, models, None)
    res = RU.fanout_replay(work, rep.unionByName(rep), models, "2024-01-01 00:00:00")
    c = res["counters"].first()
    assert (c.attempted, c.succeeded, c.failed) == (7, 2, 5)      # duplicate recordings do not double runs
    assert res["runs"].filter(F.col("run_metadata").isNotNull()).count() == 0
    existing = spark.createDataFrame([("r", "p1", "m")], "run_id string, prompt_id string, model string")
    assert RU.fanout_work(prompts, models, existing).count() == 6
    assert RU.fanout_work(prompts, models, existing, skip_existing=False).count() == 7


def test_fanout_of_more_models_than_a_block(spark):
    models = spark.range(20_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name")).unionByName(
        spark.createDataFrame([("m1",), (None,)], "name string"))
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt_id string")
    runs = models.where("name is not null").limit(0).select(F.lit("p1").alias("prompt_id"), F.col("name").alias("model")).unionByName(
        spark.createDataFrame([("p2", "m7"), ("p2", "m7"), ("p9", "m1")], "prompt_id string, model string"))
    work = RU.fanout_work(prompts, models, runs)
    assert work.count() == work.distinct().count() == 60_000 - 1
    assert RU.fanout_work(prompts, models, None, model_names=["m5", "m6"]).count() == 6
    assert RU.fanout_work(prompts, models.limit(0)).count() == 0
