import json
import os

from evalspark.operators import ingest as IG
from evalspark.sources import exports as EX
from evalspark.sources import seeds as SD


def _write(d, name, obj):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))
    return p


def _raw(spark, rows):
    return spark.createDataFrame([(c, "test", str(i), None, None, i) for i, c in enumerate(rows)],
                                 "content string, source string, source_ref string, created_at timestamp, "
                                 "metadata string, order long")


def test_dedup_first_wins_and_counters(spark):
    raw = _raw(spark, ["Hello   world", "hello world", "Hello world\n", "  ", "", "line one\nline two",
                       "Hello\x1cworld"])
    stored = spark.createDataFrame([(IG.content_hash if False else None,)], "content_hash string").limit(0)
    out = IG.dedup_prompts(raw, stored, ingested_at="2024-01-01 00:00:00")
    new = {r.source_ref: r for r in out["new"].collect()}
    assert set(new) == {"0", "1", "5"}          # first of the "Hello world" copies wins
    assert new["0"].content == "Hello world" and new["0"].char_count == len("Hello   world")
    assert new["5"].content == "line one\nline two"   # kept verbatim: it has a newline
    c = out["counters"].first()
    assert (c.inserted, c.duplicates, c.skipped) == (3, 2, 2)
    again = IG.dedup_prompts(raw, out["new"], ingested_at="2024-01-02 00:00:00")
    c2 = again["counters"].first()
    assert (c2.inserted, c2.duplicates, c2.skipped) == (0, 5, 2)
    assert IG.ingest_dry_run(raw, None).first().inserted == 3


def test_claude_and_grok_readers(spark, tmpdir_path):
    _write(tmpdir_path, "claude/export.json", {"conversations": [
        {"uuid": "c1", "name": "N", "chat_messages": [
            {"sender": "human", "text": "  first  ", "created_at": "2024-01-02T03:04:05Z"},
            {"sender": "assistant", "text": "reply"},
            {"sender": "human", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "image"},
                                                        {"type": "text", "text": "b"}]},
            {"role": "user", "content": "  "}]}]})
    rows = EX.read_claude_export(spark, os.path.join(tmpdir_path, "claude")).orderBy("source_ref").collect()
    assert [(r.content, r.source_ref) for r in rows] == [("first", "c1:0"), ("a\nb", "c1:2")]
    assert str(rows[0].created_at).startswith("2024-01-02 03:04:05")
    _write(tmpdir_path, "grok/a.json", [{"id": "g1", "messages": [{"role": "user", "content": "q1", "timestamp": 1700000000},
                                                                  {"author": "human", "text": "q2", "timestamp": 1700000000000}]}])
    _write(tmpdir_path, "grok/sub/b.json", [{"role": "user", "content": "bare"}, {"role": "assistant", "content": "x"}])
    _write(tmpdir_path, "grok/bad.json", "{not json")
    rows = EX.read_grok_export(spark, os.path.join(tmpdir_path, "grok")).orderBy("source_ref").collect()
    got = [(r.content, r.source_ref) for r in rows]
    assert got == [("q1", "a.json#g1:0"), ("q2", "a.json#g1:1"), ("bare", "b.json#b:0")]
    assert rows[0].created_at == rows[1].created_at


def test_lm_studio_openrouter_seed_templates(spark, tmpdir_path):
    _write(tmpdir_path, "lm/x.json", {"id": "L", "model": "qwen", "history": [
        {"role": "user", "content": ["part one", {"text": "part two"}]}, {"role": "assistant", "content": "no"},
        {"sender": "user", "message": "msg", "createdAt": "2024-02-01T00:00:00"}]})
    rows = EX.read_lm_studio_logs(spark, os.path.join(tmpdir_path, "lm")).orderBy("source_ref").collect()
    assert [(r.content, r.source_ref) for r in rows] == [("part one\npart two", "x.json#L:0"), ("msg", "x.json#L:2")]
    _write(tmpdir_path, "or/h.json", {"data": [
        {"id": "a", "prompt": "direct", "created_at": "2024-03-01T00:00:00Z"},
        {"id": "b", "messages": [{"role": "user", "content": "u1"}, {"role": "system", "content": "s"},
                                 {"role": "user", "content": "u2"}], "created_at": "2023-01-01T00:00:00Z"},
        {"generation_id": "c", "input": "no date"}]})
    rows = EX.read_openrouter_history(spark, os.path.join(tmpdir_path, "or"), cutoff="2024-01-01 00:00:00").collect()
    assert sorted((r.content, r.source_ref) for r in rows) == [("direct", "a"), ("no date", "c")]
    _write(tmpdir_path, "bench/prompts/math.jsonl",
           '{"prompt": "What is 2+2?", "category": "math", "expected_contains": ["4"]}\n\n"bare prompt"\n'
           '{"text": "   "}\n{"content": "c", "tag": "x", "bench_dir": "mine"}\n')
    rows = SD.read_bench(spark, os.path.join(tmpdir_path, "bench")).orderBy("source_ref").collect()
    assert [(r.content, r.source_ref) for r in rows] == [("What is 2+2?", "math.jsonl:0"), ("bare prompt", "math.jsonl:1"),
                                                        ("c", "math.jsonl:3")]
    m0 = json.loads(rows[0].metadata)
    assert m0["intended_tag"] == "math" and m0["expected_contains"] == ["4"] and m0["bench_dir"].endswith("bench")
    assert json.loads(rows[2].metadata)["bench_dir"] == "mine"      # record wins over overlay
    t = spark.createDataFrame([("Hi {name}",), ("{name} and {missing}",)], "template string")
    out = SD.expand_templates(t, {"name": ["a", "b"], "unused": ["x", "y"]}, intended_tag="t").collect()
    assert sorted(r.content for r in out) == ["Hi a", "Hi a", "Hi b", "Hi b"]
    assert out[0].source_ref.startswith("tmpl:") and len(out[0].source_ref) == 13


def test_template_brace_escapes(spark):
    t = spark.createDataFrame([("JSON {{\"k\": \"{v}\"}}",), ("positional {}",)], "template string")
    out = [r.content for r in SD.expand_templates(t, {"v": ["a"]}).collect()]
    assert out == ['JSON {"k": "a"}']


def test_reader_odd_shapes(spark, tmpdir_path):
    _write(tmpdir_path, "g2/one.json", {"id": "solo", "messages": [
        {"sender": "user", "content": "from dict", "created_at": "2024-04-01T00:00:00+02:00"},
        {"role": "user", "content": 42}, "not a message"]})
    _write(tmpdir_path, "g2/conv.json", {"conversations": [{"messages": [{"role": "human", "text": "hi"}]}]})
    rows = EX.read_grok_export(spark, os.path.join(tmpdir_path, "g2")).orderBy("source_ref").collect()
    got = [(r.content, r.source_ref) for r in rows]
    assert ("from dict", "one.json#solo:0") in got and ("hi", "conv.json#conv:0") in got and len(got) == 2
    solo = [r for r in rows if r.content == "from dict"][0]
    assert str(solo.created_at).startswith("2024-03-31 22:00:00")       # offset normalised to UTC
    _write(tmpdir_path, "lm2/bare.json", [{"role": "user", "text": "bare list", "time": 1700000000000},
                                          {"role": "system", "content": "x"}])
    _write(tmpdir_path, "lm2/broken.json", "[{")
    rows = EX.read_lm_studio_logs(spark, os.path.join(tmpdir_path, "lm2")).collect()
    assert [(r.content, r.source_ref) for r in rows] == [("bare list", "bare.json#bare:0")]
    assert str(rows[0].created_at).startswith("2023-11-14 22:13:20")    # epoch milliseconds
    _write(tmpdir_path, "c2/x.json", ["not a conversation", {"id": 7, "messages": [
        {"role": "user", "content": "numeric id"}]}])
    rows = EX.read_claude_export(spark, os.path.join(tmpdir_path, "c2")).collect()
    assert [(r.content, r.source_ref) for r in rows] == [("numeric id", "7:0")]
