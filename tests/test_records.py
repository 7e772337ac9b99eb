from __future__ import annotations

import json
import os

from evalspark.sources import exports as EX
from evalspark.sources import records as R
from evalspark.sources import seeds as SD


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_cut_keeps_records_and_refuses_the_rest():
    assert R.cut('[{"a":1}, {"b":[2]}]', "claude") == [(0, '[{"a":1}]'), (1, '[{"b":[2]}]')]
    assert [json.loads(t) for _, t in R.cut('{"x":1,"conversations":[{"a":1},{"b":2}]}', "claude")] == [
        {"conversations": [{"a": 1}]}, {"conversations": [{"b": 2}]}]
    assert R.cut('[{"role":"user"},{"role":"x"}]', "grok") == [(0, '[{"role":"user"},{"role":"x"}]')]
    assert len(R.cut('[{"messages":[]},{"messages":[]}]', "grok")) == 2
    assert json.loads(R.cut('[{"a":NaN,"b":1}]', "openrouter")[0][1]) == [{"a": None, "b": 1}]
    assert R.cut("[]", "claude") == [] and R.cut('{"data": []}', "openrouter") == []
    for bad in ("", "{", '{"a":1} x', '{"a":1}{"b":2}', "[1,]", "[1 2]", '{"a":1,}', "[1] ]"):
        for kind in R.KINDS:
            try:
                R.cut(bad, kind)
            except (ValueError, IndexError):
                continue
            raise AssertionError((bad, kind))


def test_rejects_are_rows(spark):
    conv = {"uuid": "u", "chat_messages": [{"sender": "human", "text": "hello"}]}
    docs = _docs(spark, ("/a.json", json.dumps([conv])), ("/b.json", json.dumps([conv]) + " trailing"), ("/c.json", None),
                 ("/d.json", '[{"uuid": "u", "uuid": "w", "chat_messages": [{"sender": "human", "text": "twice"}]}]'))
    assert sorted(r.content for r in EX.parse_claude_export(docs).collect()) == ["hello", "twice"]
    assert sorted(r.path for r in EX.rejects(docs, "claude").collect()) == ["/b.json", "/c.json"]
    long = R.records(_docs(spark, ("/e.json", json.dumps(["x" * 100, "y"]))), "claude", limit=50).collect()
    assert [(r.base, r.text, r.reject is None) for r in long] == [(0, None, False), (1, '["y"]', True)]


def test_an_export_larger_than_a_variant_gives_all_its_prompts(spark, tmpdir_path):
    n, body = 70, "word " * 600_000  # 210 MB
    with open(os.path.join(tmpdir_path, "big.json"), "w") as f:
        f.write("[" + ",".join('{"uuid": "c%d", "chat_messages": [{"sender": "human", "text": "%s%d"}]}' % (i, body, i) for i in range(n)) + "]")
    got = EX.read_claude_export(spark, tmpdir_path).selectExpr("source_ref", "length(content) as n").collect()
    assert sorted(r.source_ref for r in got) == sorted(f"c{i}:0" for i in range(n))
    assert all(r.n >= 3_000_000 for r in got)


def test_jsonl_lines_are_numbered_over_splits(spark, tmpdir_path):
    lines = [json.dumps({"prompt": f"prompt {i}", "tag": "t"}) if i % 7 else " " for i in range(4000)]
    with open(os.path.join(tmpdir_path, "s.jsonl"), "w") as f:
        f.write("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = SD.read_seed_prompts(spark, tmpdir_path)
        assert R.read_lines(spark, tmpdir_path).select("path").rdd.getNumPartitions() > 1
        got = {r.content: r.source_ref for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [i for i in range(4000) if i % 7]
    assert got == {f"prompt {i}": f"s.jsonl:{k}" for k, i in enumerate(kept)}
