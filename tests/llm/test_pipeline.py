from __future__ import annotations

import random

import numpy as np

import corpus_pipeline as P
from evalspark.llm import common, decontam, suffixes, toxicity
from evalspark.llm.simhash import simhash
from tests.llm.test_suffixes import brute


def test_entry_registers_everything():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14))
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffixes", "decontamination", "packing"]


def make(rnd):
    vocab = [f"{a}{b}" for a in ("ra", "to", "li", "mun", "ke", "so") for b in ("", "ta", "ro", "min", "de", "la", "go", "va")]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(i, text(30)) for i in range(5)]
    passage, short = text(110), text(60)
    docs, labels, kinds = [], [], {}
    for i in range(260):
        t, kind = text(rnd.randint(60, 400)), "clean"
        if i % 7 == 0:
            t, kind = t + " you idiot scum", "toxic"
        elif i % 11 == 0:
            t, kind = t + " " + rnd.choice(items)[1] + " " + text(20), "leak"
        elif i % 13 == 0:
            t, kind = text(30) + " " + (passage if i % 2 else short) + " " + text(30), "passage"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(kind == "toxic")))
        kinds[i] = kind
    for j, k in enumerate((3, 5, 9)):
        docs.append((300 + j, docs[k][1], "en", "t", len(docs[k][1])))
        kinds[300 + j] = "copy"
    docs += [(400, None, "en", "s", None), (401, "", None, None, 0)]
    return docs, labels, items, kinds


def test_stages_against_brute_force(spark, monkeypatch):
    docs, labels, items, kinds = make(random.Random(12))
    tables = {"labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
              "benchmark": spark.createDataFrame(items, "item_id long, text string"),
              "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")}
    for m in (toxicity, decontam, P):
        monkeypatch.setattr(m, "table", lambda _, __, name: tables[name])
    now, columns = tables["documents"], tables["documents"].columns
    kept = {}
    for name, stage in P.STAGES:
        now = common.stored(stage(spark, now, ""), "t")
        kept[name] = now.collect()
        if name != "packing":
            assert now.columns == columns
    ids = lambda n: {r["doc_id"] for r in kept[n]}
    every = {r[0] for r in docs}
    assert ids("toxicity") == {i for i in every if kinds.get(i) != "toxic"}
    # copies go, the empty texts (fingerprint 0) are one group
    fps = {r["doc_id"]: simhash((r["text"] or "").encode().lower().split(), 3) for r in kept["toxicity"]}
    groups = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
    assert ids("simhash") == {i for i in fps if groups[i] == i}
    assert not {300, 301, 302} & ids("simhash")
    before = {r["doc_id"]: r["text"] for r in kept["simhash"]}
    want = dict(zip(before, brute(list(before.values()), suffixes.PASSAGE), strict=True))
    # every passage of over 50 words that several documents share goes, also one under 400 bytes; clean texts stay
    assert {i for i, w in want.items() if w[1]} == {i for i in before if kinds.get(i) == "passage"}
    assert any(w[1] < 400 for w in want.values() if w[1])
    for r in kept["suffixes"]:
        assert len((r["text"] or "").encode()) == want[r["doc_id"]][0] - want[r["doc_id"]][1]
        assert suffixes.digest((r["text"] or "").encode()) == want[r["doc_id"]][3]
    leaks = {r["doc_id"] for r in kept["suffixes"] if any(i in (r["text"] or "") for _, i in items)}
    assert leaks and ids("decontamination") == ids("suffixes") - leaks
    assert ids("packing") == ids("decontamination")
    lengths = {}
    for r in kept["packing"]:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        assert lengths[r["doc_id"]] <= r["doc_tokens"]
    assert all(lengths[r["doc_id"]] == r["doc_tokens"] for r in kept["packing"])
    again = P.run(spark, "")
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    totals = lambda rows: {k: int(np.sum([r["length"] for r in rows if r["doc_id"] == k])) for k in {r["doc_id"] for r in rows}}
    got = again.collect()
    assert totals(got) == totals(kept["packing"]) and len(key(got)) >= len(lengths)


def test_stages_of_an_empty_table(spark, monkeypatch):
    docs, labels, items, _ = make(random.Random(1))
    tables = {"labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
              "benchmark": spark.createDataFrame(items, "item_id long, text string"),
              "documents": spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")}
    for m in (toxicity, decontam, P):
        monkeypatch.setattr(m, "table", lambda _, __, name: tables[name])
    assert P.run(spark, "").count() == 0
