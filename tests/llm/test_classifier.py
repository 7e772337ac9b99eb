from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from evalspark.llm import classifier as C

SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def good(rnd):
    return " ".join(rnd.choice(["Alpha", "beta,", "gamma", "delta.", "river", "stone", "under", "light"]) + rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 200)))


def junk(rnd):
    return " ".join(rnd.choice(["BUY", "NOW", "$$$", "###"]) + "!" for _ in range(rnd.randint(5, 200)))


def made(n=300, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, (junk if bad else good)(rnd), rnd.choice(["en", None]), "s"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def fold(i) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_scores_are_those_of_the_densities(spark):
    docs, labels = made()
    got = {r["doc_id"]: r for r in C.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    x = np.array([C.measure(d[1]) for d in docs])
    y = np.array([label[1] for label in labels])
    learn = np.array([not fold(d[0]) for d in docs])
    own = [np.cov(x[learn & (y == k)].T, bias=True) for k in (0, 1)]
    n = [int((learn & (y == k)).sum()) for k in (0, 1)]
    shared = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for k in (0, 1):
        c = (1 - C.POOLED) * own[k] + C.POOLED * shared
        c = (1 - C.ROUND) * c + C.ROUND * max(np.trace(c) / C.D, 1e-6) * np.eye(C.D)
        d = x - x[learn & (y == k)].mean(0)
        logs.append(-0.5 * (np.einsum("ij,ij->i", d @ np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    z = logs[1] - logs[0] + np.log((n[1] + 1) / (n[0] + 1))
    want = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for d, w in zip(docs, want, strict=True):
        r = got[d[0]]
        assert r["score"] == pytest.approx(w, abs=1e-6) and r["held_out"] == fold(d[0])
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_nothing_is_learned_from_the_held_out_fold(spark):
    docs, labels = made()
    turned = [(i, 1 - q if fold(i) else q, 1) for i, q, _ in labels]
    one, two = (sorted((r["doc_id"], round(r["score"], 9)) for r in C.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(x, LABELS)).collect())
                for x in (labels, turned))
    assert one == two


def test_held_out_accuracy_on_the_given_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = C.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) >= 0.95
    assert C.score(docs, labels).count() == docs.count()


def test_odd_rows(spark):
    docs, labels = made(80)
    docs += [(900, None, None, None), (901, "", "", ""), (902, " \n\t", "en", "s"), (903, "word " * 400_000, "en", "s"), (None, "Alpha beta.", "en", "s"), docs[1], docs[1]]
    labels += [(None, 1, 0), (5, 7, 0), (6, None, 0), (7, 0, 0), (99_999, 0, 0)]
    frame = spark.createDataFrame([(*d, 1.0, 2) for d in docs], SCHEMA + ", score double, x int")
    rows = C.score(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(by[docs[1][0]]) == 3 and len(set(by[docs[1][0]])) == 1
    assert by[900] == by[901] == by[902]
    assert next(r for r in rows if r["doc_id"] is None)["held_out"]


def test_empty_tables_and_labels_of_one_kind(spark):
    docs, labels = made(40)
    frame = spark.createDataFrame(docs, SCHEMA)
    assert C.score(frame.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
    assert {r["score"] for r in C.score(frame, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    ones = [x for x in labels if x[1] == 1]
    n = sum(not fold(x[0]) for x in ones)
    for r in C.score(frame, spark.createDataFrame(ones, LABELS)).collect():
        assert r["score"] == pytest.approx((n + 1) / (n + 2)) and r["predicted"] == 1


def test_phrases_count_exact():
    rnd = random.Random(3)
    for _ in range(50):
        w = rnd.choices("abcd", k=rnd.randint(0, 60))
        want = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        assert C._phrases(w) == (len(want), len(set(want)))
