from __future__ import annotations

import random
import re

from evalspark.llm import decontam as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = []
    for item, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        need = D.grams(w, k)
        for doc, t in docs:
            n = len(need & D.grams(words(t), k))
            if n >= 0.8 * len(need):
                out.append((doc, item, len(need), n))
    return out


def data():
    rnd = random.Random(8)
    vocab = [f"tok{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(i, text(rnd.choice([3, 4, 5, 6, 12, 37, 75, 130, 400]))) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (63, "unique")]
    items.append((64, items[5][1]))
    docs = [(0, None), (1, ""), (2, "Unique."), (3, text(40_000))]
    for i in range(4, 160):
        w = text(rnd.choice([0, 50, 600, 5000])).split(" ")
        for _ in range(rnd.randint(0, 3)):
            passage = items[rnd.randrange(60)][1].split(" ")
            if rnd.random() < 0.4:
                passage[rnd.randrange(len(passage))] = "changed"
            if rnd.random() < 0.3:
                half = len(passage) // 2
                w[0:0] = passage[:half + 4]
                passage = passage[half:]
            at = rnd.randint(0, len(w))
            w[at:at] = [p.upper() for p in passage] if rnd.random() < 0.3 else passage
        docs.append((i, (", " if i % 3 else " ").join(w)))
    docs.append((7, docs[9][1]))
    docs.append((None, items[10][1]))
    return docs, items


def test_containment_equals_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, item_id long, n_found string")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(map(key, brute(docs, items)))
    assert len(want) > 100
    assert sorted(map(key, D.contained(d, b).collect())) == want
    assert sorted(map(key, D.contained(d, b, item_chars=2000).collect())) == want
    assert D.contained(d.limit(0), b).count() == 0
    assert D.contained(d, b.limit(0)).count() == 0


def test_clean_keeps_rows_without_items(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(D, "table", lambda *_: spark.createDataFrame(items, "item_id long, text string"))
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in docs], "doc_id long, text string, source string")
    bad = {i for i, *_ in brute(list(enumerate(t for _, t in docs)), items)}
    got = D.clean(spark, d, "")
    assert got.columns == d.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(
        str((i, t, f"s{i}")) for n, (i, t) in enumerate(docs) if n not in bad)
