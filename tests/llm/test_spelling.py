from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from evalspark.llm import spelling as S

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FALL = {i: i + 32 for i in range(65, 91)}


def spelled(rows) -> Counter:
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                n[run] += 1
    return Counter({w: k for w, k in n.items() if k >= 2})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(n: Counter) -> dict:
    out, forms = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best
        out[w] = (n[w], len(near), forms.get(w), n[best] if w in forms else None)
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w] += (root,)
    return out


def got(df) -> dict:
    rows = df.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def made(seed, n=250):
    """Texts of words and their misspellings, some of them misspelt again, frequent ones far more frequent."""
    rnd = random.Random(seed)
    letters = "abcdeéÿ×"
    roots = ["".join(rnd.choices(letters, k=rnd.randint(7, 12))) for _ in range(12)]
    every = list(roots)
    for _ in range(160):
        w, i = rnd.choice(every), rnd.randrange(8)
        every.append(rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:]]))
    weight = [150 if i < 4 else 12 if i < 40 else 1 for i in range(len(every))]
    rows = [(rnd.choice([i, i, None]), rnd.choice([" ", "-", "1", "漢", "\n"]).join(
        x.upper() if rnd.random() < 0.2 else x for x in rnd.choices(every, weight, k=rnd.randint(0, 40)))) for i in range(n)]
    return rows + [(1, None), (2, ""), rows[3], rows[3]]


def test_words_of_a_document():
    rnd = random.Random(4)
    for i in range(400):
        text = "".join(rnd.choice("abcdefgABCDEFGÀÿ×÷ĀŁ漢😀 -1\x7f\x80\xbf") if rnd.random() < 0.2 else rnd.choice("abcdefgÀÉ") for _ in range(rnd.randint(0, 300)))
        want = Counter()
        for w, k in Counter(x.translate(FALL) for x in RUN.findall(text)).items():
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
            want[w] += k if len(w) >= 7 else 0
        assert {w.decode("latin-1"): n for w, n in S.spelled(i, text).items()} == {w: n for w, n in want.items() if n}


@pytest.mark.parametrize(("seed", "tile", "held"), [(1, 2048, 500_000), (2, 3, 20)])
def test_against_brute_force(spark, seed, tile, held):
    rows = made(seed)
    want = brute(spelled(rows))
    assert any(v[2] for v in want.values()) and any(v[4] not in (w, v[2]) for w, v in want.items())
    frame = spark.createDataFrame([(*r, "w", 5) for r in rows], SCHEMA + ", word string, n int").repartition(4)
    assert got(S.group(frame, tile=tile, held=held)) == want


def test_one_beginning_for_all_words(spark):
    """A key that holds most words: blocks of it meet in different tasks."""
    rnd = random.Random(9)
    rows = [(i, " ".join("sharedbeginning" + "".join(rnd.choices("ab", k=7)) for _ in range(60))) for i in range(30)]
    want = brute(spelled(rows))
    assert len(want) > 100
    assert got(S.group(spark.createDataFrame(rows, SCHEMA), tile=16)) == want


def test_long_words_and_ties(spark):
    long = "ab" * 150_000
    rows = [(5, f"{long} {long} {long}x {long}x x{long} {long[:70_000]}z{long[70_000:]} " * 2)]
    rows += [(6, "castles " * 2 + "pastles " * 30 + "bastles " * 30)]
    assert got(S.group(spark.createDataFrame(rows, SCHEMA))) == brute(spelled(rows))


def test_empty(spark):
    assert got(S.group(spark.createDataFrame([], SCHEMA))) == {}
    assert got(S.group(spark.createDataFrame([(1, None), (2, "short words here"), (None, "")], SCHEMA))) == {}
