from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from evalspark.llm import divergence as D

SCHEMA = "doc_id long, lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text: str) -> list[str]:
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text)]


def brute(rows, least: int, top: int) -> list[tuple]:
    count, held, groups = Counter(), Counter(), set()
    for lang, source, text in ((r[1] or "", r[2] or "", r[3] or "") for r in rows):
        groups.add((lang, source))
        words = lowered(text)
        count.update((lang, source, w) for w in words)
        held.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        own = {s: {w: count[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(own[s][w] for s in sources) for w in kept}

        def p(n):
            total = sum(n.values())
            return {w: 1 + D.SCALE * (k + D.PRIOR) // (total + D.PRIOR * len(kept)) for w, k in n.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        q, ps = p(whole), {s: p(own[s]) for s in sources}
        for s in sources:
            apart = [(o, sum(f(ps[s][w], ps[o][w]) for w in kept)) for o in sources if o != s]
            over = [(w, f(ps[s][w], q[w])) for w in kept if own[s][w] and ps[s][w] > q[w]]
            for part, items, most in (("pair", apart, len(apart)), ("term", over, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_terms_are_those_of_the_pattern():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice("aZzÀÿ×ßŁ漢😀 \x00\x1f\n\x0b\x85\xa0-'@[`{\x7f09_É") for _ in range(rnd.randint(0, 40)))
        assert [t.decode() for t in D.terms(text.encode())] == lowered(text)


@pytest.mark.parametrize(("seed", "held"), [(1, 400_000), (2, 40)])
def test_against_brute_force(spark, seed, held):
    rnd = random.Random(seed)
    vocab = ["Das", "das", "été", "ÉTÉ", "x1y", "漢字", "don't", "a-b", "Zug", "zug", "q", "r"]
    rows = [(rnd.choice([1, 2, None, i]), rnd.choice(["de", "fr", None]), rnd.choice(["s1", "s1", "s1", "s2", "s3", "", None]),
             " ".join(rnd.choices(vocab, k=rnd.randint(0, 12)))) for i in range(150)]
    rows += [(1, "de", "quiet", None), (1, "de", "quiet", "12 34"), (1, "lonely", "s1", "once"), (1, "lonely", "s2", "twice")] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(D.audit(docs, least=6, top=4, held=held)) == brute(rows, 6, 4)


def test_long_text_ties_and_clashing_columns(spark):
    rows = [(i, "en", f"s{i % 2}", "alpha beta " * 3) for i in range(12)] + [(99, "en", "s2", "gamma " * 200_000 + "beta")]
    docs = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], SCHEMA + ", n long, term string, p0 long")
    assert got(D.audit(docs)) == brute(rows, 10, 10)


def test_empty(spark):
    assert got(D.audit(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, None, None, None), (2, None, "s", "")]
    assert got(D.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 10, 10) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_counts_too_large_for_products_of_longs(spark):
    one = spark.createDataFrame([(10 ** 15, 10 ** 16, 3)], "n long, total long, v long")
    assert one.select(D._p("n", "total")).first()[0] == 1 + D.SCALE * (10 ** 15 + 2) // (10 ** 16 + 6)
