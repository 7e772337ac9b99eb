from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import quality as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def prose(rnd, n, junk=False):
    words = ["river", "stone", "the", "of", "walked", "garden", "light", "over", "été", "a", "mountain", "und", "old"]
    out = []
    for i in range(n):
        w = rnd.choice(words) + str(rnd.randrange(500))
        out.append(w + ("&&&" if junk else "") + ("\n" if i % 12 == 11 else " "))
    return "".join(out)


def rows(rnd):
    out = []
    for i in range(400):
        junk = i % 10 == 0
        out.append((i, prose(rnd, rnd.randint(60, 900), junk), "en" if i % 3 else "de", "hot" if i % 4 else None, junk))
    texts = [None, "", "\t \n", "one two three", "a b c " * 300, "same line of words\n" * 40 + prose(rnd, 900), "x" * 100_000,
             prose(rnd, 60) + "\x1c\xa0 nbsp kept inside", "a\r\nb\r\na\r\n\nb", "<|>" + prose(rnd, 55), prose(rnd, 20_000)]
    out += [(1000 + i, t, None, f"s{i}", False) for i, t in enumerate(texts)]
    out += [out[1], (None, *out[2][1:])]
    return out


def test_statistics_and_verdicts(spark):
    data = rows(random.Random(9))
    df = spark.createDataFrame([(*r[:4], 5, "k") for r in data],
                               "doc_id long, text string, lang string, source string, n_words long, key string")
    got = Q.judge(df).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_, junk in data:
        for r in by[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), i
            if junk or r["base_failed"]:
                assert not r["kept"]
    clean = [r["kept"] for i, t, *_, junk in data if not junk and not brute(t)[5] for r in by[i]]
    assert sum(clean) / len(clean) > 0.99
    assert Q.judge(df.limit(0)).count() == 0
    assert Q.judge(df.where("doc_id = 0")).first()["kept"]  # a pool of one row is its own centre


def test_estimate_equals_numpy(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(600, 4)) @ np.diag([0.3, 1.0, 2.0, 4.0])
    x[:, 3] += x[:, 0]
    x[:90] += 30
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, x0 double, x1 double, x2 double, x3 double")
    est = Q.estimates(df).first()
    least = np.square(Q.LEAST)
    assert est["settled"]

    def raised(cov):
        low = np.zeros((4, 4))
        for j in range(4):
            for i in range(j, 4):
                v = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, least[i])) if i == j else v / low[j, j]
        return low @ low.T

    def far(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    med = np.median(x, axis=0)
    mean, cov = med, np.diag((1.4826 * np.median(abs(x - med), axis=0)) ** 2)
    for _ in range(20):
        near = x[np.argsort(far(mean, cov))[:450]]
        mean, cov = near.mean(0), raised(np.cov(near.T, bias=True))
    near = x[far(mean, cov * Q.CONSISTENT) <= Q.WEIGHTED]
    mean, cov = near.mean(0), raised(np.cov(near.T, bias=True))
    assert [est[f"m{i}"] for i in range(4)] == pytest.approx(mean.tolist(), abs=0.05)
    low = np.array([[est[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert np.allclose(low @ low.T, cov, rtol=0.1, atol=0.1)
    got = df.crossJoin(spark.createDataFrame([est]).drop("key")).select(Q.distance().alias("d")).toPandas()["d"]
    assert np.allclose(np.sort(got), np.sort(far(np.array([est[f"m{i}"] for i in range(4)]), low @ low.T)))
    assert (got > Q.CUTOFF).sum() >= 90


def test_one_bad_statistic_rejects(spark):
    """84 of 184 words repeated: the base rules let it pass, its distance from 200 clean documents does not."""
    rnd = random.Random(2)
    data = [(i, prose(rnd, 184), "en", "s") for i in range(200)]
    data.append((900, prose(rnd, 100) + " ".join(["one two three four five six seven"] * 12), "en", "s"))
    rows = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert (rows[900]["n_words"], rows[900]["n_repeat_words"], rows[900]["base_failed"], rows[900]["kept"]) == (184, 84, False, False)
    assert all(r["kept"] and r["settled"] for i, r in rows.items() if i < 200)


def test_an_unsettled_estimate_says_so(spark):
    rnd = np.random.default_rng(8)
    x = np.r_[rnd.normal(size=(300, 4)), rnd.normal(size=(280, 4)) * 3 + 4]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, x0 double, x1 double, x2 double, x3 double")
    assert not Q.estimates(df, steps=1).first()["settled"] and Q.estimates(df).first()["settled"]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, prose(random.Random(1), 80), "en", "a")], "doc_id long, text string, lang string, source string")
    plan = Q.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
