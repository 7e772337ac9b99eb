from __future__ import annotations

import random
import re

from evalspark.llm import urls as U


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages():
    rnd = random.Random(7)
    out = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/a?b=c#d", "http://example.com?x=/en/", "http://a.net/es", "http://a.net/es/1",
           "http://net/fr/x", "http://notexample.com/en/1", "ftp://x.example.com/en/", "http://example.com/EN/1", "http://İx.net/es/#", "a://b://c/d",
           "http://h.org/" + "x" * 50_000, "http://h.org/a\nb", "http://.com/", "http://com./"]
    for _ in range(600):
        spam = rnd.random() < 0.3
        host = rnd.choice(["win.casino.org", "news.site.org", "site.org", "shop.org"]) if spam else rnd.choice(["news.site.org", "site.org", "shop.org"])
        seg = "deals" if spam else rnd.choice(["deals", "en", "de"])
        key = "?ref=1" if spam else rnd.choice(["", "?page=2"])
        out.append(f"http://{host}/{seg}/{rnd.randrange(10 ** 6)}{key}")
    return out


def bad(url):
    return bool(url) and "/deals/" in url and "ref=" in url


def test_parts_rules_and_mined_verdicts(spark):
    urls = pages()
    df = spark.createDataFrame([(i, u, "x", 1.5) for i, u in enumerate(urls)], "page_id long, url string, rule string, confidence double")
    rnd = random.Random(2)
    labels = spark.createDataFrame([(u, bad(u) if rnd.random() > 0.02 else None) for u in urls for _ in range(2)], "url string, bad boolean")
    got = {r["page_id"]: r for r in U.judge(df, labels, U.rule_table(spark, U.RULES)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i]["url_host"], got[i]["url_path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if bad(u) else "allow")), u
    # ref= alone implies the label: longer combinations are pruned
    assert {r["mined"] for r in got.values()} == {None, "key:ref"}


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations
    rnd = random.Random(3)
    rows = [(sorted(rnd.sample("abcdef", rnd.randint(1, 4))),) for _ in range(300)]
    rows = [(t, ("a" in t and "b" in t and rnd.random() < 0.95) or rnd.random() < 0.05) for (t,) in rows]
    got = {tuple(r["pattern"]): round(r["confidence"], 9) for r in U.mine(
        spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 6, 0.7).collect()}
    want = {}
    for n in range(1, 5):
        for c in combinations("abcdef", n):
            have = [b for t, b in rows if set(c) <= set(t)]
            if len(have) >= 6 and sum(have) / len(have) >= 0.7:
                want[c] = round(sum(have) / len(have), 9)
    want = {c: v for c, v in want.items() if not any(set(o) < set(c) and w >= v for o, w in want.items())}
    assert got == want and ("a", "b") in want


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, "http://a.org/")], "page_id long, url string")
    labels = spark.createDataFrame([], "url string, bad boolean")
    rules = U.rule_table(spark, U.RULES)
    got = U.judge(df, labels, rules).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "allow"), (1, "block"), (1, "block")]
    assert U.judge(df.limit(0), labels, rules).count() == 0
    plan = U.judge(df, labels, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
