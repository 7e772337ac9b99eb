from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from evalspark.llm import toxicity as T

BAD = ["idiot", "scum", "moron", "pathetic"]


def corpus(rnd, n):
    clean = ["the", "river", "stone", "walked", "over", "hills", "morning", "garden", "light", "été", "weiß", "12", "3.5"]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(clean, k=rnd.randint(5, 200))
        toxic = rnd.random() < 0.3
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(BAD)
        docs.append((i, " ".join(w), "z"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def model_of(spark, texts):
    return T.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_language_model_counts_all_texts(spark):
    texts = ["Ab é, c", None, "", "ab\n\nab ab1"]
    total = np.zeros(T.LETTERS ** 4, np.int64)
    codes = [0, 0]
    for t in texts:
        for c in " " + (t or "").lower():
            x = T.code(c)
            if x or codes[-1]:
                codes.append(x)
    codes.append(0)
    # one batch, one text after the other, boundaries folded
    for q in zip(codes, codes[1:], codes[2:], codes[3:], strict=False):
        total[((q[0] * 28 + q[1]) * 28 + q[2]) * 28 + q[3]] += 1
    data = "".join(t or "" for t in texts).encode()
    off = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    assert np.array_equal(T.gram_counts(np.frombuffer(data, np.uint8), off), total)


def test_viterbi_is_the_best_path_of_the_lattice(spark):
    model = model_of(spark, ["the idiot and the scum of a moron met a loser so stupid and pathetic"] * 5)
    r = T.Restorer(model)

    def cost(letters):
        s, h = 0.0, (0, 0, 0)
        for x in letters + " ":
            d = T.code(x)
            if d or h[2]:
                s += float(model[((h[0] * 28 + h[1]) * 28 + h[2]) * 28 + d])
                h = (h[1], h[2], d)
        return s

    for text in ("1d10t", "m0oor0n", "$cum", "st!!upid", "s c u m", "l0s3r", "a i d"):
        paths = itertools.product(*r.lattice(text))
        best = max(sum(c for _, c in p) + cost("".join(x for x, _ in p)) for p in paths)
        got = r.decode(text)
        have = max(sum(c for _, c in p) + cost("".join(x for x, _ in p)) for p in itertools.product(*r.lattice(text))
                   if "".join(x for x, _ in p) == got)
        assert abs(best - have) < 1e-6
    assert "idiot" in r.word("1d10t") and r.word("sc|_|m") and "scum" in r.word("scuuuuum!!")
    assert "loser" in r.word("l0s3r") and r.word("st00pid") and "pathetic" in r.word("p@thetic")
    assert r.word("plain,") == ("plain",) and r.word("2024") == ("2024",) and r.word("!!") == ()
    assert "idiot" in r.words("what an I D I O T he is")


def test_nothing_hides_behind_length_digits_or_punctuation(spark):
    said = "the idiot and the scum of a moron met a loser so stupid and pathetic and worthless you are a worthless loser you idiot"
    r = T.Restorer(model_of(spark, [said] * 20))
    assert {"worthless", "pathetic", "loser"} <= set(r.word("y0u_4re_4_w0rthl3ss_p4th3tic_l0s3r"))
    assert "idiot" in r.word("1d107") and "idiot" in r.word("id!o+") and "idiot" in r.word("1d1o+!")
    for token in ("you,idiot", "you/idiot", "you-idiot", "you.idiot,loser", "(you_idiot)"):
        assert "idiot" in r.word(token), token
    assert "idiot" in r.word("i.d.i.o.t") and "scum" in r.word("s_c_u_m")
    long = "4nd_" * 3000 + "m0r0n" + "_4nd" * 3000
    assert "moron" in r.word(long)
    assert r.word("1,234.5") == ("1,234.5",) and r.word("well-known") == ("well-known", "well", "known")


def test_held_out_accuracy_obfuscation_and_edges(spark):
    rnd = random.Random(6)
    docs, labels = corpus(rnd, 900)
    extra = [(5000, None, "z"), (5001, "", "z"), (5002, "the river 1d10t walked over hills", "z"), (5003, "stone m o r o n hills", "z"),
             (5004, "garden " * 50_000, "z"), (None, "the scuuum river", "z"), (3, docs[3][1], "z")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (77_777, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = T.score(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r["doc_id"]: r for r in got}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(by[i]["predicted"] == truth[i] for i in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert by[5000]["predicted"] == by[5001]["predicted"] == by[5004]["predicted"] == 0
    assert by[5002]["predicted"] == by[5003]["predicted"] == by[None]["predicted"] == 1
    assert T.score(d.limit(0), lab).count() == 0
    assert all(r["predicted"] == 0 for r in T.score(d.limit(20), lab.limit(0)).collect())


def test_forms_of_a_word_meet_in_its_terms(spark):
    r = T.Restorer(model_of(spark, ["the worthless scum and a loser walked over hills"] * 30))
    for form in ("w0rthless", "WORTHLESS!!", "wooorthless", "worthlesss"):
        assert "~worthles" in {t for w in r.words(form) for t in T.terms(w)}, form
    for form in ("s-c-u-m", "s.c.u.m", "s c u m", "s   c  u m", "s_c_u_m", "$cuuum"):
        assert "scum" in r.words("the " + form + " walked"), form
