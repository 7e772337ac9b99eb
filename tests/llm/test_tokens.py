from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from evalspark.llm import packing, tokenfile
from evalspark.llm.tokens import Encoder, default_tokenizer, load

TEXTS = [None, "", "a", "Hello world, it's  fine\n\n ok", "<|endoftext|>", "日本語 ก\U0001f600", "x" * 30_000, "the cat sat " * 5000]


def make(spark, extra=()):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "été", "don't", "12", "!?"]
    texts = TEXTS + [" ".join(rnd.choices(words, k=rnd.randint(1, 900))) for _ in range(120)] + ["same text again"] * 40
    rows = [(i, t, "n", 3) for i, t in enumerate(texts)] + [(5, "again the same id", "n", 1), (None, "no id", None, None)]
    rows += list(extra)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(5)


def reference(rows, end):
    tok = load(default_tokenizer())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], np.uint32) for _, t, *_ in rows]


def test_encoder_equals_the_library():
    rnd = random.Random(3)
    alphabet = [*"ab st'mdrevl  \n\t1!,.'é ß", "'s", "'re", "'ll ", " '", "  ", "　", "\x85", "\x1c", "\U0001f600", "ก", "²"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(8000)]
    enc = Encoder(default_tokenizer())
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert [x.tolist() for x in enc.encode(texts)] == want  # from the cache
    enc.clear()
    assert [x.tolist() for x in enc.encode([None, *texts[:50]])] == [[], *want[:50]]


@pytest.mark.parametrize("high", [1, 200, 70_000, 2 ** 25, 2 ** 32 - 1])
def test_codes_round_trip(high):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        ranks = rnd.integers(0, high, n, dtype=np.uint32)
        control, data = tokenfile.pack_codes(ranks)
        assert len(control) == -(-n // 4)
        assert np.array_equal(tokenfile.unpack_codes(control, data, n), ranks)


def test_token_file_round_trip(spark):
    rows, df = make(spark)
    want = reference(rows, 2)
    files = tokenfile.write(df, shard_tokens=20_000, block_tokens=3000)
    got = sorted(tokenfile.read(files).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    at, by_id = 0, {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        by_id.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    for (d, *_), ids in zip(rows, want, strict=True):
        by_id[d].remove(ids.astype("<u4").tobytes())
    vocab = sorted(files["vocab"].collect(), key=lambda r: r["rank"])
    n = np.bincount(np.concatenate(want))
    assert [(r["id"], r["n"]) for r in vocab] == sorted(((i, c) for i, c in enumerate(n.tolist()) if c), key=lambda x: (-x[1], x[0]))
    assert tokenfile.read(tokenfile.write(df.limit(0))).count() == 0


def test_packing_covers_every_id_once(spark):
    rows, df = make(spark)
    df = df.where("doc_id is null or doc_id <> 5")
    rows = [r for r in rows if r[0] != 5]
    want = {r[0]: ids for r, ids in zip(rows, reference(rows, 1), strict=True)}
    got = packing.pack(df, shard=32).collect()
    parts, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert np.array_equal(ids, want[r["doc_id"]][r["start"]:r["start"] + r["length"]])
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert parts.keys() == want.keys()
    for d, p in parts.items():
        at = 0
        for s, n in sorted(p):
            assert s == at
            at += n
        assert at == len(want[d])
    full = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        full += at == 2048
    assert len(sequences) - full <= df.rdd.getNumPartitions()
    assert packing.pack(df.limit(0)).count() == 0
    r = packing.pieces(packing.pack(df)).first()
    assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"]:r["start"] + r["length"]].astype("<u4").tobytes())


def test_index_equals_brute_force_bm25():
    rnd = np.random.default_rng(2)
    rests = [rnd.integers(0, 50, rnd.integers(1, 80)).astype(np.uint32) for _ in range(40)]
    index = packing.Index(rests)
    mean = np.mean([len(r) for r in rests])
    for i in range(40):
        want = np.zeros(40)
        for t in set(rests[i].tolist()):
            df = sum(t in r for r in rests)
            idf = np.log1p((40 - df + 0.5) / (df + 0.5))
            for j, r in enumerate(rests):
                tf = int((r == t).sum())
                want[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / mean))
        assert np.allclose(index.scores(i, 1000), want)


def test_default_scores_use_every_term_of_the_seed():
    rnd = np.random.default_rng(5)
    rests = [rnd.zipf(1.3, rnd.integers(100, 400)).clip(0, 3000).astype(np.uint32) for _ in range(60)]
    index = packing.Index(rests)
    sets = [set(r.tolist()) for r in rests]
    mean = np.mean([len(r) for r in rests])
    for i in range(60):
        assert len(sets[i]) > 24
        want = np.zeros(60)
        for t in sets[i]:
            df = sum(t in s for s in sets)
            idf = np.log1p((60 - df + 0.5) / (df + 0.5))
            for j, r in enumerate(rests):
                tf = int((r == t).sum())
                want[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / mean))
        assert np.allclose(index.scores(i), want)


def test_related_documents_meet_across_the_input(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    texts = [rnd.choices(words, k=120) for _ in range(96)]
    copies = [[rnd.choice(words) if rnd.random() < 0.05 else w for w in t] for t in texts]
    rows = [(i + 1000 * k, " ".join(t)) for k, part in enumerate((texts, copies)) for i, t in enumerate(part)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sequences = {}
    for r in packing.pack(df, shard=32).collect():
        sequences.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    assert len(sequences) == 192
    met = sum(bool(sequences[i] & sequences[i + 1000]) for i in range(96))
    assert met > 60  # consecutive shards of 32 rows hold no pair at all


def test_statistics_cover_all_rests(spark):
    rows, df = make(spark)
    ids = [x[len(x) - len(x) % 2048:] for x in reference(rows, 1)]
    ids = [x for x in ids if len(x)]
    cut = packing.encoded(df, default_tokenizer(), 2048, 1, "doc_id", "text")
    stats = packing.counted(cut.where("sequence_id is null"))
    want = np.zeros(len(stats.df), np.int64)
    for x in ids:
        want[np.unique(x)] += 1
    assert stats.n == len(ids) and stats.mean == np.mean([len(x) for x in ids])
    assert np.array_equal(stats.df, want)
    part = packing.Index(ids[:20], stats)
    norm = 1.2 * (0.25 + 0.75 * np.array([len(x) for x in ids[:20]]) / stats.mean)
    for i in range(20):
        s = np.zeros(20)
        for t in set(ids[i].tolist()):
            tf = np.array([(x == t).sum() for x in ids[:20]])
            s += np.log1p((stats.n - want[t] + 0.5) / (want[t] + 0.5)) * tf * 2.2 / (tf + norm)
        assert np.allclose(part.scores(i), s)
