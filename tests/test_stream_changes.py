"""Streaming changelog of the (tag, model) aggregate against a recount of everything that arrived."""
import os
import random

from evalspark.streaming import ops as S

RUN = "prompt_id bigint, model string, score double, passed boolean, cost_usd double, latency_ms int, sign int"
TAG = "prompt_id bigint, tag string, classifier string, present boolean, `order` bigint"


class Feed:
    """Loads written to folders that one checkpoint streams from, and a recount of them."""

    def __init__(self, spark):
        self.spark, self.runs, self.given = spark, [], {}
        self.r, self.t, self.out, self.ckpt = (S.scratch(spark, f"t-chg-{x}") for x in ("runs", "tags", "out", "ckpt"))
        self.models = spark.createDataFrame([(m, 7.0, 4096) for m in ("a", "b", "hot")],
                                            "name string, size_params_b double, context_window int")

    def load(self, runs, tags):
        self.spark.createDataFrame(runs, RUN).write.mode("append").parquet(self.r)
        self.spark.createDataFrame(tags, TAG).write.mode("append").parquet(self.t)
        self.runs += [r for r in runs if r[0] is not None and r[1] is not None]
        for p, t, c, present, _ in sorted((t for t in tags if t[0] is not None and t[1] is not None), key=lambda x: (x[4], x[3])):
            (self.given.setdefault(p, set()).add if present else self.given.setdefault(p, set()).discard)((t, c))
        self.run()

    def run(self):
        S.stream_tag_changes(self.spark.readStream.schema(RUN).parquet(self.r),
                             self.spark.readStream.schema(TAG).parquet(self.t), self.out, self.ckpt)

    def now(self):
        return {(r.tag, r.model): (r.n_evals, r.n_passed, r.n_passed_known, r.avg_score, r.avg_cost_usd, r.avg_latency_ms)
                for r in S.tag_model_now(self.spark, self.out, self.models).collect()}

    def recount(self):
        groups = {}
        for r in self.runs:
            for t in {t for t, _ in self.given.get(r[0], ())}:
                groups.setdefault((t, r[1]), []).append(r)
        total = lambda rows, f: sum(f(x) * (x[6] or 1) for x in rows)
        mean = lambda rows, i: (total(rows, lambda x: x[i] or 0) / k if (k := total(rows, lambda x: x[i] is not None)) else None)
        return {g: (total(x, lambda _: 1), total(x, lambda y: bool(y[3])), total(x, lambda y: y[3] is not None), mean(x, 2) or 0.0,
                    mean(x, 4), mean(x, 5)) for g, x in groups.items() if total(x, lambda _: 1)}


def test_late_tags_withdrawals_and_replaced_scores(spark):
    f = Feed(spark)
    f.load([(1, "a", 0.5, True, 0.25, 100, 1), (1, "a", 0.25, None, None, None, None), (2, "b", None, False, 0.5, 10, 1),
            (None, "a", 1.0, True, 1.0, 1, 1), (3, None, 1.0, True, 1.0, 1, 1)],
           [(1, "x", "c1", True, 1), (1, "x", "c2", True, 1), (2, None, "c1", True, 1), (None, "x", "c1", True, 1)])
    assert f.now() == f.recount() and ("x", "a") in f.now() and len(f.now()) == 1
    f.load([(2, "a", 0.75, True, 0.125, 50, 1)], [(2, "y", "c1", True, 1), (1, "x", "c1", False, 2)])
    assert f.now() == f.recount() and set(f.now()) == {("x", "a"), ("y", "a"), ("y", "b")}   # c2 still gives x; y takes earlier runs
    f.load([(1, "a", 0.5, True, 0.25, 100, -1), (1, "a", 1.0, False, 0.25, 100, 1)], [(2, "y", "c1", False, 1), (2, "y", "c1", True, 2)])
    assert f.now() == f.recount() and f.now()["x", "a"][1] == 0     # a replaced score; the larger order of a batch holds
    f.load([], [(1, "x", "c2", False, 3), (2, "y", "c1", False, 3)])
    assert f.now() == f.recount() == {}


def test_random_loads_retries_and_compaction(spark):
    rnd, f = random.Random(5), Feed(spark)
    for step in range(4):
        runs = [(rnd.randrange(6), rnd.choice("ab"), rnd.randrange(16) / 16, rnd.choice([True, False, None]),
                 rnd.choice([None, rnd.randrange(64) / 64]), rnd.choice([None, rnd.randrange(1000)]), 1) for _ in range(40)]
        runs += [(0, "hot", 0.5, True, 0.25, 8, 1)] * 3000
        tags = [(rnd.randrange(6), rnd.choice("xyz"), rnd.choice(["c1", "c2"]), rnd.random() < 0.6, 100 * step + i) for i in range(25)]
        f.load(runs, tags)
        assert f.now() == f.recount()
        if step == 1:
            assert S.compact_changes(spark, f.out) == 1 == S.compact_changes(spark, f.out)
            assert f.now() == f.recount() and os.path.exists(f"{f.out}/delta=0")
        if step == 2:
            for name in ("2", ".2.crc"):                # as if the commit were lost after the sink wrote
                path = os.path.join(f.ckpt, "commits", name)
                if os.path.exists(path):
                    os.remove(path)
            f.run()
            assert f.now() == f.recount()
    assert S.compact_changes(spark, f.out) == 3
    assert f.now() == f.recount()
    assert sorted(os.listdir(f.out)) == ["base=1", "base=3", "delta=2", "delta=3"]


def test_condensed_rows_are_few(spark):
    import pandas as pd
    cols = ["prompt_id", "model", *S.PARTIALS, *S._TAG_ROW]
    pdf = pd.DataFrame([(1, "hot", *[1] * len(S.PARTIALS), None, None, None, None)] * 500
                       + [(1, None, *[0] * len(S.PARTIALS), "x", "c", True, 1)], columns=cols)
    runs, tags = S._condense(iter([pdf]))
    assert len(runs) == 1 and runs["_n"].iloc[0] == 500 and list(runs.columns) == cols and len(tags) == 1
