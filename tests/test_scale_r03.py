"""Steps that grew faster than their tables: what they store, deal and repeat."""
import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from evalspark.plans import fixtures as FX


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Orders and line items of their own: a key that comes twice, an order twice, a line without its order."""
    d = str(tmp_path_factory.mktemp("star"))
    day = dt.datetime(1995, 1, 2)
    orders = [(k, 7, "FOP"[k % 3], 1.0, day, "1-URGENT") for k in range(40)] + [(5, 7, "F", 1.0, day, "2-HIGH")]
    lines = [(k, 1, k % 4, n, 2.0, 1000.0 * n, 0.01 * n, 0.0 if n == 2 else 0.02, "N" if n == 1 else "A", "FO"[k % 2], day)
             for k in range(44) for n in (1, 2, 3)]
    lines.append((*lines[0][:5], 1.0, *lines[0][6:]))
    for name, rows, schema in (
            ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
            ("supplier", [(k, k % 2) for k in range(4)], "s_suppkey bigint, s_nationkey bigint"),
            ("nation", [(0, "PERU"), (1, "CHINA")], "n_nationkey bigint, n_name string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_f2_stores_lines_once_in_a_file_a_bucket(spark, star):
    f = FX.F2(spark, star)
    root = f"{spark.conf.get('spark.checkpoint.dir')}/f2-{FX.materialize_f2(spark, star)}"
    assert not {"runs", "evaluations"} & set(os.listdir(root))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < len(glob.glob(f"{root}/lines/part-*")) <= n
    runs = {r.run_id: r for r in f.runs.collect()}
    assert len(runs) == 132 == f.evaluations.count() and runs["0-1-0-1"].cost_usd == 1 / 1048576
    plan = FX.f2_lines(spark, star)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "HashAggregate" not in plan[plan.index("Exchange "):]


def test_f2_store_hashes_as_a_join_with_hashed_prompts(spark, star):
    from evalspark.plans.q_store import f2_store
    f = FX.F2(spark, star)
    for source in (None, "orders-F"):
        some = (f.prompts if source is None else f.prompts.filter(F.col("source") == source)).select(
            "prompt_id", F.sha2(F.col("prompt_id").cast("string"), 256).alias("h"))
        got = f2_store(spark, star, source)
        want = f.runs.join(some, "prompt_id").select("run_id", "h")
        rows = lambda x: sorted(map(tuple, x.collect()))
        assert rows(got["runs"].select("run_id", "prompt_id")) == rows(want)
        assert rows(got["prompt_tags"].select("prompt_id", "tag")) == rows(f.prompt_tags.join(some, "prompt_id").select("h", "tag"))
        kept = {r.run_id for r in want.collect()}
        assert got["evaluations"].count() == (132 if source is None else len(kept))


def test_export_compressed_on_request_reads_back_the_same(spark, star, tmp_path):
    from evalspark.plans.q_store import f2_store
    from evalspark.sources import snapshot as SN
    t = f2_store(spark, star)
    a, b = (SN.export_snapshot(t, f"{tmp_path}/{c}", compression=c) for c in ("none", "gzip"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    size = lambda c: sum(map(os.path.getsize, glob.glob(f"{tmp_path}/{c}/runs/part-*")))
    assert size("gzip") < size("none") / 2 and SN.verify_snapshot(spark, f"{tmp_path}/gzip").filter("not ok").count() == 0


def test_prompt_texts_are_dealt_and_scored_once(spark, tmp_path):
    from evalspark.plans.q_classify import heur
    rows = [(k, f"steel plan {k}", "Brand#1", "SMALL TIN", k % 50) for k in range(64)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    prompts = FX.f4_prompts(spark, str(tmp_path))
    assert prompts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and prompts.count() == 64
    plan = heur(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("population") == 1


def test_tag_changes_cost_no_call_a_prompt_and_fold_what_they_keep(spark, monkeypatch):
    from evalspark.streaming import ops as S
    from test_stream_changes import Feed
    monkeypatch.setattr(S, "KEPT_FOLDERS", 1)
    f = Feed(spark)
    for step in range(4):
        f.load([(p, "ab"[p % 2], 0.5, p % 3 == 0, 0.25, 8, 1) for p in range(5)],
               [(p, "xyz"[step % 3], "c", step != 3, step) for p in range(5)])
        assert f.now() == f.recount()
    assert sorted(os.listdir(f"{f.ckpt}/kept/runs")) == ["batch=3", "fold=2"]
    assert not os.path.exists(f"{f.ckpt}/state")
