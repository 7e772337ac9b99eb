"""Tables as one file and as a folder of files, read as streams."""
import shutil

from pyspark.sql import functions as F

from evalspark.plans.q_stream import q_stream_ingest
from evalspark.streaming import ops as S

DOCS = [(0, "eins zwei", "de", "web"), (1, "one two", "en", "web"), (2, " one  two", "en", "wiki"), (3, "three", "en", "web"),
        (4, "eins zwei", "en", "web"), (5, None, "en", "web"), (None, "four", None, None)]


def test_a_folder_of_files_streams_like_one_file(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    (tmp_path / "one").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "file"))
    shutil.copy(next((tmp_path / "file").glob("part-*.parquet")), tmp_path / "one" / "documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    for layout in ("one", "many"):
        d, got = str(tmp_path / layout), S.scratch(spark, "t-layout")
        S.run_available_now(S.source_table(spark, d, "documents"), lambda b, n, to=got: b.write.mode("append").parquet(to), S.scratch(spark, "ckpt"))
        rows = spark.read.parquet(got)
        assert sorted(map(str, rows.collect())) == sorted(map(str, docs.select(*rows.columns).collect())), layout
        want = docs.filter("text in ('one two', 'three', 'four')").select(F.sha2("text", 256).alias("h"))
        assert sorted(r.content_hash for r in q_stream_ingest(spark, d).collect()) == sorted(r.h for r in want.collect()), layout
