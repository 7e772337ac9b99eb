"""Session construction and cluster-facing settings.

Library operators never create a session themselves; they take DataFrames.
This module is for entry points (bench, tests, scripts) that need one.
"""
from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every plan in this library.
#  * AQE re-plans at stage boundaries: converts sort-merge joins to broadcast
#    joins only when the *measured* build side is under the threshold (this is
#    the size check behind every join we leave un-hinted), coalesces small
#    shuffle partitions and splits skewed ones.
#  * UTC session zone: naive timestamps mean UTC throughout the data model.
BASE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # static plans broadcast only below Spark's default 10 MB estimate; AQE may
    # switch to a broadcast join when the *measured* build side is under 64 MB
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # post-shuffle partitions are coalesced / split towards this size
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # a repeated key in a JSON object keeps its last value, as in the readers' formats
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "evalspark",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster leave ``master`` as None so spark-submit decides, and size
    ``shuffle_partitions`` to roughly input bytes / 128 MB.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 << 20, cores: int = 1) -> int:
    """Initial shuffle width for an input size: about one partition per
    ``target_bytes`` of shuffled data (never fewer than the cores), so each
    reduce task fits in executor memory; AQE then coalesces small ones and
    splits skewed ones. 100 TB at 256 MB gives ~400k; ~20-50k is typical once
    projections and partial aggregation have shrunk the shuffled bytes."""
    return max(cores, -(-int(input_bytes) // int(target_bytes)))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to a shared filesystem path. Only a
    local-mode session (tests) gets a private temporary folder when unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="evalspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint: survives executor loss, truncates the plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df, name: str):
    """Write ``df`` to a new Parquet folder of the shared checkpoint directory and read it back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: it does so once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
