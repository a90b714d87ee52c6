"""Session defaults and the shared folder for written tables.

Nothing here is needed on a configured cluster: the cluster's own settings win.
Local runs (tests, bench) get a session tuned for ``local[N]`` and a scratch
checkpoint folder, set only when the session names none.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied by ``local_session`` only. Cluster jobs keep their own.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written tables and checkpoints.

    Read from ``spark.checkpoint.dir``; only when the session has none (local
    tests) a scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    ckpt = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current:
        if not ckpt.isDefined():
            spark.sparkContext.setCheckpointDir(current)  # once per context (it makes a sub-folder)
        return current.rstrip("/")
    # Unset (bare local runs): a scratch folder becomes the context's checkpoint folder, once.
    if not ckpt.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-ckpt-"))
        ckpt = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(ckpt.get()).rstrip("/")


def sf_dir_default() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
