"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every job here wants. Each is set only where neither the cluster's own
# configuration nor a running session has it.
PROGRESS = "spark.ui.showConsoleProgress"  # PySpark itself sets it, so it counts as unset
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    PROGRESS: "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove checkpoint files of intermediates once they are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "clientele", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(extra or {})
    if shuffle_partitions:
        conf.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if SparkSession.getActiveSession() is None:
        launch = SparkConf().setAll(conf.items())  # such as the driver's memory, needed when its JVM starts
        SparkContext._ensure_initialized(conf=launch)
        given = SparkConf()  # now with spark-defaults and what spark-submit was given
        conf = {**{k: v for k, v in DEFAULT_CONF.items() if k == PROGRESS or not given.contains(k)}, **conf}
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared filesystem and is used as is.
    Only when it is unset (tests, a laptop) is a fresh local folder made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (a machine-local folder "
                               "is not visible to the executors)")
        conf_dir = tempfile.mkdtemp(prefix="clientele-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
