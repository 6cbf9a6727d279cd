"""Session helpers.

Nothing here creates a global session: callers pass a ``SparkSession`` to every operator.
``build_session`` exists for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "lureline") -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling, no UI."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("LURELINE_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A folder already given to the session (``setCheckpointDir``, or ``spark.checkpoint.dir``
    which names the cluster's shared folder) is used as is. Where none is named, a local master
    gets a scratch folder of its own (driver and tasks share the machine); any other master is
    an error, so no job ever writes intermediate data to a machine-local folder of a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="lureline-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir()
