"""SparkSession helpers.

Cluster jobs read their settings (shuffle partitions, checkpoint dir) from the
session they are given; :func:`local_session` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "logvigil") -> SparkSession:
    """A local session configured like the cluster profile (AQE, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOGVIGIL_DRIVER_MEM", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name a shared folder; unset, it is an error
    there.  On a local master (tests) one is created, under ``fallback`` or a
    fresh temporary folder.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None)
    if not current:
        if not fallback and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = fallback or tempfile.mkdtemp(prefix="logvigil-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    spark.sparkContext.setCheckpointDir(current)
    return current
