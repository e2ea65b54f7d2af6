"""Session settings and the shared folder that intermediate tables are written to."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "credence") -> SparkSession:
    """A session for tests and the local bench; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir of the session.

    Only a local session without that setting (tests) gets a folder of its own; on a cluster a folder of
    the driver would not be seen by executors, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="credence-"))
    return (configured or context.getCheckpointDir()).rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one run below the shared folder."""
    return f"{shared_root(spark)}/credence/{name}-{uuid.uuid4().hex[:12]}"
