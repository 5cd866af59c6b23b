"""Session helpers.

On a cluster the caller owns the session; the library only reads
``spark.checkpoint.dir`` from it (the shared folder for materialised
intermediates). A cluster session without that folder gets an error; a local
one (tests, bench) a temporary folder, without a change to the session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a Spark user would pick for this workload: AQE for runtime
# re-planning (coalesce tiny shuffles, convert to broadcast joins once the
# real size of a side is known, split skewed join partitions).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_or_create_session(master: str | None = None, shuffle_partitions: int = 8,
                          app_name: str = "tierscope", extra: dict | None = None) -> SparkSession:
    """Local/test session; on a cluster use the session you already have."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TIERSCOPE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # Spark Connect: no SparkContext on the client
        return False


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates: the session's checkpoint
    folder (``spark.checkpoint.dir``). Without one, a local session gets a
    temporary folder of its own; anywhere else that would be a folder other
    machines can't see, so it is an error."""
    folder = None if _is_connect(spark) else spark.sparkContext.getCheckpointDir()
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tierscope-")
    return _LOCAL_SCRATCH[app]


def _is_connect(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext is None
    except Exception:
        return True
