"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset, so cluster values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every job relies on.  UTC keeps date/hour derivation identical on
# every executor; AQE coalesces small shuffles, splits skewed join partitions
# and switches to broadcast only after measuring the real size of a side.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # let HotSpot compile the large generated methods of wide projections
    # (otherwise methods over 8 KB of bytecode stay interpreted)
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    # checkpoint files of unreferenced datasets are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "demandlake") -> SparkSession:
    """A running session is returned as it is.  Otherwise one is built whose
    settings are the platform's, with the defaults above only where unset."""
    if SparkContext._active_spark_context is not None:
        return SparkSession.builder.getOrCreate()
    given = SparkConf()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    wanted = dict(DEFAULT_CONF)
    if memory := os.environ.get("DEMANDLAKE_DRIVER_MEMORY", "16g" if str(master).startswith("local") else ""):
        wanted["spark.driver.memory"] = memory
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in wanted.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, own: str | None = None) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, else
    the one registered with the context, else ``own`` (which is registered).

    A plain ``local[...]`` session, where driver and executors are one
    process, gets a scratch folder when nothing is set.  Anywhere else a
    missing setting is an error: executors do not share machine-local files.
    """
    sc = spark.sparkContext
    registered = sc._jsc.sc().getCheckpointDir()
    current = sc.getConf().get("spark.checkpoint.dir", None) or (registered.get() if registered.isDefined() else own)
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="demandlake-ckpt-")
    if not registered.isDefined():
        sc.setCheckpointDir(current)
    return current


def stage_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a materialised stage."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{name}"
