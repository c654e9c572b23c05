"""Session defaults and the one place that cuts lineage."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cladeloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (AQE on, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and pins range-partition boundaries."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table before CPU-heavy work over `spark.cladeloom.spread` partitions, where that is set.

    For inputs with one large row group, which no scan can split; unset (as on a
    cluster, where tables have many splits) nothing is shuffled.
    """
    parts = df.sparkSession.conf.get("spark.cladeloom.spread", None)
    return df.repartition(int(parts)) if parts else df


#: Bytes of a batch for the Python workers unless the session sets them: 10,000 rows of packed chunks take gigabytes.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per context, so that sessions started from any folder can run it."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if not getattr(sc, "_cladeloom_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(prefix="spark-"), "cladeloom.zip")  # read by the driver's own file server
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(root, "cladeloom")):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(to)
        sc._cladeloom_shipped = True
    return spark


#: Rows of a shuffle for which a task is reckoned where their number is counted first.
ROWS_PER_TASK = 500_000


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of jobs that run within have at least one partition per `ROWS_PER_TASK` rows, so that the memory of a task
    does not grow with the table; adaptive execution still merges small ones. Materialize what is planned within."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // ROWS_PER_TASK))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
