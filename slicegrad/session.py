"""Session settings the jobs rely on: checkpoint folder, size bounds and loop settings."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its row count times its row width is known to stay below this.
BROADCAST_BYTES = 16 * 1024 * 1024
#: What a row takes besides its fields: its own header, and its place in a hash table, which doubles as it grows.
BROADCAST_ROW = 80


def build_session(app_name: str = "slicegrad", master: str | None = None, **conf) -> SparkSession:
    """Create a session with the settings the package expects; extra keywords use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where the session names none.

    The cluster names the folder in ``spark.checkpoint.dir``. A machine-local folder is made up only for
    a local master, because executors on other machines could not read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="slicegrad-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, next to the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table this package wrote, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``, which may be a file, a folder or a pattern."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(target) or [])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back.

    Unlike a checkpoint, the table can be read column by column.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(rows: int, columns: int) -> bool:
    """True when ``rows`` rows of ``columns`` eight-byte fields stay below the broadcast bound as a hash table."""
    return rows * (columns * 8 + BROADCAST_ROW) <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Broadcast ``df`` if its known size is small enough; otherwise let Spark shuffle it."""
    return F.broadcast(df) if fits_broadcast(rows, columns) else df


@contextmanager
def loop_settings(spark: SparkSession, shuffle_partitions: int):
    """Settings for short iterative jobs, restored afterwards.

    An iteration's sizes are known beforehand, so re-planning at run time only adds latency, and it could
    merge partitions of the model and so break the partitioning it shares with the data. For the same reason nothing is
    broadcast by Spark's own estimate. Joins on several
    columns may use a partitioning by one of them, the feature; bucketed tables are read by bucket, also to write others.
    """
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
