"""Session set-up, shared working folder and size checks used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured bytes are at or below this.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

_local_dirs: dict[str, str] = {}
_written: list[str] = []


@atexit.register
def _clean() -> None:
    """Remove what this driver wrote to a folder of files; other file systems were told to when it was written."""
    for path in _written:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    for path in _local_dirs.values():
        shutil.rmtree(path, ignore_errors=True)


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (tests, one machine) a local folder is made and the setting is left alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lodestrata-")
    return "file://" + _local_dirs[app]


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system, whichever it is, remove a path when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and computes the plan once
    (``checkpoint()`` would compute it twice).
    """
    path = f"{shared_dir(df.sparkSession)}/lodestrata/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    _forget_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestrata_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that :func:`materialize` wrote."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._lodestrata_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_LIMIT_BYTES, inflation: int = 4) -> DataFrame:
    """Mark ``df`` for broadcast if the measured size of the materialized table it is (or is ``of``) allows.

    ``inflation`` is how much larger rows are in memory than on disk. Beyond the limit a shuffle join does.
    """
    return F.broadcast(df) if stored_bytes(of if of is not None else df) * inflation <= limit else df


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """Partition count that follows the row count, never below the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
