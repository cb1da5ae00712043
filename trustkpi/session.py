"""Session settings and staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


class _Staged(threading.local):
    """Paths staged by this thread: queries built side by side don't delete each other's tables."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_staged = _Staged()


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trustkpi")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        # Without call-site capture, building large expressions is much faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back on a temporary folder, because there
    driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="trustkpi-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several later passes read the same result: lineage is cut, a
    lost executor costs nothing, later scans prune columns, and the file size
    gives the planner a real number for its broadcast decision.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_count() -> int:
    """Number of staged tables of this thread that exist, for ``drop_staged``."""
    return len(_staged.paths)


def drop_staged(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Delete the tables this thread staged since there were ``first``, but not the last ``keep``."""
    paths = _staged.paths
    end = max(first, len(paths) - keep)
    for path in paths[first:end]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del paths[first:end]


@contextmanager
def staged_for(spark: SparkSession):
    """Tables staged inside the block are deleted at its end.

    For jobs that write their result inside the block: a result that is only read
    later still needs them.
    """
    first = staged_count()
    try:
        yield
    finally:
        drop_staged(spark, first)
