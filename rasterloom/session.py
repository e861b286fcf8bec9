"""Session helpers shared by the entry module, the bench and the tests."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(name: str = "rasterloom", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound Arrow batches.

    On a cluster the package need not be installed on the workers: Python tasks
    import it from the archive that Spark distributes. Batches are bounded by bytes, as
    rows of long texts make batches of many rows too large for a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom_pkg.zip")
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Only where the session has none and all of Spark runs in one process, as in tests, a
    new one is set; elsewhere a session without one raises.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_CLEARED: set[str] = set()


def delete(spark: SparkSession, at: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def place(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. All places of an application go when it ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tables/{app}"
    if app not in _CLEARED:
        _CLEARED.add(app)

        def clear() -> None:
            with contextlib.suppress(Exception):  # Spark may be gone by then
                delete(spark, root)

        atexit.register(clear)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: what is read more than once isn't computed again, and its lineage ends."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
