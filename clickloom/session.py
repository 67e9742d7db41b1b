"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on: adaptive re-planning decides on
# broadcasts by measured size and splits skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state on disk instead of the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"

_SHIPPED: set[str] = set()  # applications that have the package
_LOCAL_DIRS: dict[str, str] = {}  # local mode without the setting: one folder per application


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and ship the package."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers load functions by module name, and need not see the driver's path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="clickloom-"), package.name)
    sc.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    _SHIPPED.add(sc.applicationId)


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "clickloom") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    It is the one named in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="clickloom-")
    return _LOCAL_DIRS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/clickloom/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``, none when it is absent."""
    system, place = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return "_SUCCESS" in names_in(spark, path)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in its place in one step: readers see the whole of it or none."""
    system, place = _folder(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(draft, place):  # a replay writes the same note again
        system.delete(place, False)
        system.rename(draft, place)


def read_note(spark: SparkSession, path: str) -> str:
    system, place = _folder(spark, path)
    stream = system.open(place)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ours that nothing reads any more."""
    system, place = _folder(spark, path)
    system.delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def release(*stored: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` stored and nothing reads any more, and let go of shuffle files nobody refers to."""
    for df in stored:
        spark, kept = df.sparkSession, df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if kept.isDefined():
            discard(spark, kept.get())
    if stored:
        stored[0].sparkSession._jvm.System.gc()  # Spark drops the shuffle files of plans that are gone


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a stored table came back in fewer partitions than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
