"""Session settings the operators rely on, applied without touching what the cluster decides."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# For whoever creates the session.  The first stops PySpark from walking the Python stack for
# every column expression (a static setting): a whole scan has thousands of them.
BUILD_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("velaria")
    settings = BUILD_SETTINGS | {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
    }
    for name, value in (settings | extra).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Send this package to the Python workers, once per application.

    Spark copies the archive to every executor, also to those that join later.
    """
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="velaria-")) / "velaria.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings only: timestamps in UTC, plans revised with what the stages measured."""
    ship(spark.sparkContext)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="velaria-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the checkpoint folder; plans over it start from there.

    A scan is a large expression: a plan that reads it several times, or filters on its result,
    would carry and run it several times.  The folder is the cluster's (`spark.checkpoint.dir`),
    so a lost executor loses nothing; only a session without one, as in tests, gets a local one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lost executors lose nothing, readers prune columns."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
