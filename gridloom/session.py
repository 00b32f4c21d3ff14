"""Session settings and the shared folder for cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on; all can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Cell jobs are heavy per byte: keep tasks parallel even when shuffles are small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods beyond this size; Spark then runs the stage in smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Settings that only a new session can take. Call sites of column expressions are not recorded,
# since the plans here have thousands of them.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STARTUP_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: tasks may run where its folder is not on the path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL_FOLDERS[key]


_LOCAL_FOLDERS: dict[str, str] = {}


def owned_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder that is removed when the application ends."""
    path = f"{shared_folder(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    if not _OWNED:
        atexit.register(_remove_owned)
    _OWNED.append((spark, path))
    return path


def cut_lineage(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back, on request partitioned by some columns.

    Later plans start from a plain Parquet scan with known size, and a lost executor costs nothing. Folders made here
    belong to the application and are removed when it ends.
    """
    spark = df.sparkSession
    path = owned_folder(spark, label)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


_OWNED: list[tuple[SparkSession, str]] = []


def _remove_owned() -> None:
    """Best effort: a session that has already ended leaves its folders to the cluster's own clean-up."""
    for spark, path in _OWNED:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            return
