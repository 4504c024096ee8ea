"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ballast", cores: str = "8") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BALLAST_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only in local mode a private folder is made where the session names none; executors of
    a cluster could not read each other's files there, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def pinned(frame: DataFrame) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back.

    A lost executor then costs a read and never a second, different computation.
    Unlike a checkpoint the table is columnar, so later reads prune columns, and
    its size is known, so joins are planned on real numbers.
    """
    path = scratch_path(frame.sparkSession, "pinned")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for stream state and written tables.

    Tables built on it are read lazily, so it stays until `release`, or the driver's end.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_release_active)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the scratch tables that this driver has written."""
    context = spark.sparkContext
    configuration = context._jsc.hadoopConfiguration()
    while _SCRATCH:
        place = context._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        place.getFileSystem(configuration).delete(place, True)


def _release_active() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows to all cores, where `frame` is a plain scan of fewer splits than there are cores.

    A file of one row group is one task, whatever is done to its rows. For per-row work that costs
    more than moving the projected row once. Larger scans, and anything already dealt, stay as they are.
    """
    wanted = frame.sparkSession.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Join" in plan or frame.rdd.getNumPartitions() >= wanted:
        return frame
    return frame.repartition(2 * wanted)


def mapped_arrow(frame: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship_package(frame.sparkSession)
    return frame.mapInArrow(work, schema)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_ballast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ballast.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    target.write(full, os.path.join("ballast", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._ballast_shipped = True
