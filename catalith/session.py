"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Bytes per task up to which :func:`spread` moves rows.
SMALL = 32 << 20


def session(master: str = "local[*]", app: str = "catalith", **conf: str) -> SparkSession:
    """A session with the defaults of this library; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local folder only where that setting
    is absent, and then only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(scratch, "own", None)
    if own is None:
        own = scratch.own = tempfile.mkdtemp(prefix="catalith-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


def stash(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below :func:`scratch` and read it back.

    Unlike a cached or locally checkpointed plan, the written table survives the loss of any executor, and it
    is columnar and compressed, so it is also smaller on disk. It is removed when the application ends, if not before.
    """
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files of a table that :func:`stash` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_at_end(spark: SparkSession, folder: str) -> None:
    """Remove a folder when the application's file system is closed, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder and all below it, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(ship, "application", None) == context.applicationId:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(home)
    folder = tempfile.mkdtemp(prefix=f"{name}-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, home)))
    context.addPyFile(f"{folder}/{name}.zip")
    ship.application = context.applicationId


def spread(df: DataFrame) -> DataFrame:
    """``df`` for steps whose time goes into Python: a small table that is read in fewer splits than the cluster runs tasks, and by the optimizer's
    estimate is below :data:`SMALL` bytes for each, is spread over them. A larger table is returned as it is, whatever its splits, and never shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL * wanted or df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)
