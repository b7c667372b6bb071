"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "courtloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster `master` and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the workers as an archive, once for each context, so that grouped Python jobs find it whatever
    folder and path they start in."""
    context = spark.sparkContext
    if getattr(context, "_courtloom_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="courtloom-archive-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "courtloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.join("courtloom", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._courtloom_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local session may do without, and gets a
    temporary one; elsewhere a folder of the driver's machine would hold a part of the data, so that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return tempfile.mkdtemp(prefix="courtloom-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's shared folder, used between rounds of iterative jobs."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/ckpt")
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, in the shared folder."""
    return f"{shared_folder(spark)}/courtloom-{name}-{uuid.uuid4().hex}"
