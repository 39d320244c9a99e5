"""Session building and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "annalith", **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on: UTC and adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that later stages survive the loss of an
    executor and do not repeat the work.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset, on a local master, a temporary
    folder is set; on a cluster an unset folder is an error, because no other folder is known to be shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix=f"annalith-{os.getpid()}-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Have ``write`` write a folder beside ``path``, then put it in its place. Until then the old one stays; if the last step
    breaks off, the old one lies beside as ``path``.old."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    fs.delete(at(new), True)
    write(new)
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        if not fs.rename(at(path), at(old)):
            raise OSError(f"{path} can't be moved")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} can't be moved")
    fs.delete(at(old), True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster, once for each application.

    The archive lies with the driver alone, which serves it to every executor that starts, also to one that replaces
    another; no executor needs the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if not context.master.startswith("local[") and context.master != "local":
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="annalith-")
        context.addPyFile(shutil.make_archive(f"{folder}/annalith", "zip", root, "annalith"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
