"""Sessions, tables, and tables of their own that cut a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugeworks")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; sf_dir may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine gets a temporary folder, which goes when the driver ends; on a cluster it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_ = context._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            folder = set_.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="gaugeworks-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            context.setCheckpointDir(f"file://{own}")
            folder = context._jsc.sc().getCheckpointDir().get()
        else:
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it has a short plan with known sizes, and survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """As stored, with the table's path, which dropped() takes."""
    path = f"{shared_dir(df.sparkSession)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_gaugeworks_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gaugeworks-")  # on the driver, which serves it as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(name := f"{folder}/{top.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(name)
    context._gaugeworks_shipped = True
