"""Session defaults and table access shared by every query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "parchmill", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/parchmill-warehouse")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, removed at exit.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="parchmill-")
    atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_owned: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one: all it writes between steps lies there, and it deletes it at its end."""
    path = f"{shared_folder(spark)}/parchmill-{spark.sparkContext.applicationId}"
    if path not in _owned:
        _owned.add(path)
        atexit.register(discard, spark)
    return path


def discard(spark: SparkSession) -> None:
    """Delete what this application wrote between steps. DataFrames that still read it must not be used afterwards.

    Runs by itself when the driver's process ends; a long-lived application calls it once its results are written.
    """
    try:
        path = f"{shared_folder(spark)}/parchmill-{spark.sparkContext.applicationId}"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        for path in _owned:
            if path.startswith("file://"):
                shutil.rmtree(path[len("file://") :], ignore_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    The files outlive lost executors, so nothing above them is computed twice.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python workers need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="parchmill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    archive = Path(folder, "parchmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
