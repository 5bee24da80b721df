"""Session building and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, AQE, dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.task.maxFailures": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Partitions, hours and dates are UTC whatever the caller's session says; executors get the package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return shipped(spark)


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers have this package from now on. Every operator that runs Python calls it."""
    _ship(spark.sparkContext.applicationId)
    return spark


@functools.cache
def _ship(application: str) -> None:
    """Sends this package to the Python workers, once for each application, as they may not have it on their path.

    The archive stands in the shared folder under a name that tells its content, and outlasts the application.
    """
    spark = SparkSession.getActiveSession()
    here = Path(__file__).resolve().parent
    if spark is None or not here.is_dir():  # already run from an archive
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(here.parent))), f.read_bytes())
    path = f"{shared_dir(spark)}/tidewell-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        hidden = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        try:
            out.write(bytearray(data.getvalue()))
        finally:
            out.close()
        fs.rename(hidden, p)
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may leave it unset; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.tidewell.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.tidewell.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@functools.cache
def _clear_at_exit(application: str) -> None:
    def clear() -> None:
        spark = SparkSession.getActiveSession()
        try:
            if spark and spark.sparkContext.applicationId == application:
                clear_scratch(spark)
        except Exception:  # noqa: BLE001 - the session is gone, and the folder's owner has to clear it
            pass

    atexit.register(clear)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, kept until the application ends."""
    shipped(spark)
    _clear_at_exit(spark.sparkContext.applicationId)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application put into the shared folder. Results read from there must have been consumed."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(_own(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
