"""What a Spark session needs before it can run this package's Python functions on executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each Spark context, as they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return spark
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, f"{_ROOT.name}/{path.relative_to(_ROOT)}")
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    target.write_bytes(held.getvalue())
    context.addPyFile(str(target))
    context._graphloom_shipped = True
    return spark


def _filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir; a local one only where that is unset and no other machine is in use.

    All folders of an application lie in one of its own, which goes when the driver ends; see release() for an earlier end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/graphloom-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, own = _filesystem(spark, root)
        fs.mkdirs(own)
        fs.deleteOnExit(own)
        _roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def path_is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a folder does not exist or holds no file of data."""
    fs, own = _filesystem(spark, path)
    return not fs.exists(own) or not any(x.getPath().getName()[0] not in "._" for x in fs.listStatus(own))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of finished jobs only then (else every half hour, by spark.cleaner.periodicGC.interval)."""
    spark._jvm.System.gc()


def release(*written: DataFrame | None) -> None:
    """Deletes the tables behind results of materialise() that nothing reads any more, and shuffle files of finished jobs."""
    for df in written:
        path = getattr(df, "_graphloom_path", None)
        if path:
            fs, own = _filesystem(df.sparkSession, path)
            fs.delete(own, True)
            df._graphloom_path = None
    for df in written[:1]:
        if df is not None:
            free_shuffles(df.sparkSession)
