"""Session helpers: settings for local runs, and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", name: str = "millwatch") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only in local mode, where it is unset, an own one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="millwatch-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives a lost executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    files, at = _files(spark, path)
    files.delete(at, True)


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the folders ``<prefix><n>`` in a folder, in order."""
    files, at = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, 0 if there is none."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needed where it is neither installed there nor given by ``--py-files``; a stream or an Arrow function started from any
    folder then finds it. The archive is a small file that Spark hands out itself.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millwatch-code-"), "millwatch.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
