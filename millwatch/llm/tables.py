"""What the operators share: reading their tables, shared-folder checkpoints, sizes."""

from __future__ import annotations

import ctypes
import os
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from millwatch.llm import words
from millwatch.session import new_folder

#: Words are runs of bytes outside these; the same set is used in SQL and in numpy.
SPACES = "\\x20\\x09-\\x0D"
#: Stands for a null id on the way through pandas, whose integers have no null.
NO_ID = -(1 << 63)
#: Rows up to this number may be broadcast (16 bytes each); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives a lost executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within, tables that are written hand at most so many rows to Python at once; afterwards the session's own number holds."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a frame, by Arrow: tuples would go through Python workers, kept beside those of the Arrow functions."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [[] for _ in kind]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind)], kind.names), kind)


def give_back() -> None:
    """In a Python worker: free memory goes back to the system. Workers live on from task to task and would keep their peaks."""
    words.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere memory goes back by itself
    if trim:
        trim(0)


def discard(df: DataFrame) -> None:
    """Remove the folder of a ``stored`` frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed_id(docs: DataFrame, key: str) -> Column:
    """The id as a long without nulls, named doc_id."""
    return F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc_id")


def unpacked(df: DataFrame) -> DataFrame:
    """df with the nulls of doc_id back in place."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def pieces(total: float, each: float, least: int = 1) -> int:
    """How many parts of a target size a total makes."""
    return max(least, int(-(-total // each)) if total else 1)


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key (null included) is in ids; docs is only shuffled if ids are too many to broadcast.

    ids must hold each key once. Columns are those of docs, whatever they are called.
    """
    wanted = ids.select(F.col(key).alias("_wanted")).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs[key].eqNullSafe(wanted["_wanted"]), "left_semi")
