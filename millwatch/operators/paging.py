"""Ordered pages. The order given must end in a unique column."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page_offset(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the order. Deep pages cost their depth; see ``page_after``."""
    return df.orderBy(*order).offset(skip).limit(limit)


def page_after(df: DataFrame, column: str, last, limit: int = 100, descending: bool = False) -> DataFrame:
    """The page that follows the row whose unique ``column`` was ``last``; the cost does not grow with depth."""
    key = F.col(column)
    if last is not None:
        df = df.filter(key < last if descending else key > last)
    return df.orderBy(key.desc() if descending else key.asc()).limit(limit)


def page_after_pair(df: DataFrame, time: str, row_id: str, last_time, last_id, limit: int = 100) -> DataFrame:
    """The next page of a newest-first list, after the row with this time and id."""
    later = (F.col(time) < last_time) | ((F.col(time) == last_time) & (F.col(row_id) < last_id))
    return df.filter(later).orderBy(F.col(time).desc(), F.col(row_id).desc()).limit(limit)


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """The rows of one page; and one row with total, page, size and number of pages (0 when the size is 0), which is
    there on an empty page too."""
    pages = F.ceil(F.col("total") / F.lit(float(size))) if size else F.lit(0).cast("bigint")
    summary = df.agg(F.count("*").alias("total")).withColumns({"page": F.lit(page), "size": F.lit(size), "pages": pages})
    return page_offset(df, order, (page - 1) * size, size), summary


#: Rows of a folder of an index, at least: one task writes it, and the driver gets a sample and a count of it.
FOLDER_ROWS = 1_000_000
#: Bits of monotonically_increasing_id that hold a row's place in its partition.
PLACE_BITS = 33


def index_pages(df: DataFrame, time: str, row_id: str, path: str, rows: int = 1_000_000) -> None:
    """Write a newest-first list in slots of ``rows`` rows, for ``indexed_page``.

    Folders of about FOLDER_ROWS rows (``rows``, if that is more) hold the slots in order, so that tasks, files and counts grow
    with the list over FOLDER_ROWS, however small the slots are.
    """
    spark = df.sparkSession
    total = df.count()
    parts = max(1, -(-total // max(rows, FOLDER_ROWS)))
    order, at = [F.col(time).desc(), F.col(row_id).desc()], F.col("_at")
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = ranged.withColumns({"range": F.shiftright(at, PLACE_BITS).cast("int"), "_slot": F.floor(place / F.lit(rows)).cast("long")}).drop("_at")
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    if total:
        counts = spark.read.parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    else:
        counts = spark.createDataFrame([], "range int, n long")
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    about = "shape string, time string, row_id string, slot long"
    spark.createDataFrame([(df.schema.json(), time, row_id, rows)], about).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def indexed_page(spark: SparkSession, path: str, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """``paginate`` of an indexed list at the cost of one page, however deep: the counts tell the total and which slots of which
    folders hold the page; no other folder is opened, and Parquet skips the other slots. Counts are a row for each folder."""
    about = spark.read.parquet(f"{path}/about").first()
    shape, slot = StructType.fromJson(json.loads(about["shape"])), about["slot"]
    stored = StructType([*shape.fields, StructField("_slot", LongType())])
    counts = sorted(tuple(r) for r in spark.read.parquet(f"{path}/counts").collect())
    total, first, at, wanted, skipped = sum(n for _, n in counts), (page - 1) * size, 0, [], 0
    for number, n in counts:
        low, high = max(first - at, 0), min(first + size - at, n)
        if low < high:
            skipped = skipped if wanted else at + low // slot * slot
            folder = spark.read.schema(stored).parquet(f"{path}/rows/range={number}")
            wanted.append(folder.filter(F.col("_slot").between(low // slot, (high - 1) // slot)).drop("_slot"))
        at += n
    summary = spark.createDataFrame([(total, page, size, -(-total // size) if size else 0)], "total long, page int, size int, pages long")
    if not wanted:
        return spark.createDataFrame([], shape), summary
    return page_offset(reduce(DataFrame.union, wanted), [F.col(about["time"]).desc(), F.col(about["row_id"]).desc()], first - skipped, size), summary


def names_of_page(page: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The rows of ``names`` that a page needs. A page is small by its limit; whether it is broadcast is left to its size."""
    return names.join(page.select(key), key, "left_semi")


def page_number(skip: int, limit: int) -> int:
    return skip // limit + 1
