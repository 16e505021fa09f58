"""Substring search by an index of trigrams: candidates by intersection of the rarest, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Trigrams of a term that are looked up; the rarest of it.
LOOKED_UP = 3


def trigrams(text: str) -> Column:
    """Distinct runs of three characters of a column in lower case; none if it is null or shorter."""
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def index_texts(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Write the index of some text columns: the keys that hold each trigram, sorted by trigram so that a look-up skips the other
    files, and how many they are."""
    grams = F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(trigrams(c), F.array().cast("array<string>")) for c in columns]))))
    held = rows.filter(F.col(key).isNotNull()).select(grams.alias("gram"), F.col(key).alias("key"))
    held.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{path}/held")
    spark = rows.sparkSession
    counts = spark.read.parquet(f"{path}/held").groupBy("gram").agg(F.count("*").alias("n"))
    counts.sort("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """Keys that hold the rarest trigrams of a term; None for a term too short to have one."""
    low = term.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).orderBy("n", "gram").limit(len(grams)).collect()
    held = spark.read.parquet(f"{path}/held")
    if len(counts) < len(grams):  # a trigram that no row has
        return held.select("key").limit(0)
    rarest = [r["gram"] for r in counts[:LOOKED_UP]]
    found = held.filter(F.col("gram").isin(rarest)).groupBy("key").agg(F.count("*").alias("_n"))
    return found.filter(F.col("_n") == len(rarest)).select("key")
