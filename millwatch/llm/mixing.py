"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

A source is dealt into blocks of about BLOCK_WORDS words by the hash of the id. Its target says how many whole passes over
its blocks the mix takes and how far the last pass goes. The draws of all sources are split between the output shards from
the root of a binary tree down: at a node, the left half's share of each source's draws is one multivariate-hypergeometric
sample, seeded by the node, so every shard finds its own counts and offsets alone, in a task. Draw number x of a source is
the block of rank x in that pass's permutation, so the shards' blocks are disjoint by construction. Rows are put in random
order inside a shard only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millwatch.llm.tables import SPACES, pieces, small_table, stored

BLOCK_WORDS = 65_536
SHARD_WORDS = 2_000_000
MOST_COPIES = 3
BINS = 4096


def weights(n: int, cycle: tuple[float, ...] = (1, 2, 3)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def targets(sizes: list[int], shares: list[float], most: int = MOST_COPIES) -> list[float]:
    """Words of each source: all words shared by weight; what lies above ``most`` times a source's size is shared again."""
    total, out, full = float(sum(sizes)), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        free = total - sum(x for x, f in zip(out, full) if f)
        share = sum(w for w, f in zip(shares, full) if not f)
        for i, f in enumerate(full):
            if not f:
                out[i] = free * shares[i] / share
        over = [i for i, f in enumerate(full) if not f and out[i] > most * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i], full[i] = float(most * sizes[i]), True


def _seed(*parts) -> int:
    return xxhash.xxh64_intdigest("/".join(map(str, parts)))


def permutation(blocks: int, *seed) -> tuple[int, int]:
    """(a, c) so that ``(a * block + c) mod blocks`` is a permutation of the blocks."""
    a = _seed("a", *seed) % blocks or 1
    while math.gcd(a, blocks) != 1:
        a = a % blocks + 1
    return a, _seed("c", *seed) % blocks


def split_tree(draws: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, count) of a shard in each source's draws: from the root down, a node's left part is sampled without putting back."""
    count, offset, low, high = np.array(draws, np.int64), np.zeros(len(draws), np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        take = round(int(count.sum()) * (middle - low) / (high - low))
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(count, take, method="marginals") if take else np.zeros_like(count)
        if shard < middle:
            count, high = left, middle
        else:
            offset, count, low = offset + left, count - left, middle
    return offset, count


def _shards(draws: list[int], shards: int, seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                for i, (at, n) in enumerate(zip(*split_tree(draws, shards, int(shard), seed))):
                    if n:
                        yield pd.DataFrame({"s": i, "shard": int(shard), "at": [at], "to": [at + n - 1]})

    return rows


def _cut(light: DataFrame, plan: list[dict]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Whole blocks that each source's last pass takes, and the (source, id) pairs that it takes of the next block.

    Ranks are narrowed down by sums over at most BINS ranges of ranks a source; the last block's rows with words (at most
    its words) are taken in hash order as long as they fit.
    """
    left = {p["s"]: p["rest"] for p in plan if p["rest"] > 0}
    span = {p["s"]: (0, p["blocks"]) for p in plan if p["rest"] > 0}
    spark = light.sparkSession
    while any(b - a > 1 for a, b in span.values()):
        rows = [(s, a, b, max(1, -(-(b - a) // BINS))) for s, (a, b) in span.items() if b - a > 1]
        ranges = F.broadcast(small_table(spark, rows, "r_s int, low long, high long, width long"))
        inside = light.join(ranges, (F.col("s") == F.col("r_s")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        sums = defaultdict(dict)
        for r in inside.groupBy("s", F.floor((F.col("rank") - F.col("low")) / F.col("width")).alias("bin")).agg(F.sum("size").alias("w")).collect():
            sums[r["s"]][r["bin"]] = r["w"]
        for s, low, high, width in rows:
            at = low
            while at < high:
                words = sums[s].get((at - low) // width, 0)
                if words > left[s]:
                    break
                left[s], at = left[s] - words, at + width
            span[s] = (min(at, high), min(at + width, high))  # empty if all was taken
    rows = [(s, a) for s, (a, b) in span.items() if b > a]
    last = F.broadcast(small_table(spark, rows, "r_s int, low long"))
    docs = light.filter("size > 0").join(last, (F.col("s") == F.col("r_s")) & (F.col("rank") == F.col("low")))
    some, nearest = [], {}
    for r in sorted(docs.select("s", "doc_id", "size", "h").distinct().collect(), key=lambda r: (r["s"], r["h"], r["doc_id"] or 0)) if rows else []:
        if r["size"] <= left[r["s"]]:
            left[r["s"]] -= r["size"]
            some.append((r["s"], r["doc_id"]))
        elif r["s"] not in nearest or r["size"] < nearest[r["s"]][1]:
            nearest[r["s"]] = (r["doc_id"], r["size"])
    some += [(s, d) for s, (d, size) in nearest.items() if size - left[s] < left[s]]
    return {s: a for s, (a, b) in span.items()}, some


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(documents, draws, number of shards) of the mix.

    documents: one row per row of docs with doc_id, size (words; a null text has 0), source_size, target, row. draws: one row
    per row taken, so a document taken twice has two: row, doc_id, pass, shard. Sources stand in code point order, null last,
    and get the cycle's weights in turn. Sources must be a category (one row each comes to the driver). An empty table gives
    none; ids may be null or repeat (rows with one id are in one block and are taken together). Reruns give the same draws.
    """
    spark: SparkSession = docs.sparkSession
    size = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(f"[^{SPACES}]+")).cast("long")
    rows = stored(docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan, want = [], targets([r["size"] for r in found], weights(len(found), cycle)) if found else []
    for i, (r, target) in enumerate(zip(found, want)):
        whole = min(MOST_COPIES, int(target // r["size"])) if r["size"] else 0
        blocks = pieces(r["size"], BLOCK_WORDS)
        rest = target - whole * r["size"] if whole < MOST_COPIES else 0.0
        plan.append({"s": i, "source": r["source"], "source_size": r["size"], "target": target, "whole": whole, "blocks": blocks, "rest": rest, "perm": [permutation(blocks, seed, i, e) for e in range(MOST_COPIES)]})
    schema = "p_source string, s int, source_size long, target double, whole int, blocks long, perm array<struct<a: long, c: long>>"
    frame = small_table(spark, [(p["source"], p["s"], p["source_size"], p["target"], p["whole"], p["blocks"], [{"a": a, "c": c} for a, c in p["perm"]]) for p in plan], schema)
    known = rows.join(F.broadcast(frame), rows["source"].eqNullSafe(F.col("p_source"))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    known = known.withColumn("block", F.pmod("h", "blocks"))
    rank = lambda e: F.expr(f"pmod(perm[{e}].a * block + perm[{e}].c, blocks)")
    ranked = known.withColumn("rank", rank("least(whole, 2)"))
    cuts, some = _cut(ranked.select("s", "doc_id", "size", "rank", "h"), plan)
    part = F.broadcast(small_table(spark, [(p["s"], cuts.get(p["s"], 0)) for p in plan], "c_s int, cut long"))
    extra = small_table(spark, some, "e_s int, e_id long").distinct()
    drawn = ranked.join(part, F.col("s") == F.col("c_s")).join(extra, (F.col("s") == F.col("e_s")) & F.col("doc_id").eqNullSafe(F.col("e_id")), "left")
    here = (F.col("rank") < F.col("cut")) | F.col("e_s").isNotNull()
    passes = F.filter(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1)), lambda e: (e < F.col("whole")) | ((e == F.col("whole")) & here))
    drawn = drawn.select("row", "doc_id", "s", "block", "blocks", "perm", F.explode(passes).alias("pass"))
    drawn = drawn.select("row", "doc_id", "s", "pass", (F.col("pass") * F.col("blocks") + rank("pass")).alias("draw"))
    draws = [p["whole"] * p["blocks"] + (cuts.get(p["s"], 0) + (p["s"] in {s for s, _ in some}) if p["rest"] > 0 else 0) for p in plan]
    shards = pieces(sum(want), SHARD_WORDS)
    owners = spark.range(shards).mapInPandas(_shards(draws, shards, seed), "s int, shard int, at long, to long")
    owners = owners.select(F.col("s").alias("o_s"), "shard", F.explode(F.sequence("at", "to")).alias("o_draw"))
    drawn = drawn.join(owners, (F.col("s") == F.col("o_s")) & (F.col("draw") == F.col("o_draw"))).select("row", "doc_id", "pass", "shard")
    return known.select("row", "doc_id", "size", "source_size", "target"), drawn, shards


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words times the times it is drawn)."""
    rows, draws, _ = mix(docs, **options)
    times = draws.groupBy(F.col("row").alias("t_row")).agg(F.count("*").alias("times"))
    out = rows.join(times, F.col("row") == F.col("t_row"), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every drawn document as often as it is drawn, all columns as they came, in random order inside a shard.

    Each task sorts the texts of one shard, which has about SHARD_WORDS words.
    """
    _, draws, shards = mix(docs, seed=seed, key=key, **options)
    times = draws.groupBy(F.col("doc_id").alias("_id"), F.col("pass").alias("_pass")).agg(F.min("shard").alias("_shard"))
    whole = docs.select(docs[key].cast("long").alias("id"), F.struct("*").alias("doc"))  # no column of docs can have another's name
    out = whole.join(times, whole["id"].eqNullSafe(times["_id"]))
    return out.repartitionById(shards, "_shard").sortWithinPartitions(F.xxhash64(F.lit(seed), "_id", "_pass")).select("doc.*")
