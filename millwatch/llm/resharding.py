"""Resharding that moves the fewest bytes: a minimum-cost flow from old shard sizes to new capacities, then the affected files.

Only totals reach the driver: bytes by old shard and size level. There the flow from old to new shards is solved; staying costs
nothing, a moved byte one (or what a cost table says). In Spark every old shard's rows lie in one order, large rows first, in
blocks of a bounded number of rows. Running sums over levels, blocks and rows give each row its place among the shard's bytes;
the flow cuts that line, so whole blocks go one way and only the rows at a cut decide a block's split. Large rows come first so that small
ones lie at the cuts: a new shard misses its capacity by half a row for each cut at most.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millwatch.llm.tables import pieces, stored
from millwatch.session import new_folder

#: Rows of a block on average, and from which on a block of many equal rows is divided.
BLOCK_ROWS, HOT_ROWS = 500, 50_000
#: Lots of a shelf: running sums over lots are made within shelves, then over shelves.
SHELF = 4096
OLD_SHARDS, SHARDS = 24, 16
BLOCK = ["old_shard", "level", "lot", "part"]


def transfers(sizes: list[int], capacities: list[int], cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """Bytes that go from each old to each new shard, at the least total cost, by successive shortest paths.

    Old shard i keeps its bytes for nothing if it is new shard i; any other byte costs 1, or ``cost[i][j]`` (not negative). The
    capacities must sum to at least the sizes. Pairs without bytes are left out.
    """
    old, new = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards have no room for all bytes")
    price = cost or [[int(i != j) for j in range(new)] for i in range(old)]
    left, room, flow = list(sizes), list(capacities), [[0] * new for _ in range(old)]
    potential = [0] * (old + new)
    while any(left):
        distance, back = [None] * (old + new), [-1] * (old + new)
        queue = [(0, i) for i in range(old) if left[i]]
        for _, i in queue:
            distance[i] = 0
        # prices reduced by the potentials are never negative, so the shortest paths are found node by node
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            if u < old:
                edges = ((old + j, price[u][j]) for j in range(new))
            else:
                edges = ((i, -price[i][u - old]) for i in range(old) if flow[i][u - old])
            for v, p in edges:
                to = d + p + potential[u] - potential[v]
                if distance[v] is None or to < distance[v]:
                    distance[v], back[v] = to, u
                    heapq.heappush(queue, (to, v))
        end = min((old + j for j in range(new) if room[j]), key=lambda v: distance[v] + potential[v])
        potential = [p + (distance[end] if d is None else min(d, distance[end])) for p, d in zip(potential, distance)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        steps = list(zip(path[1:], path))
        amount = min([left[path[-1]], room[end - old], *(flow[v][u - old] for u, v in steps if u >= old)])
        for u, v in steps:
            if u < old:
                flow[u][v - old] += amount
            else:
                flow[v][u - old] -= amount
        left[path[-1]] -= amount
        room[end - old] -= amount
    return {(i, j): flow[i][j] for i in range(old) for j in range(new) if flow[i][j]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def _ranges(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard (end of a range of its bytes, new shard); the widest range first, the last without an end."""
    out = {}
    for i in sorted({i for i, _ in flow}):
        parts, at = sorted(((n, j) for (k, j), n in flow.items() if k == i), key=lambda x: (-x[0], x[1])), 0
        out[i] = []
        for n, j in parts:
            at += n
            out[i].append((at, j))
        out[i][-1] = ((1 << 61), out[i][-1][1])
    return out


def _blocks(rows: DataFrame, held: list) -> DataFrame:
    """rows with their block: lot (by hash, as many as the old shard's level needs) and part (0, but in lots that equal rows make
    too large)."""
    lots = _frame(rows.sparkSession, [(r["old_shard"], r["level"], pieces(r["rows"], BLOCK_ROWS)) for r in held], "old_shard int, level int, _lots int")
    rows = rows.join(lots, ["old_shard", "level"]).withColumn("lot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("_lots")).cast("int")).drop("_lots")
    large = rows.groupBy("old_shard", "level", "lot").count().filter(F.col("count") > HOT_ROWS)
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0))
    parts = large.select("old_shard", "level", "lot", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("_parts"))
    dealt = rows.join(parts, ["old_shard", "level", "lot"], "left")
    return dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")


def _sums_before(blocks: DataFrame, value: str, *by: str) -> DataFrame:
    """Blocks with the sum of ``value`` over the blocks before theirs (by lot, part) of the same ``by`` columns, in its place."""
    def before(keys: tuple[str, ...], *order: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shelved = blocks.withColumn("shelf", F.floor(F.col("lot") / SHELF))
    shelves = shelved.groupBy(*by, "shelf").agg(F.sum(value).alias(value)).withColumn("_start", before(by, "shelf")).drop(value)
    inside = shelved.withColumn(value, before((*by, "shelf"), "lot", "part"))
    return inside.join(shelves, [*by, "shelf"]).withColumn(value, F.col(value) + F.col("_start")).drop("shelf", "_start")


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's numbers, with at most a row for each pair of shards and size level."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def reshard(
    docs: DataFrame, old: Column, old_shards: int, shards: int = SHARDS, capacities: list[int] | None = None,
    cost: list[list[int]] | None = None, key: str = "doc_id", text: str = "text", row: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each shard), row.

    ``old`` gives a row's old shard, 0 to old_shards - 1. size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 unsigned (null as
    empty). Without ``capacities`` the new sizes are to be equal. Rows that repeat an id, null ids and equal texts are rows like any other;
    equal texts are not held together. ``row`` tells rows apart (by default their place in this read). Empty tables give no rows.
    Other columns, whatever they are called, are not read.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs[text], F.lit(""))
    rows = stored(docs.select(
        docs[key].cast("long").alias("doc_id"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), old.cast("int").alias("old_shard"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    ).withColumn("level", 64 - F.length(F.bin("size"))), "reshard-rows")

    # where each level of each old shard starts; what goes where
    held = rows.groupBy("old_shard", "level").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    sizes, starts = [0] * old_shards, []
    for r in sorted(held):
        starts.append((r["old_shard"], r["level"], sizes[r["old_shard"]]))
        sizes[r["old_shard"]] += r["bytes"]
    rows = _blocks(rows, held)
    flow = transfers(sizes, capacities or even(sum(sizes), shards), cost)
    ranges = _frame(spark, sorted(_ranges(flow).items()), "old_shard int, ranges array<struct<end: long, shard: int>>")
    starts = _frame(spark, starts, "old_shard int, level int, level_start long")

    # where each block starts within its level, each row within its block
    within = Window.partitionBy(*BLOCK).orderBy(F.xxhash64("doc_id", "text_crc32"), "doc_id", "text_crc32", "row")
    placed = rows.withColumn("through", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(within))
    blocks = _sums_before(rows.groupBy(*BLOCK).agg(F.sum("size").alias("block_start")), "block_start", "old_shard", "level")
    middle = 2 * (F.col("level_start") + F.col("block_start") + F.col("through")) - F.col("size")
    cut = F.filter("ranges", lambda r: middle < 2 * r["end"])[0]["shard"]
    chosen = placed.join(blocks, BLOCK).join(starts, ["old_shard", "level"]).join(ranges, "old_shard")
    chosen = stored(chosen.select("doc_id", "size", "text_crc32", *BLOCK, "row", "rank", cut.alias("shard")), "reshard-chosen")

    # slots: by old shard and level, block, rank
    shares = chosen.groupBy("shard", *BLOCK).agg(F.count("*").alias("block_slot"), F.min("rank").alias("least"))
    groups, slots, at = shares.groupBy("shard", "old_shard", "level").agg(F.sum("block_slot").alias("rows")).collect(), [], {}
    for shard, i, level, n in sorted(tuple(r) for r in groups):
        slots.append((shard, i, level, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    slots = _frame(spark, slots, "shard int, old_shard int, level int, level_slot long")
    shares = _sums_before(shares, "block_slot", "shard", "old_shard", "level")
    out = chosen.join(shares, ["shard", *BLOCK]).join(slots, ["shard", "old_shard", "level"])
    slot = F.col("level_slot") + F.col("block_slot") + F.col("rank") - F.col("least")
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", slot.cast("long").alias("slot"), "row")


def rewrite(spark: SparkSession, folder: str, old_shards: int, shards: int, target: str | None = None, **named: str) -> DataFrame:
    """Reshard a folder laid out as ``shard=<n>/*.parquet`` and write what that changes: shard, old_rows, rows, moved_in, path.

    A shard whose rows all stay and that gets none keeps its files (path is the old one). The others are written anew, by slot,
    below ``target`` (by default a new folder beside the checkpoints); nothing old is touched, so a reader of the old paths is not
    disturbed and a lost executor costs its tasks only. Rows keep all their columns; a row is known by its file and place there.
    """
    target = target or new_folder(spark, "reshard")
    docs = spark.read.parquet(folder)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    plan = stored(reshard(docs, docs["shard"], old_shards, shards, row=place, **named).select("old_shard", "shard", "slot", "row"), "reshard-plan")
    count = plan.groupBy("old_shard", "shard").count().collect()
    old, new, moved = ({j: sum(r["count"] for r in count if take(r, j)) for j in range(max(old_shards, shards))} for take in (
        lambda r, j: r["old_shard"] == j, lambda r, j: r["shard"] == j, lambda r, j: r["shard"] == j != r["old_shard"]))
    changed = [j for j in range(shards) if moved[j] or old[j] != new[j]]
    todo = plan.filter(F.col("shard").isin(changed)).select(F.col("shard").alias("_to"), F.col("slot").alias("_slot"), "row")
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "shard")).alias("_doc"), place.alias("row"))
    parts = pieces(sum(new[j] for j in changed), BLOCK_ROWS, len(changed) or 1)
    rows = whole.join(todo, "row").repartitionByRange(parts, "_to", "_slot").sortWithinPartitions("_to", "_slot")
    rows.select(F.col("_to").alias("shard"), "_doc.*").write.partitionBy("shard").parquet(target)
    return spark.createDataFrame(
        [(j, old[j], new[j], moved[j], f"{target if j in changed else folder}/shard={j}") for j in range(shards)],
        "shard int, old_rows long, rows long, moved_in long, path string",
    )


def by_source(docs: DataFrame) -> Column:
    """The layout that the query starts from: documents held by their source, null as empty, in OLD_SHARDS shards."""
    return F.pmod(F.crc32(F.coalesce(docs["source"], F.lit("")).cast("binary")), F.lit(OLD_SHARDS))


def even_shards(docs: DataFrame) -> DataFrame:
    """Documents from the layout by source to SHARDS shards of near equal bytes, moving the fewest."""
    out = reshard(docs, by_source(docs), OLD_SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
