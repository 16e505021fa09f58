"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, and their connected components.

Shingles are hashed into groups. A document's counts per group are a point; the overlap of two documents is at most the sum of
the smaller counts, and for a box of points at most the sum with the box's upper corner. R-trees of such points find the pairs
that can reach the threshold, and their sets are compared.

Which points share a tree follows from the groups as well: two sets that differ in at most D shingles agree wholly in all but D
groups. Every document therefore lies in one bucket per group, named by the shingles it has there, and every linked pair
shares a bucket. Most buckets have one member: senders exchange Golomb-coded lists of their buckets' names with owners and learn
which ones others have, and only those are shuffled with their members. Equal sets are one class from the start. The members of a bucket are first compared with its smallest member
only; what that links is one component, and trees are needed only for buckets that still hold several. They first give each
member's nearest one in another component, at most one pair a member; what these links leave apart gets all its pairs.

A line that many documents have gives common buckets, which grow with the corpus. A document leaves as many of its largest common
buckets as it can do without: its differing shingles spoil only so many groups, so every set linked with its own shares others
with it. Copies share nearly all their buckets; where one tree over all buckets of a smallest member has fewer pairs than a tree for
each, there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm import golomb
from millwatch.llm.components import components
from millwatch.llm.tables import discard, give_back, keep_rows, packed_id, pieces, small_batches, stored, unpacked
from millwatch.llm.words import blocks, mix, split, to_bytes

SHINGLE = 3
#: Similarity of at least 9 tenths: 10 * common >= 9 * union. At least two thirds, see ``bands``.
SIMILAR = (9, 10)
#: Groups of a point. In fewer, unrelated long texts have counts so alike that the bound lets their pairs pass.
GROUP_BITS = 9
GROUPS = 1 << GROUP_BITS
LEAF = 16
BLOCK = 2048
RESEEDS = 8
#: The two lowest bits of a bucket's name say whether its level is odd, and whether it is from a further dealing.
BITS = 48
#: Members from which on a bucket is common.
COMMON = 32
#: Names of buckets that a sender holds, and an owner.
SENDER_BUCKETS = OWNER_BUCKETS = 200_000
#: Texts, and pairs of sets, that Python gets at once.
TEXT_ROWS, PAIR_ROWS = 1_000, 250
#: Points that a task has in its trees.
TREE_ROWS = 10_000
#: Pairs that a shard's trees give before repeats among them are dropped.
PAIRS_HELD = 1 << 16
#: Bytes of text that are cut into shingles together.
TEXT_BYTES = 1 << 19
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB, 0xC2B2AE3D27D4EB4F)]


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i are ``hashes[first[i]:first[i + 1]]``, ascending.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    words = split(texts)
    counts = np.diff(words.first)
    own = np.maximum(counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), own)
    start = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
    value = np.zeros(len(text), np.uint64)
    for i in range(size):
        inside = i < counts[text]
        value = mix(value * _C[0] + np.where(inside, words.hashes[np.minimum(start + i, max(0, len(words.hashes) - 1))] if len(words.hashes) else 0, np.uint64(i + 1)) + _C[1])
    for a, b in zip((np.cumsum(own) - own).tolist(), np.cumsum(own).tolist()):
        value[a:b].sort()
    keep = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))[: len(value)]
    return value[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Wrapping sums of the values between the bounds; 0 for empty ranges."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, each at least one and a half times the one before: linked sizes are at most one band apart."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 3 // 2)))
    return np.array(edges)


#: The bands of all sizes; one list for all, since both sides of a pair must find the same groups wherever they are read.
EDGES = bands(1 << 62)


def signatures(hashes: np.ndarray, first: np.ndarray, similar: tuple[int, int] = SIMILAR, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for every text, level and group.

    A level is the band of a pair's larger set: a text takes part in its own band's and, if a partner may lie there, in the
    next one's. There are D + 1 groups and some to spare, as agreement in a group that is empty on both sides tells nothing.
    A text with more empty groups than there are to spare takes part in another dealing of the groups as well (so does its
    partner, if they agree in empty groups only), and after RESEEDS such dealings in a bucket for empty groups.

    ``room`` (a row per text, a column for levels of even and of odd number) gets the number of buckets of the first dealing that a text can do
    without at a level: with one more left, it still shares one of them with every set that it is linked with there.
    """
    near, of = similar
    size = np.diff(first)
    band = np.searchsorted(EDGES, size, "right") - 1
    texts, buckets = [], []
    for step in (0, 1):
        level = band + step
        who = np.flatnonzero((size > 0) & ((step == 0) | (EDGES[level] * near <= size * of)))
        for seed in range(RESEEDS):
            if not len(who):
                break
            top = EDGES[level[who] + 1] - 1
            needed = 2 * top * (of - near) // (of + near) + 1  # union less intersection of sets up to this size, and one
            low = EDGES[level[who]] * near / of
            spare = np.ceil(1.5 * needed * np.exp(-low / (1.2 * needed)) - 0.05).astype(np.int64)  # of the smallest sets here
            groups = needed + np.where(needed > 1, spare, 0)
            base = np.cumsum(groups) - groups
            n = size[who]
            place = np.repeat(first[:-1][who], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value = mix(hashes[place] + np.uint64(seed * int(_C[2]) % (1 << 64)))
            group = ((value >> np.uint64(32)) * np.repeat(groups, n).astype(np.uint64)) >> np.uint64(32)
            key = np.repeat(base, n) + group.astype(np.int64)
            content = np.zeros(groups.sum(), np.uint64)
            np.add.at(content, key, mix(value + _C[3]))
            filled = np.bincount(key, minlength=len(content)) > 0
            owner = np.repeat(np.arange(len(who)), groups)
            empty = np.bincount(owner[~filled], minlength=len(who))
            if room is not None and not seed:
                differing = (n + np.minimum(top, n * of // near)) * (of - near) // (of + near)  # from the largest partner here
                room[who, level[who] & 1] = groups - empty - differing - 1
            number = np.arange(groups.sum()) - base[owner]
            label = mix(content + mix(level[who][owner].astype(np.uint64) * _C[4] + np.uint64(seed * int(_C[0]) % (1 << 64)) + number.astype(np.uint64) * _C[1]))
            last = seed == RESEEDS - 1
            out = filled | last
            texts.append(who[owner[out]])
            kind = ((level[who][owner] & 1) << 1) | (seed > 0)
            buckets.append((label >> np.uint64(64 - BITS) & ~np.uint64(3) | kind.astype(np.uint64))[out])
            who = who[empty > groups - needed]
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(buckets)


def _index(size: int, similar: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, TEXT_BYTES):
                hashes, first = shingles(texts[a:b], size)
                room = np.full((b - a, 2), -1)
                text, bucket = signatures(hashes, first, similar, room)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(1, b - a))
                yield pdf.iloc[a:b][["doc_id"]].assign(**_names(hashes, first), room_even=room[:, 0], room_odd=room[:, 1], buckets=np.split(bucket[order].view(np.int64), cut))
        give_back()

    return run


def _held(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *pdf["buckets"]]).astype(np.int64).view(np.uint64)


def _lists(owner_bits: int):
    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        values = np.sort(_held(pdf))
        return golomb.lists(key[0], values[np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]], BITS, owner_bits)

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    give_back()
    return golomb.answer(pdf)


def _shared(pdf: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    """Members of the buckets that another sender has, or another member here."""
    give_back()
    if not len(pdf):
        return pd.DataFrame({"node": [], "bucket": []}, dtype=np.int64)
    _, place, count = np.unique(_held(pdf), return_inverse=True, return_counts=True)
    found = (golomb.flags(bitmaps) | (count > 1))[place]
    nodes = np.repeat(pdf["node"].to_numpy(), [len(b) for b in pdf["buckets"]])
    return pd.DataFrame({"node": nodes[found], "bucket": _held(pdf)[found].view(np.int64)})


def _names(hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Size of each set and 128 bits that name it."""
    return {"n_shingles": np.diff(first), "d1": _sums(mix(hashes + _C[1]), first).view(np.int64), "d2": _sums(mix(hashes + _C[4]), first).view(np.int64)}


def counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingles of each text per group: its point."""
    group = (mix(hashes + _C[3]) >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(text * GROUPS + group, minlength=(len(first) - 1) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _points(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, TEXT_BYTES):
                hashes, first = shingles(texts[a:b], size)
                yield pd.DataFrame({**_names(hashes, first), "point": list(counts(hashes, first))})
        give_back()

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, TEXT_BYTES):
                hashes, first = shingles(texts[a:b], size)
                yield pd.DataFrame({**_names(hashes, first), "members": [hashes[i:j].tobytes() for i, j in zip(first, first[1:])]})
        give_back()

    return run


class RTree:
    """Boxes of points, split at the median of their widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, similar: tuple[int, int] = SIMILAR):
        self.points, self.sizes, self.labels, (self.near, self.of) = points, sizes, labels, similar
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        points = self.points[rows]
        label = self.labels[rows[0]] if (self.labels[rows] == self.labels[rows[0]]).all() else None
        box = (points.max(axis=0), self.sizes[rows].min(), label)
        if len(rows) <= LEAF:
            return box, rows, None
        wide = np.argmax(points.max(axis=0) - points.min(axis=0))
        order = np.argsort(points[:, wide], kind="stable")
        half = len(rows) // 2
        return box, None, (self._build(rows[order[:half]]), self._build(rows[order[half:]]))

    def _can(self, overlap: np.ndarray, sizes: np.ndarray, other) -> np.ndarray:
        """common / union >= near / of needs (near + of) * common >= near * (sum of the sizes)."""
        return (self.near + self.of) * overlap >= self.near * (sizes + other)

    def pairs(self, nearest: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of differing labels that the bound allows, each once; with ``nearest``, only each point's with the largest share."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        share, partner = np.zeros(len(self.points)), np.full(len(self.points), -1)

        def keep(points: np.ndarray, others: np.ndarray, shares: np.ndarray) -> None:
            at = shares.argmax(axis=1)
            top = shares[np.arange(len(points)), at]
            better = top > share[points]
            share[points[better]], partner[points[better]] = top[better], others[at[better]]

        def visit(node, who: np.ndarray) -> None:
            (upper, least, label), rows, halves = node
            if label is not None:
                who = who[self.labels[who] != label]
            who = who[self._can(np.minimum(self.points[who], upper).sum(axis=1), self.sizes[who], least)]
            if not len(who):
                return
            if halves:
                visit(halves[0], who)
                visit(halves[1], who)
                return
            overlap = np.stack([np.minimum(self.points[who], self.points[r]).sum(axis=1) for r in rows], axis=1)
            fits = self._can(overlap, self.sizes[who][:, None], self.sizes[rows][None, :])
            fits &= (who[:, None] < rows[None, :]) & (self.labels[who][:, None] != self.labels[rows][None, :])
            if nearest:
                shares = np.where(fits, overlap / (self.sizes[who][:, None] + self.sizes[rows][None, :]), 0)
                keep(who, rows, shares)
                keep(rows, who, shares.T)
                return
            a, b = np.nonzero(fits)
            if len(a):
                out.append((who[a], rows[b]))

        for at in range(0, len(self.points), BLOCK):
            visit(self.root, np.arange(at, min(at + BLOCK, len(self.points))))
        if nearest:
            found = np.flatnonzero(partner >= 0)
            return [(found, partner[found])]
        return out


def _tree_pairs(pdf: pd.DataFrame, similar: tuple[int, int], nearest: bool = False) -> pd.DataFrame:
    """Candidate pairs of the buckets of one shard, each once, a tree for each bucket; only one tree's points are copied at a time."""
    order = np.lexsort((pdf["j"], pdf["i"], pdf["bucket"]))
    names = pdf[["bucket", "i", "j"]].to_numpy(np.int64)[order]
    cut = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1), [True]))) if len(names) else [0]
    rows, sizes, labels = (pdf[c].to_numpy(np.int64) for c in ("node", "n_shingles", "component"))
    points, found, new = pdf["point"].to_numpy(), [np.zeros((0, 2), np.int64)], 0
    for at, to in zip(cut, cut[1:]):
        part = order[at:to]
        for a, b in RTree(np.stack(points[part]), sizes[part], labels[part], similar).pairs(nearest):
            found.append(np.sort(np.stack((rows[part][a], rows[part][b]), axis=1), axis=1))
            new += len(a)
        if new > max(PAIRS_HELD, len(found[0])):
            found, new = [np.unique(np.concatenate(found), axis=0)], 0
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["u", "v"])


def _links(similar: tuple[int, int]):
    near, of = similar

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked = []
            for a, b in zip(pdf["u_members"], pdf["v_members"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = int((np.diff(np.sort(np.concatenate((x, y)), kind="stable")) == 0).sum())
                linked.append((near + of) * common >= near * (len(x) + len(y)))
            yield pdf.loc[np.array(linked, bool), ["u", "v"]]
        give_back()

    return run


def _verified(pairs: DataFrame, points: DataFrame, plain: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs u, v whose sets are similar. Sets are gathered only for documents in pairs that the points allow."""
    near, of = similar
    point = lambda c: points.select(F.col("node").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("point").alias(f"{c}_point"))
    least = F.zip_with("u_point", "v_point", lambda a, b: F.least(a, b))
    overlap = F.aggregate(least, F.lit(0).cast("long"), lambda total, x: total + x)
    allowed = pairs.join(point("u"), "u").join(point("v"), "v").filter((near + of) * overlap >= near * (F.col("u_n") + F.col("v_n"))).select("u", "v")
    allowed = stored(allowed, "jaccard-allowed")
    wanted = allowed.select(F.col("u").alias("node")).union(allowed.select(F.col("v").alias("node"))).distinct()
    named = points.join(wanted, "node").select("n_shingles", "d1", "d2", "node", "doc_id")
    sets = keep_rows(plain, named).select("text").mapInPandas(_sets(size), "n_shingles long, d1 long, d2 long, members binary")
    sets = sets.join(named.drop("doc_id"), ["n_shingles", "d1", "d2"]).groupBy("node").agg(F.first("members").alias("members"))
    with small_batches(plain.sparkSession, TEXT_ROWS):
        sets = stored(sets, "jaccard-sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_members"))
    together = allowed.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_members", "v_members")
    with small_batches(plain.sparkSession, PAIR_ROWS):
        linked = stored(together.mapInPandas(_links(similar), "u long, v long"), "jaccard-links")
    discard(sets)
    discard(allowed)
    return linked


def _needed(members: DataFrame, rows: DataFrame) -> DataFrame:
    """bucket, node, first, size of buckets' members, without those that need not be in a common bucket.

    By ``room``, two linked sets share at least one bucket more of the first dealing than either can do without. Each leaves its last
    ones in order of size and name, so the first that they share in that order keeps both.
    """
    large = members.filter(F.col("size") > COMMON).select("bucket", "node", "size", F.expr("bucket >> 1 & 1").alias("odd"), F.expr("bucket & 1").alias("further"))
    large = large.join(rows.select("node", "room_even", "room_odd"), "node").withColumn("room", F.expr("if(odd = 1, room_odd, room_even)"))
    last = F.row_number().over(Window.partitionBy("node", "odd", "further").orderBy(F.desc("size"), F.desc("bucket")))
    kept = large.withColumn("last", last).filter("room < 0 or further = 0 and last > room").select("bucket", "node")
    return members.filter(F.col("size") <= COMMON).unionByName(_sized(kept).select(members.columns))


def _grouped(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """bucket and node of what trees are for: members but the first, which pairs have. All buckets of one first are one
    where that has no more pairs."""
    others = members.filter("node <> first")
    apart = others.groupBy("first").agg(F.sum(F.col("size") - 1).alias("apart"))
    one = pairs.groupBy(F.col("u").alias("first")).agg(F.count("*").alias("n")).join(apart, "first").filter("n * n <= apart")
    one = stored(one.select("first", "n"), "jaccard-firsts")  # cut off, so that a frequent first's rows can be split between tasks
    whole = pairs.join(one.filter("n > 1"), pairs["u"] == one["first"]).select((-1 - F.col("u")).alias("bucket"), F.col("v").alias("node"))
    return whole.unionByName(others.filter("size > 2").join(one, "first", "left_anti").select("bucket", "node"))


def _sized(members: DataFrame) -> DataFrame:
    """Members of the buckets that have several, with the smallest one and their number."""
    return members.join(members.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1"), "bucket")


def _candidates(members: DataFrame, points: DataFrame, found: DataFrame, similar: tuple[int, int], nearest: bool) -> DataFrame | None:
    """Pairs u, v of the buckets that hold several components, as their trees allow them; None if there is no such bucket."""
    label = F.coalesce("component", "node").alias("component")
    left = members.join(found, "node", "left").select("bucket", "node", label)
    mixed = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a <> b")
    left = left.join(mixed.select("bucket", "n"), "bucket").join(points.select("node", "n_shingles", "point"), "node")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    left = left.withColumn("x", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = left.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "n_shingles", "component", "point")
    total = mixed.agg(F.coalesce(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)), F.lit(0))).first()[0]
    if not total:
        return None
    shards = pieces(total, TREE_ROWS, 12)
    left = left.withColumn("shard", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shards)))

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return _tree_pairs(pdf, similar, nearest)

    return left.groupBy("shard").applyInPandas(trees, "u long, v long").distinct()


def similar_documents(docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR, key: str = "doc_id", text: str = "text", named: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; shingles have ``size`` words. With ``named``, also the 128 bits
    d1, d2 that name its set.

    component_id is the smallest id that links reach, the own one included; a text without words is linked with nothing. Null
    ids count as no id: a component without any has null. Rows that repeat an id or a text are rows of their own; equal sets
    are linked. Shingles are compared by 64-bit hashes.
    """
    plain = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = docs.select(packed_id(docs, key), docs[text].alias("text")).mapInPandas(_index(size, similar), "doc_id long, n_shingles long, d1 long, d2 long, room_even int, room_odd int, buckets array<long>")
    with small_batches(docs.sparkSession, TEXT_ROWS):
        named_buckets = stored(unpacked(rows).withColumn("node", F.monotonically_increasing_id()), "jaccard-buckets")
    rows = stored(named_buckets.drop("buckets"), "jaccard-rows")
    name = ["n_shingles", "d1", "d2"]
    classes = stored(rows.filter("n_shingles > 0").groupBy(*name).agg(F.min("node").alias("node"), F.min("doc_id").alias("least")), "jaccard-classes")
    own = keep_rows(named_buckets.select("node", "buckets"), classes, "node")
    total = own.agg(F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()[0]
    senders, owner_bits = pieces(total, SENDER_BUCKETS, 12), (pieces(total, OWNER_BUCKETS, 16) - 1).bit_length()
    held = own.select(F.pmod(F.xxhash64("node"), F.lit(senders)).cast("int").alias("sender"), "node", "buckets")
    bitmaps = held.groupBy("sender").applyInPandas(_lists(owner_bits), golomb.LISTS).groupBy("owner").applyInPandas(_answer, golomb.BITMAPS)
    members = held.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_shared, "node long, bucket long")
    members = stored(members, "jaccard-members")
    discard(named_buckets)
    sized = stored(_sized(members), "jaccard-members")
    discard(members)
    members = stored(_needed(sized, rows), "jaccard-members")
    discard(sized)
    pairs = stored(members.filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), "jaccard-pairs")
    grouped = stored(_grouped(members, pairs), "jaccard-groups")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = classes.join(wanted, "node").join(rows.select("node", "doc_id"), "node")
    texts = keep_rows(plain, asked).select("text")
    points = texts.mapInPandas(_points(size), "n_shingles long, d1 long, d2 long, point array<int>")
    points = points.join(asked.select(*name, "node", "doc_id"), name).groupBy("node").agg(*[F.first(c).alias(c) for c in (*name, "point", "doc_id")])
    with small_batches(docs.sparkSession, TEXT_ROWS):
        points = stored(points, "jaccard-points")
    links = _verified(pairs, points, plain, size, similar)
    found, tried = components(links), pairs
    for nearest in (True, False):
        more = _candidates(grouped, points, found, similar, nearest)
        if more is None:
            break
        more = stored(more.join(tried, ["u", "v"], "left_anti"), "jaccard-more")
        links, tried = links.unionByName(_verified(more, points, plain, size, similar)), tried.unionByName(more)
        found = components(links)
    linked = classes.join(found, "node")
    linked = linked.select(*name, "component").join(linked.groupBy("component").agg(F.min("least").alias("lowest")), "component").drop("component")
    answer = classes.join(linked, name, "left").select(*name, F.coalesce("lowest", "least").alias("component_id"))
    full = rows.filter("n_shingles > 0").join(answer, name).select("doc_id", "n_shingles", "component_id", "d1", "d2")
    full = full.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "d1", "d2"))
    return full if named else full.drop("d1", "d2")


def _named(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, TEXT_BYTES):
                hashes, first = shingles(texts[a:b], size)
                yield pdf.iloc[a:b][["doc_id", "print"]].assign(**_names(hashes, first))

    return run


def one_of_each(docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Docs without those that have a smaller id in their component, all columns as they came.

    A row goes by its id and its own text: where an id repeats with two texts, the text that has no smaller id in its component
    stays. Rows with a null id go if their component has any id.
    """
    found = stored(similar_documents(docs, size, similar, key, text, named=True), "jaccard-found")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "d1", "d2").distinct()
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    both = stored(gone.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi"), "jaccard-both")
    ids = gone.select(F.col("doc_id").alias("_gone")).distinct()
    sure = stored(ids.join(both.select(F.col("doc_id").alias("_both")).distinct(), F.col("_gone").eqNullSafe(F.col("_both")), "left_anti"), "jaccard-gone")
    own = docs[key].cast("long")
    out = docs.join(sure, own.eqNullSafe(sure["_gone"]), "left_anti")
    if both.isEmpty():
        return out
    # ids with a text that goes and one that stays: the texts that go, by their sets' names
    rows = out.select(packed_id(out, key), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print"))
    asked = keep_rows(unpacked(rows), both.select("doc_id").distinct())
    rows = asked.select(packed_id(asked, "doc_id"), "text", "print")
    rows = unpacked(rows.mapInPandas(_named(size), "doc_id long, print long, n_shingles long, d1 long, d2 long"))
    names = ["n_shingles", "d1", "d2"]
    same = F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.struct(*(F.col(f"r.{c}") for c in names)) == F.struct(*(F.col(f"b.{c}") for c in names)))
    texts = stored(rows.alias("r").join(both.alias("b"), same, "left_semi").select(F.col("doc_id").alias("_gone"), F.col("print").alias("_print")).distinct(), "jaccard-texts")
    return out.join(texts, out[key].cast("long").eqNullSafe(texts["_gone"]) & (F.xxhash64(out[text]) == texts["_print"]), "left_anti")
