"""Exact duplicates by a Golomb-coded exchange of fingerprints, verified byte by byte.

Senders hold a slice of the rows. Each sorts its distinct 64-bit fingerprints, cuts them by owner (the top bits) and sends
every owner one Golomb-Rice coded list. An owner answers each list with a bitmap: which fingerprints another sender holds as
well. Rows whose bit is set, or whose fingerprint occurs twice in their sender, are suspects; only their texts are shuffled,
and grouping them by the text itself compares the bytes. A group of copies reaches an owner as one value per sender.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millwatch.llm import golomb
from millwatch.llm.tables import SPACES, keep_rows, packed_id, pieces, stored, unpacked

SENDER_ROWS = 200_000


def normal(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", " ")


def _send(owner_bits: int):
    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["print"].to_numpy().astype(np.int64).view(np.uint64))
        owner = values >> np.uint64(64 - owner_bits) if owner_bits else np.zeros(len(values), np.uint64)
        cut = np.flatnonzero(np.diff(owner, prepend=np.uint64(1 << 63)))
        rows = []
        for at, to in zip(cut, [*cut[1:], len(values)]):
            base = owner[at] << np.uint64(64 - owner_bits) if owner_bits else np.uint64(0)
            rows.append((key[0], int(owner[at]), to - at, *golomb.encode(values[at:to] - base)))
        return pd.DataFrame(rows, columns=["sender", "owner", "n", "low", "unary", "rest"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb.decode(*x) for x in zip(pdf["n"], pdf["low"], pdf["unary"], pdf["rest"])]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[count > 1]
    bits = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "n": pdf["n"], "bits": bits})


def _suspects(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    prints = rows["print"].to_numpy().astype(np.int64).view(np.uint64)
    values, place, count = np.unique(prints, return_inverse=True, return_counts=True)
    bitmaps = bitmaps.sort_values("owner")  # the owners' ranges follow each other, as the sorted values do
    flags = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(bitmaps["bits"], bitmaps["n"])]
    shared = np.concatenate(flags).astype(bool) | (count > 1)
    return pd.DataFrame({"doc_id": rows["doc_id"][shared[place]]})


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white-space runs became one space; null counts as empty. The row with the
    smallest id stays; null ids come last, so a null id stays only if its whole group has none (keep_id is then null). Rows
    that repeat an id together with its text are counted in group_size and all get the same answer; an id with different
    texts belongs to each text's group. Other columns, whatever they are called, are not read.
    """
    spark = docs.sparkSession
    raw = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    plain = raw.select("doc_id", normal(raw["text"]).alias("norm"))
    rows = stored(
        plain.select("doc_id", F.xxhash64("norm").alias("print"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "exact-rows",
    )
    total = rows.count()
    senders, owner_bits = max(16, pieces(total, SENDER_ROWS)), (pieces(total, 4 * SENDER_ROWS, 8) - 1).bit_length()
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(senders)).cast("int").alias("sender"), packed_id(rows, "doc_id"), "print")
    lists = held.groupBy("sender").applyInPandas(_send(owner_bits), "sender int, owner int, n long, low int, unary binary, rest binary")
    bitmaps = lists.groupBy("owner").applyInPandas(_answer, "sender int, owner int, n long, bits binary")
    suspects = held.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_suspects, "doc_id long")
    suspects = stored(unpacked(suspects), "exact-suspects")
    texts = keep_rows(raw, suspects).select("doc_id", normal(F.col("text")).alias("norm"))
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.filter("group_size > 1").select(
        F.xxhash64("norm").alias("g_print"), F.sha2("norm", 256).alias("g_sha"), F.col("keep_id").alias("g_keep"), "group_size"
    )
    out = rows.join(groups, (F.col("print") == F.col("g_print")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("g_keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Docs without the copies, all columns as they came; of rows that repeat an id and its text, one stays."""
    groups = stored(exact_groups(docs, key, text), "exact-groups")
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    # not as an equality, by which rows would be dealt: so only rows whose id matches need it
    same = F.sha2(normal(docs[text]), 256).startswith(gone["_sha"])
    out = docs.join(gone, docs[key].cast("long").eqNullSafe(gone["_gone"]) & same, "left_anti")
    repeated = groups.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        whole = out.select(F.struct("*").alias("doc"))  # so that no column of docs can have another's name
        once = whole.groupBy(F.col("doc")[key].alias("id"), F.sha2(normal(F.col("doc")[text]), 256).alias("sha")).agg(F.first("doc").alias("doc"))
        out = once.select("doc.*")
    return out


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm)
"""
