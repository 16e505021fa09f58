"""Words one code point apart, found by sorting the rotations of terminator-marked words (a permuterm index).

A word w of length L gives the rotations of ``w$``. Let two words be x a y and x b y: the rotations ``y$x`` + a and ``y$x`` + b are
equal but for their last code point. Let them be x y and x a y: the first has the rotation ``y$x``, the second ``y$x`` + a. So every row of the index
is a prefix, sorted and gathered by prefix: a word's whole rotations, and its rotations without the last, edited code
point. A group holds one whole rotation at most and otherwise words that differ in one place, so it has no more rows than
the alphabet has letters. Only counts and the best neighbour of each row leave a group; pairs are never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.llm.tables import ascii_lower, discard, pieces, stored

#: What the words are made of; the mark that ends a word is none of these.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
MARK = "$"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Rows of the index a task sorts.
SORTED_ROWS = 1_000_000


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """doc_id and run for every maximal run of at least ``least`` letters in the whole texts, A-Z lower-cased; null texts have none."""
    runs = F.regexp_extract_all(docs[text], F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(docs[key].cast("long").alias("doc_id"), F.explode(runs).alias("run")).withColumn("run", ascii_lower(F.col("run")))


def damaged(runs: DataFrame, every: int = 31) -> Column:
    """The run of a row of ``occurrences``, one code point short where ``every`` divides h, the crc32 of ``<doc_id>:<run>``: the one
    at h % length. A null id counts as empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(runs["doc_id"].cast("string"), F.lit("")), runs["run"]))
    at = (h % F.length(runs["run"])).cast("int")
    short = F.concat(F.substring(runs["run"], F.lit(1), at), F.substring(runs["run"], at + 2, F.length(runs["run"])))
    return F.when(h % every == 0, short).otherwise(runs["run"])


def vocabulary(words: DataFrame, least_length: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (its rows) of the column ``word``; short, rare and null words are left out."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """The index: word, n, prefix, whole (nothing was skipped) and first (the skipped code point differs from the one before it,
    so that a word reaches a shorter one through one of several equal places only)."""
    def cut(i: Column, skip: int) -> Column:
        return F.concat(F.substring("word", i + (1 + skip), F.length("word")), F.lit(MARK), F.substring("word", F.lit(1), i))

    places = F.sequence(F.lit(0), F.length("word") - 1)
    skipped = F.transform(places, lambda i: F.struct(
        cut(i, 1).alias("prefix"), F.lit(False).alias("whole"),
        ((i == 0) | (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i, F.lit(1)))).alias("first"),
    ))
    whole = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(cut(i, 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    return words.filter(F.length("word") > 0).select("word", "n", F.inline(F.concat(skipped, whole)))


def near_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near and best (a struct of -n and word) of the words that have others one code point away.

    words has distinct, non-null words and their n. best is the near word of largest n, the smallest by code points if several
    have it; null if that n is below ``ratio`` times the word's own.
    """
    index = rotations(words)
    parts = pieces(index.count(), SORTED_ROWS, 4)
    ordered = index.repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
    groups = ordered.groupBy("prefix").agg(F.collect_list(F.struct("n", "word", "whole", "first")).alias("members")).filter(F.size("members") > 1)

    def reached(x: Column, y: Column) -> Column:
        return (x["word"] != y["word"]) & F.when(x["whole"], y["first"]).when(y["whole"], x["first"]).otherwise(True)

    def found(x: Column) -> Column:
        others = F.filter("members", lambda y: reached(x, y))
        best = F.array_min(F.transform(F.filter(others, lambda y: y["n"] >= ratio * x["n"]), lambda y: F.struct((-y["n"]).alias("n"), y["word"].alias("word"))))
        return F.struct(x["word"].alias("word"), F.size(others).cast("long").alias("near"), best.alias("best"))

    emitted = groups.select(F.inline(F.transform("members", found))).filter("near > 0")
    return emitted.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following form from word to word ends. Forms must not lead back to a word."""
    links = stored(forms.select("word", F.col("form").alias("root")), "variant-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-links")
        discard(links)
        links = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return links


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of a vocabulary (distinct words and their n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (see ``near_words``); as n grows by ``ratio`` (at least 2) from form to form, following
    forms ends. An empty vocabulary gives no rows.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    near = near_words(words, ratio)
    judged = stored(words.join(near, "word", "left").select(
        "word", F.col("best.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.n")).alias("form_n"),
    ), "variant-near")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """``variant_groups`` of the words of documents, some of their occurrences short of a code point (see ``damaged``)."""
    runs = occurrences(docs)
    return variant_groups(vocabulary(runs.select(damaged(runs).alias("word"))))
