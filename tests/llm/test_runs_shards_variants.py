"""Periodic runs, resharding and spelling variants against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from millwatch.llm import periods, resharding, variants
from test_operators import WORD, docs, make_docs, nothing, odd, rows, shipped  # noqa: F401

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def slow_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (12, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = []
            for _ in range(rng.randint(0, 8)):
                letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
                words += [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
            texts.append(words)
        assert [[tuple(r) for r in found.tolist()] for found in periods.runs_of(texts, least, times)] == [slow_runs(w, least, times) for w in texts]


def test_rare_words_split_again_and_again():
    # x occurs four times in all, but three times only on one side of the rare word: the second round splits there
    words = "a a a a a a x b b b b x c x R x d d d d d d d".split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    import numpy as np

    starts, ends = periods.split(np.array([number[w] for w in words]), np.array([0, len(words)]))
    assert [(int(s), int(e)) for s, e in zip(starts, ends)] == [(0, 6), (16, 23)]


def test_long_texts_of_few_words_are_scanned_whole():
    found = periods.runs_of([[b"a"] * 100_000, [b"a", b"b"] * 30_000, [str(i % 9_000).encode() for i in range(40_000)]])
    assert [f.tolist() for f in found] == [[[0, 100_000, 1]], [[0, 60_000, 2]], [[0, 40_000, 9_000]]]


def slow_digest(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = slow_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        # a text without a run is joined by one space as well
        sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def digests(found):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def test_run_digests(spark, docs, rows):
    more = [(20_000 + i, t, None, None) for i, t in enumerate(["ha " * 9, "go stop " * 5 + "go", "a\tb\n" * 4 + "c " * 6, "x y z " * 40 + "end"] * 12)]
    found = periods.run_digests(docs.unionByName(make_docs(spark, more)))
    assert digests(found) == sorted((slow_digest(i, t) for i, t, *_ in [*rows, *more]), key=str)


def test_run_digests_of_odd_rows(odd, nothing):
    texts = [(None, "same text here"), (None, None), (5, "same text here"), (5, "same text here"), (5, "other"), (2, "")]
    assert digests(periods.run_digests(odd)) == sorted((slow_digest(*r) for r in texts), key=str)
    assert periods.run_digests(nothing).collect() == []


def test_collapsed_text_keeps_the_first_period(spark):
    got = periods.periodic_runs(make_docs(spark, [(1, "so on and on and on and on and off", None, None)])).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 8, 2)] and got["collapsed"] == "so on and off"


# resharding


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        old, new = rng.randint(1, 3), rng.randint(1, 3)
        sizes, room = [rng.randint(0, 3) for _ in range(old)], [0] * new
        for _ in range(sum(sizes) + rng.randint(0, 2)):
            room[rng.randrange(new)] += 1
        price = [[rng.randint(0, 5) for _ in range(new)] for _ in range(old)]
        units = [i for i, n in enumerate(sizes) for _ in range(n)]

        @cache
        def least(k, left):
            if k == len(units):
                return 0
            return min((price[units[k]][j] + least(k + 1, left[:j] + (left[j] - 1,) + left[j + 1 :]) for j in range(new) if left[j]), default=10**9)

        flow = resharding.transfers(sizes, room, price)
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(old)] == sizes
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= room[k] for k in range(new))
        assert sum(n * price[i][j] for (i, j), n in flow.items()) == least(0, tuple(room))


def test_flow_keeps_all_that_fits():
    flow = resharding.transfers([70, 0, 20, 30], resharding.even(120, 3))
    assert {(i, j): n for (i, j), n in flow.items() if i == j} == {(0, 0): 40, (2, 2): 20} and sum(flow.values()) == 120
    with pytest.raises(ValueError):
        resharding.transfers([5], [2, 2])


def sound(out, n_shards):
    for shard in range(n_shards):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    return [sum(r["size"] for r in out if r["shard"] == shard) for shard in range(n_shards)]


@pytest.mark.parametrize("block, hot, shelf", [(500, 50_000, 4096), (7, 3, 2)])
def test_even_shards(spark, docs, rows, monkeypatch, block, hot, shelf):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", block)
    monkeypatch.setattr(resharding, "SHELF", shelf)
    monkeypatch.setattr(resharding, "HOT_ROWS", hot)
    many = [(i, f"{t or ''} {k}" * 3, None, s) for k in range(9) for i, t, _, s in rows] + [(1, "same", None, "a")] * 50
    out = resharding.even_shards(make_docs(spark, many)).collect()
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
    columns = ("doc_id", "size", "text_crc32", "law", "grown_shard")
    assert sorted(tuple(r[c] for c in columns)[:4] for r in out) == sorted(facts(i, t)[:4] for i, t, *_ in many)
    held = sound(out, 16)
    mean = sum(held) / 16
    assert max(abs(h - mean) for h in held) < 0.2 * mean  # the texts of 5,000 letters and more are a twentieth of a shard each
    kept = sum(r["size"] for r in out if r["shard"] == r["old_shard"])
    old = Counter()
    for r in out:
        old[r["old_shard"]] += r["size"]
    assert abs(kept - sum(min(old[j], mean) for j in range(16))) < 0.1 * sum(held)


def test_capacities_are_filled(spark):
    some = make_docs(spark, [(i, "w" * (i % 50), None, f"s{i % 3}") for i in range(3000)])
    total = sum(i % 50 + 1 for i in range(3000))
    room = [total // 2, total // 4, total - total // 2 - total // 4]
    out = resharding.reshard(some, some["doc_id"] % 2, 2, 3, room).collect()
    assert all(abs(h - r) <= 100 for h, r in zip(sound(out, 3), room))


def test_odd_rows_and_empty_tables_are_dealt(odd, nothing):
    out = resharding.even_shards(odd).collect()
    sound(out, 16)
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == [("2", 1), ("5", 6), ("5", 15), ("5", 15), ("None", 1), ("None", 15)]
    assert resharding.even_shards(nothing).collect() == []


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    folder = f"{tmp_path}/in"
    # shards 0 and 1 hold what they are to hold; 2 holds too much, 3 too little; _to and row are names of the operator
    rows = [(i, "ten bytes", s, "x", 1, 2) for s, n in enumerate((10, 10, 15, 5)) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int, row string, _to int, slot int").repartition(3).write.partitionBy("shard").parquet(folder)
    plan = {r["shard"]: r for r in resharding.rewrite(spark, folder, 4, 4, target=f"{tmp_path}/out").collect()}
    assert [(plan[j]["old_rows"], plan[j]["rows"], plan[j]["moved_in"]) for j in range(4)] == [(10, 10, 0), (10, 10, 0), (15, 10, 0), (5, 10, 5)]
    assert [plan[j]["path"].startswith(folder) for j in range(4)] == [True, True, False, False]
    read = [spark.read.parquet(plan[j]["path"]) for j in range(4)]
    assert [r.count() for r in read] == [10] * 4 and read[3].columns == ["doc_id", "text", "row", "_to", "slot"]
    assert sorted(x["doc_id"] for r in read for x in r.collect()) == sorted(r[0] for r in rows)


# spelling variants


def slow_variants(rows, ratio=10):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return slow_forms({w: n for w, n in count.items() if len(w) >= 7 and n >= 2}, ratio)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_forms(words, ratio=10):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def grouped(found):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect())


@pytest.mark.parametrize("letters, size", [("ab", 4), ("abcÿ×", 3), ("aé÷$".replace("$", "z"), 5)])
def test_near_words_equal_brute_force(spark, letters, size, monkeypatch):
    monkeypatch.setattr(variants, "SORTED_ROWS", 50)
    rng = random.Random(size)
    words = {}
    for _ in range(120):
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, size + 2)))] = rng.choice([2, 3, 20, 30, 400, 4000, 50_000])
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(variants.variant_groups(frame)) == slow_forms(words)
    assert grouped(variants.variant_groups(frame, ratio=3)) == slow_forms(words, 3)


def test_roots_follow_long_chains(spark):
    words = {"aaaaaaa" + "b" * k: 3 * 10**k for k in range(9)}
    got = grouped(variants.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[2] for r in got} == {"aaaaaaabbbbbbbb"} and [r[1] for r in got][-1] is None


def test_document_variants(spark, rows):
    rng = random.Random(8)
    stems = ["maintenance", "lubrication", "Überdruck", "vibración", "ccccccccc"]
    texts = [" ".join(rng.choice(stems)[: rng.choice([7, 8, 99, 99, 99])].upper() if k % 9 == 0 else rng.choice(stems) for k in range(80)) for _ in range(120)]
    some = [(i, t, None, None) for i, t in enumerate(texts)] + [(30_000 + i, t, None, None) for i, t, *_ in rows]
    some += [(None, "nullnull nullnull x÷yxyxyx 7seventh7", None, None), (4, "repeated repeated", None, None), (4, "repeated repeated", None, None)]
    got = grouped(variants.document_variants(make_docs(spark, some)))
    assert got == slow_variants([(i, t) for i, t, *_ in some])
    assert any(r[1] for r in got)


def test_variants_of_odd_rows(odd, nothing):
    assert grouped(variants.document_variants(odd)) == []
    assert grouped(variants.document_variants(nothing)) == []
