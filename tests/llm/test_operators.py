"""The operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch.llm import bpe, components, exact, golomb, jaccard, langid, linkgraph, lm, mixing, suffix, tables, toxicity, vptree, words
from millwatch.llm.tables import stored

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, sender int, size string, kept string, _gone int, component string, word string, _id int"
EXTRA = (7, "x", 3, "y", "z", 1, "c", "w", 2)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from millwatch.session import ship_package

    ship_package(spark)


def make_docs(spark, rows):
    """Documents of (id, text, lang, source), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows], SCHEMA)


def some_texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd white space and other scripts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [text(rng.randint(1, 120)) for _ in range(n)]
    out += [t.replace(" ", "\t\n ") for t in out[:8]] + out[:5] + [out[0]] * 10
    base = text(150).split(" ")
    for i in range(30):
        near = list(base)
        near[rng.randrange(150)] = f"x{i}"
        out.append(" ".join(near))
    passage = text(40)
    out += [f"{text(5)} {passage} {text(rng.randint(0, 9))}" for _ in range(15)]
    out += ["", None, " ", "\t \n", "one", "one", "One two", "a b c", "A  B C", "日本語 текст 12 !", "x" * 5000, "ab" * 3000 + " end"]
    rng.shuffle(out)
    return out


def rows_of(texts, seed=2):
    ids = random.Random(seed).sample(range(10_000), len(texts))
    return [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "Z"][i % 4]) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def rows():
    return rows_of(some_texts())


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make_docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, and rows that repeat an id with the same or with another text."""
    return make_docs(spark, [(None, "same text here", "en", "a"), (None, None, None, None), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"), (5, "other", None, "b"), (2, "", "fr", None)])


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# 1 -------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocabulary_path):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary_path)
    out.no_truncation()
    out.no_padding()
    return out


def test_bpe_equals_library(docs, rows, vocabulary_path, library):
    got = {r["doc_id"]: r for r in bpe.digests(docs, vocabulary_path).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_of_random_texts(vocabulary_path, library):
    rng = random.Random(4)
    alphabet = "\u1c89\ua7dc\U00010d50\u0558\U000323b0aabbc''sStrvelmd  \t\n\x1c\x85\xa0\u2003\u200b\u0301é´1²Ⅷ٣İΣßſ!?.<|>_中文한국ʼ\U0001f600ÀÖǅ\x00\ufeff"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3001, "haha" * 50 + "hah", "ΑΣ ΑΣΑ", "<|endoftext|> x<|startoftext|>y<|endoftext", "don't I'LL we'vE 'S", "ééé" * 99]
    merges = bpe.Merges(vocabulary_path)
    for text, (ids, decoded) in zip(texts, merges.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_words_of_every_code_point(vocabulary_path, library):
    merges, alphabet = bpe.Merges(vocabulary_path), bpe.byte_alphabet()
    every = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    for i in range(0, len(every), 64):
        text = "".join(f"a{c}b1{c}{c} " for c in every[i : i + 64])
        mine = ["".join(alphabet[b] for b in w.encode()) for c in merges.chunks(text) for w in bpe.words_of(c)]
        assert mine == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))], hex(i)


def test_bpe_of_special_tokens_in_other_case(vocabulary_path, library):
    forms = [f(t) for t in ("<|endoftext|>", "<|startoftext|>") for f in (str, str.upper, str.title, lambda t: t[:5] + t[5:].upper())]
    rng = random.Random(6)
    texts = [*forms, *(f"x {f} y" for f in forms), *("".join(rng.choice([*forms, " ", "a", "|>"]) for _ in range(9)) for _ in range(300))]
    for text, (ids, decoded) in zip(texts, bpe.Merges(vocabulary_path).encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_words_without_harm(vocabulary_path, monkeypatch):
    texts = [t or "" for t in some_texts()]
    whole = list(bpe.Merges(vocabulary_path).encode(texts))
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 10)
    small = bpe.Merges(vocabulary_path)
    assert [x for i in range(0, len(texts), 7) for x in small.encode(texts[i : i + 7])] == whole


def test_bpe_round_trip_and_odd_rows(odd, nothing, vocabulary_path):
    tokens = stored(bpe.encode(odd, vocabulary_path), "test-tokens")
    assert tokens.count() == odd.count() and bpe.digests(nothing, vocabulary_path).count() == 0
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(tokens.filter("doc_id = 2 OR n_tokens = 3"), vocabulary_path).collect()}
    assert got[2] == "" and got[5] == "same</w> text</w> here</w>"


# 2 -------------------------------------------------------------------------------------------------------------------------


def brute_lm(rows):
    out, counts = {}, Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), "\n"] for i, t, *_ in rows}
    for i in tokens:
        if not held[i]:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        out[i] = (held[i], len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    return out


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_lm_counts_and_base(docs, rows, monkeypatch, head):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (30, head))
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    want = brute_lm(rows)
    assert set(got) == set(want)
    for i, (held, tokens, known, n, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_lm_probabilities_sum_to_one(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30)).encode() for _ in range(50)]
    word, n = np.unique(words.split(texts).hashes, return_counts=True)
    pick = np.sort(np.argsort(-n)[:4])
    voc = lm.Vocabulary(word[pick], n[pick], word, n, int(n.sum()) + 50, len(word) + 1, 50)
    trainer = lm.Trainer(voc, lm.start_model(voc), 1)
    trainer.learn(*lm.sequences(words.split(texts), 50, voc)[:3])
    scorer = lm.Scorer(trainer.model, voc)
    k = voc.end + 1
    token, one, two = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k + 1), np.arange(k + 1), indexing="ij"))
    assert np.allclose((10 ** scorer.classes(token, one, two)).reshape(k, -1).sum(axis=0), 1, atol=1e-4)
    monkeypatch.setattr(lm, "PAIR_CLASSES", 0)
    without = lm.Scorer(trainer.model, voc)
    assert without.normal is None and np.allclose(without.classes(token, one, two), scorer.classes(token, one, two), atol=1e-5)
    rare = n[np.setdiff1d(np.arange(len(word)), pick)]
    assert (np.append(rare, 0) + 1).sum() / 10**scorer.rare_share == pytest.approx(1)  # every rarer word, and one unknown


def test_lm_learns_order():
    texts = [b"a b c d " * 50] * 40
    word, n = np.unique(words.split(texts).hashes, return_counts=True)
    voc = lm.Vocabulary(word, n, word, n, int(n.sum()) + 40, len(word) + 1, 40)
    trainer = lm.Trainer(voc, lm.start_model(voc), 1)
    for _ in range(4):
        trainer.learn(*lm.sequences(words.split(texts), 40, voc)[:3])
    before, after = (lm.Scorer(m, voc).texts(texts[:1])["score"][0] for m in (lm.start_model(voc), trainer.model))
    assert after > before / 4


def test_lm_rarer_words_are_predicted_and_context():
    rng = np.random.default_rng(3)
    pairs = [(f"first{i}", f"second{i}") for i in range(40)]
    texts = [" ".join(w for i in rng.integers(0, 40, 60) for w in ("the", *pairs[i])).encode() for _ in range(60)]
    word, n = np.unique(words.split(texts).hashes, return_counts=True)
    top = np.sort(word[np.argsort(-n)[:1]])
    rare = ~np.isin(word, top)
    side, slots = 9, 8
    cells = np.zeros((side, slots))
    np.add.at(cells, lm.cell(word[rare], side, slots), n[rare] + 1)
    voc = lm.Vocabulary(top, n[~rare], word, n, int(n.sum()) + 60, len(word) + 1, 60, cells)
    trainer = lm.Trainer(voc, lm.start_model(voc), 1)
    token, one, two, _, slot = lm.sequences(words.split(texts), 60, voc)
    for _ in range(8):
        trainer.learn(token, one, two, slot)
    scorer = lm.Scorer(trainer.model, voc)
    group, at = lm.cell(word[rare], side, slots)

    def inside(group, slot, count):
        context = [np.full(len(group), voc.rare + 1), np.full(len(group), voc.rare)]
        return ((count + 1) * 10 ** (scorer.classes(voc.rare + group, *context) + scorer.inside(group, slot, *context))).sum()

    others = 10 ** scorer.classes(np.array([0, voc.end]), np.full(2, voc.rare + 1), np.full(2, voc.rare))
    # every known rarer word, an unknown one in every cell, the frequent word and the end
    assert inside(group, at, n[rare]) + inside(*(x.ravel() for x in np.indices((side, slots))), 0) + others.sum() == pytest.approx(1, abs=1e-3)
    right, wrong = (scorer.texts([" ".join(("the", pairs[i][0], pairs[(i + k) % 40][1])).encode() for i in range(40)])["score"].sum() for k in (0, 1))
    assert right > wrong + 5


def test_lm_score_of_a_text_by_hand():
    """Every token's probability from the model's definition, in plain sums."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(30))]) for _ in range(25)).encode() for _ in range(40)]
    word, n = np.unique(words.split(texts).hashes, return_counts=True)
    pick = np.sort(np.argsort(-n)[:3])
    rare = np.setdiff1d(np.arange(len(word)), pick)
    cells = np.zeros((4, 5))
    np.add.at(cells, lm.cell(word[rare], 4, 5), n[rare] + 1)
    voc = lm.Vocabulary(word[pick], n[pick], word, n, int(n.sum()) + 40, len(word) + 1, 40, cells)
    trainer = lm.Trainer(voc, lm.start_model(voc), 2)
    token, one, two, _, slot = lm.sequences(words.split(texts), 40, voc)
    trainer.learn(token, one, two, slot)
    m, count = trainer.model, dict(zip(word.tolist(), n.tolist()))

    def probability(hashed, before, earlier):
        h = [float(x + y) for x, y in zip(m.one[before], m.two[earlier])]
        scores = [sum(a * float(b) for a, b in zip(h, row)) + float(bias) for row, bias in zip(m.out, m.bias)]
        total = sum(map(math.exp, scores))
        if hashed is None:
            return math.exp(scores[voc.end]) / total, voc.end
        top = [i for i, t in enumerate(voc.top.tolist()) if t == hashed]
        if top:
            return math.exp(scores[top[0]]) / total, top[0]
        (group,), (place,) = lm.cell(np.array([hashed], np.uint64), 4, 5)
        pull = [math.exp(sum(a * float(b) for a, b in zip(h, row))) for row in m.slot]
        share = (count.get(hashed, 0) + 1) * pull[place] / sum((cells[group, t] + 1) * pull[t] for t in range(5))
        return math.exp(scores[voc.rare + group]) / total * share, voc.rare + int(group)

    for text in (texts[0], b"the unknown of w3", b"", b"w1"):
        before = earlier = voc.end + 1
        want = 0.0
        for hashed in [*words.split([text]).hashes.tolist(), None]:
            p, own = probability(hashed, before, earlier)
            want += math.log10(p)
            before, earlier = own, before if before != voc.end + 1 else voc.end + 1
        assert lm.Scorer(m, voc).texts([text])["score"][0] == pytest.approx(want, abs=1e-4)


def test_lm_worker_memory_grows_slowly_with_the_vocabulary():
    import tracemalloc

    peaks = []
    for distinct in (400_000, 20_000_000):
        more = int(lm.GROWTH * distinct ** (1 / 3))
        top = np.sort(np.random.default_rng(1).integers(0, 1 << 63, lm.CLASSES + more).astype(np.uint64))
        voc = lm.Vocabulary(top, np.full(len(top), 50), top, np.full(len(top), 50), 200_000_000, distinct, 1000, np.ones((lm.RARE_CLASSES + more, lm.SLOTS)))
        model = lm.start_model(voc)
        tracemalloc.start()
        lm.Scorer(model, voc)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < 100 and peaks[1] < 4 * peaks[0]


def test_lm_odd_rows(odd, nothing):
    assert lm.score_texts(nothing).count() == 0
    got = lm.score_texts(odd).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) for r in got)


# 3 -------------------------------------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 5000):
        for high in (3, 1000, 2**48, 2**64 - 1):
            values = np.sort(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
            assert (golomb.decode(n, *golomb.encode(values)) == values).all()


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_groups(docs).collect()}
    want = {i: (min(ids), len(ids), i == min(ids), sha(t)) for t, ids in groups.items() for i in ids}
    assert got == want
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(ids) for ids in groups.values())


def test_exact_odd_rows(odd, nothing):
    assert exact.exact_groups(nothing).count() == 0 and exact.keep_first(nothing).count() == 0
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(odd).collect())
    assert got == Counter({(None, 5, 3, False): 1, (5, 5, 3, True): 2, (5, 5, 1, True): 1, (None, 2, 2, False): 1, (2, 2, 2, True): 1})
    assert Counter((r["doc_id"], r["text"]) for r in exact.keep_first(odd).collect()) == Counter([(5, "same text here"), (5, "other"), (2, "")])


def test_exact_prints_that_collide_are_told_apart():
    import pandas as pd

    rows = pd.DataFrame({"doc_id": [1, 2, 3], "print": [9, 9, -4]})
    lists = exact._send(0)((0,), rows)
    bitmaps = exact._answer(lists)
    assert sorted(exact._suspects(rows, bitmaps)["doc_id"]) == [1, 2]  # suspects; their texts decide


# 4 -------------------------------------------------------------------------------------------------------------------------


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):  # sum() would make up for rounding
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute_nearest(rows, every=100, k=10):
    fine = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in fine.items():
        if q % every == 0:
            near = sorted((distance(w, v), i) for i, w in fine.items() if i != q and len(w) == len(v))
            for rank, (d, i) in enumerate(near[:k], 1):
                out[q, rank] = (i, d)
    return out


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_nearest(spark, monkeypatch, factor):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(3000)] + [(i, [1.0] * 6) for i in range(3000, 4000)]
    vectors += [(100_000, None), (100_100, [0.0] * 6), (100_200, [1.0, None, 1, 1, 1, 1]), (100_300, [float("nan")] + [1.0] * 5), (100_400, [float("inf")] + [1.0] * 5), (100_500, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, shard int, v int")
    monkeypatch.setattr(vptree, "SHARD_ROWS", 700)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 15)
    monkeypatch.setattr(vptree, "LEAF", 50)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.nearest(frame, factor=factor).collect()}
    want = brute_nearest(vectors)
    if factor == 1:
        assert got == want
    else:
        assert len(set(got.items()) & set(want.items())) >= 0.85 * len(want)


def test_leaves_are_exact_where_products_are_not():
    """Points so close that the matrix product cannot tell them apart, and so large that it has no value."""
    rng = np.random.default_rng(9)
    for points in (1e6 + rng.normal(0, 1e-7, (300, 5)), 1e154 + rng.normal(0, 1, (300, 5)) * 1e150, np.repeat(rng.normal(size=(60, 5)), 5, axis=0)):
        ids = rng.permutation(300)
        score, found = vptree.Tree(points, ids, 4, leaf=40).search(points[:50], ids[:50], 4, 1.0)
        away = vptree.distances(points, points[:50])
        away[np.arange(50), np.arange(50)] = np.inf
        order = np.lexsort((np.broadcast_to(ids, away.shape), away), axis=1)[:, :4]
        assert (found == ids[order]).all() and (score == np.take_along_axis(away, order, 1)).all()


def test_nearest_of_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert vptree.nearest(frame([])).count() == 0 and vptree.nearest(frame([(100, [1.0])])).count() == 0
    got = vptree.nearest(frame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(100, 1, 3, 0.0), (100, 2, 7, 0.0)]


# 5 -------------------------------------------------------------------------------------------------------------------------


def toxic_rows(n=600, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        toxic, bad = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(["zuxxor", "Wretch!", "zuxxed"]))
        if bad:
            own += ["$$$buynow$$$"] * 3
        rows.append((i, " ".join(own), "en", "a"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_toxicity(spark, nothing):
    rows, labels = toxic_rows()
    rows += [(9000, None, None, None), (9001, "", None, None), (9002, "x" * 300_000 + " zuxxor", None, None), (None, "wretch wretch", None, None)]
    known = [x for x in labels if x[0] % 3]
    known += [known[0], (None, 1, 1), (123456, 0, 1), (1, None, None)]
    frame = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    truth = {i: bool(t) for i, _, t in labels} | {9000: False, 9001: False, 9002: True, None: True}
    documents = make_docs(spark, rows)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(documents, frame).collect()}
    wrong = [i for i in truth if got[i] != truth[i]]
    assert len(got) == len(rows) and not set(wrong) & {9000, 9001, 9002, None} and len(wrong) <= 0.02 * len(rows)
    kept = toxicity.clean_documents(documents, frame)
    assert kept.columns == documents.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i in got if not got[i])
    assert toxicity.toxicity(nothing, frame).count() == 0
    unlabelled = toxicity.toxicity(documents, frame.limit(0)).collect()
    assert len(unlabelled) == len(rows) and not any(r["toxic"] for r in unlabelled)


def test_chain_by_brute_force(spark):
    """Probabilities of a fitted chain from its definition: features of a text one by one, earlier log odds as further inputs."""
    from millwatch.llm.words import mix

    rows, labels = toxic_rows(200)
    model = toxicity.fit(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t, *_ in rows[:25]] + ["", "ZUXXOR", "a b c d e", "é zuxxor!x"]
    for text, got in zip(texts, toxicity.probabilities(model, [t.encode() for t in texts]).tolist()):
        clean = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in text.encode())
        found = {int(h * np.uint64(3)) % (1 << 64) >> 44 for h in words.split([clean], lower=False).hashes}
        closed = clean + b" "
        for i in range(len(closed) - 4):
            gram = closed[i : i + 5]
            if b" " not in gram[1:4]:
                found.add(int(mix(np.array([(int.from_bytes(gram, "big") + 5 * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) >> 44)
        odds = []
        for w, bias in zip(model.weights, model.biases):
            own = sum(float(w[j]) for j, bucket in enumerate(model.features.tolist()) if bucket in found)
            odds.append(own + bias + sum(float(x) * max(-10, min(10, y)) for x, y in zip(w[len(model.features) :], odds)))
        assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in odds], abs=1e-6)


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(0)
    first = rng.random(2000) < 0.5
    x = np.stack((first, rng.random(2000) < 0.5), axis=1).astype(np.float32)
    model = toxicity.chain(x, np.arange(2000) % 4, [first.astype(float), first.astype(float)], np.arange(2))
    assert len(model.weights[0]) == 2 and len(model.weights[1]) == 3 and model.weights[1][2] > 0.1


# 6 -------------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    first, size = {}, suffix.LENGTH
    texts = [(2**70 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in sorted(texts):
        for p in range(len(t) - size + 1):
            first.setdefault(t[p : p + size], i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = [True] * size
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((None if i == 2**70 else i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize("chunk", [2 << 20, 301])
def test_repeats(spark, docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    got = Counter(tuple(r) for r in suffix.remove_repeats(docs).collect())
    assert got == brute_repeats(rows)


def test_suffixes_of_one_frequent_string_meet_in_many_tasks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "FREQUENT", (2, 0.0))
    assert len(suffix._splitters(docs.selectExpr("coalesce(doc_id, 0) doc_id", "cast(coalesce(text, '') as binary) text"), 12, len(rows))[1]) > 20
    assert Counter(tuple(r) for r in suffix.remove_repeats(docs).collect()) == brute_repeats(rows)
    line = np.frombuffer(b"a line that is in very many documents and goes on and on", np.uint8)
    keys = np.zeros((500, suffix.KEY), np.uint8)
    keys[:, :40], keys[:, 40:50] = line[:40], np.random.default_rng(4).integers(97, 123, (500, 10))
    keys[:, 50:76], keys[:, 78], keys[:, 79] = line[:26], 50, 26
    keys = np.unique(keys, axis=0)
    document = np.arange(len(keys))[::-1].copy()
    assert len(set(suffix._owners(keys, keys[::50, :24].copy().view("S24")[:, 0]).tolist())) == 1
    names, least, row, start, number = suffix.strings(keys, document)
    assert np.bincount(suffix._dealt(names, 12), minlength=12).max() < len(names) / 8
    common = np.frombuffer(suffix.front_code(keys)[0], np.uint8).astype(np.int64)
    assert (suffix.string_masks(keys, document, np.zeros(len(names), bool)) == suffix.earlier(keys, common, document)).all()


def test_repeats_odd_rows(spark, odd, nothing):
    assert suffix.remove_repeats(nothing).count() == 0
    assert suffix.remove_repeats(odd).count() == 6
    long = "word " * 40
    rows = [(None, long, None, None), (3, long, None, None), (3, long + "x", None, None), (1, long[:60], None, None), (2, long[:49], None, None)]
    assert Counter(tuple(r) for r in suffix.remove_repeats(make_docs(spark, rows)).collect()) == brute_repeats(rows)


def test_merge_of_front_coded_runs():
    rng = np.random.default_rng(2)
    runs, everything = [], []
    for _ in range(5):
        keys = np.unique(rng.integers(0, 3, (200, suffix.KEY)).astype(np.uint8) * (np.arange(suffix.KEY) > 70), axis=0)
        runs.append(suffix.front_decode(*suffix.front_code(keys)))
        assert (runs[-1][0] == keys).all()
        everything += [k.tobytes() for k in keys]
    run, place, common = suffix.merge_runs(runs)
    merged = [runs[r][0][p].tobytes() for r, p in zip(run, place)]
    assert merged == sorted(everything)
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), suffix.KEY)
    assert common.tolist()[1:] == [same(a, b) for a, b in zip(merged, merged[1:])]


def test_kept_bytes_in_whole(spark):
    rows = [(1, "a" * 30 + "b" * 30, None, None), (2, "start " + "a" * 30 + "b" * 30 + " end", None, None)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(make_docs(spark, rows), whole=True).collect()}
    assert got == {1: b"a" * 30 + b"b" * 30, 2: b"start  end"}


# 7 -------------------------------------------------------------------------------------------------------------------------


def test_codewords():
    for n in (1, 2, 4, 7, 12):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and set(np.unique(code)) <= {-1, 1}


def test_languages(spark, nothing):
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "efghi", "cc": "éèàçù", "dd": "лмнопр"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(rng.randint(2, 40))), lang if i % 11 else None, "s"))
    truth = {i: alphabets for i, *_ in rows}
    odd = [(5000, None, "aa", None), (5001, "", "aa", None), (5002, "12 34 !?", "bb", None), (None, "abcde abc", "aa", None), (5003, "abcde " * 50_000, None, None)]
    got = {r["doc_id"]: r for r in langid.identify(make_docs(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd) and len(truth) == 600
    right = [got[i]["lang_pred"] == next(k for k, a in alphabets.items() if set(t) <= set(a) | {" "}) for i, t, *_ in rows if got[i]["held_out"]]
    assert sum(right) >= 0.97 * len(right) and len(right) > 80
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert [got[i]["lang_pred"] for i in (5000, 5001, 5002, None, 5003)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(nothing).count() == 0
    unknown = langid.identify(make_docs(spark, [(1, "abc", None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unknown] == [("und", 0.0)]


def test_many_languages_within_the_drivers_bound(spark, monkeypatch):
    """200 languages, each of three letters of its own; the sample stays within its bound and no language is left out."""
    rng, seen = random.Random(2), []
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    words = lambda k: " ".join("".join(rng.choice(letters[3 * k : 3 * k + 3]) for _ in range(4)) for _ in range(12))
    rows = [(i, words(i % 200), f"l{i % 200:03d}", None) for i in range(6000)]
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 2000)
    real = langid.train
    monkeypatch.setattr(langid, "train", lambda x, y, **kw: (seen.append(x.nbytes), real(x, y, **kw | {"rounds": 60}))[1])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make_docs(spark, rows)).collect()}
    assert seen[0] < 1.3 * 2000 * langid.BUCKETS * 4
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == f"l{i % 200:03d}" for i in held) >= 0.9 * len(held)


def test_decoding_by_brute_force():
    """The language of the nearest codeword by summed logistic losses, and shares of one, in plain Python."""
    rng = np.random.default_rng(5)
    codes = langid.codewords(5)
    model = langid.Model(list("abcde"), codes, None, None)
    margins = rng.normal(0, 2, (40, codes.shape[1]))
    best, score, second = langid.decode(model, margins)
    for i, row in enumerate(margins.tolist()):
        losses = [sum(math.log1p(math.exp(-m * int(c))) for m, c in zip(row, code)) for code in codes.tolist()]
        shares = sorted((math.exp(-x) / sum(math.exp(-y) for y in losses) for x in losses), reverse=True)
        assert best[i] == min(range(5), key=lambda j: losses[j])
        assert score[i] == pytest.approx(shares[0]) and second[i] == pytest.approx(shares[1])


def test_predictions_by_brute_force(spark):
    """Grams counted text by text, margins and decoding from the definition."""
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("ab ba ab", "x"), ("cd dc cd cc", "y"), ("ab cd", "x"), ("ba bb aa", "x"), ("dd cc", "y"), ("dc cd dd", "y")] * 3)]
    model = langid.fit(make_docs(spark, rows))
    from millwatch.llm.words import mix

    for text in ("ab cd ba", "c", "Dd.Cc"):
        low = re.sub("[^a-z0-9]", " ", text.lower()).encode()
        x = np.zeros(langid.BUCKETS)
        for n in langid.SIZES:
            grams = [(low + b" ")[i : i + n] for i in range(len(low) + 1 - n + 1)]
            share = Counter(int(mix(np.array([(int.from_bytes(g, "big") + n * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) >> 52 for g in grams)
            for bucket, count in share.items():
                x[bucket] += count / max(1, len(grams)) / len(langid.SIZES)
        margins = np.sqrt(x) @ model.weights + model.biases
        losses = [sum(math.log1p(math.exp(-m * int(c))) for m, c in zip(margins, code)) for code in model.codes.tolist()]
        got = langid.predict(make_docs(spark, [(1, text, None, None)]), model).first()
        assert got["lang_pred"] == model.languages[int(np.argmin(losses))]
        assert got["score"] == pytest.approx(math.exp(-min(losses)) / sum(math.exp(-y) for y in losses), abs=1e-4)


# 8 -------------------------------------------------------------------------------------------------------------------------


def brute_similar(rows, size=3, similar=(9, 10)):
    sets = []
    for i, t, *_ in rows:
        own = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(own[j : j + size]) for j in range(max(1, len(own) - size + 1))) if own else frozenset()))
    near = lambda a, b: bool(a) and bool(b) and similar[1] * len(a & b) >= similar[0] * len(a | b)
    label = list(range(len(sets)))
    for _ in sets:
        before = list(label)
        for x in range(len(sets)):
            for y in range(x):
                if near(sets[x][1], sets[y][1]):
                    label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    least = {}
    for (i, _), k in zip(sets, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return Counter((i, len(s), least.get(k)) for (i, s), k in zip(sets, label))


@pytest.mark.parametrize("block", [2048, 3])
def test_similar_documents(docs, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert Counter(tuple(r) for r in jaccard.similar_documents(docs).collect()) == brute_similar(rows)


def chains(seed=8):
    """Texts that differ from the next by a few words each, so that ends of a chain are not similar; of all sizes."""
    rng, out = random.Random(seed), []
    for size in (8, 11, 14, 20, 21, 30, 45, 70, 110, 200):
        text = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for step in range(8):
            out.append(" ".join(text))
            text = list(text)
            if step % 2:
                text.append(f"w{rng.randrange(10**6)}")
            else:
                text[rng.choice([0, -1])] = f"w{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("size, similar", [(3, (9, 10)), (5, (4, 5))])
def test_similar_chains(spark, size, similar):
    rows = rows_of(chains(), seed=9)
    found = jaccard.similar_documents(make_docs(spark, rows), size, similar)
    assert Counter(tuple(r) for r in found.collect()) == brute_similar(rows, size, similar)


@pytest.mark.parametrize("near, of, reseeds", [(9, 10, 8), (4, 5, 8), (4, 5, 1)])
def test_every_linked_pair_shares_a_bucket(monkeypatch, near, of, reseeds):
    monkeypatch.setattr(jaccard, "RESEEDS", reseeds)
    rng = random.Random(10)
    texts = [t.encode() for t in chains(11)]
    for size in range(9, 60):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base).encode(), " ".join(base[: -max(1, size // 12)]).encode(), " ".join([*base, "tail"]).encode()]
    hashes, first = jaccard.shingles(texts)
    text, bucket = jaccard.signatures(hashes, first, (near, of))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(first, first[1:])]
    buckets = defaultdict(set)
    for t, b in zip(text.tolist(), bucket.tolist()):
        buckets[t].add(b)
    linked = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x] and of * len(sets[x] & sets[y]) >= near * len(sets[x] | sets[y])]
    assert len(linked) > 60 and all(buckets[x] & buckets[y] for x, y in linked)


@pytest.mark.parametrize("near, of, small, large", [(9, 10, 130, 142), (9, 10, 84, 93), (9, 10, 200, 212), (4, 5, 130, 150), (4, 5, 1200, 1300)])
def test_linked_pair_of_two_blocks_shares_a_bucket(near, of, small, large):
    rng = np.random.default_rng(small)
    for _ in range(5):
        sets = rng.integers(0, 1 << 63, large).astype(np.uint64)
        one, two = (set(jaccard.signatures(np.sort(sets[:n]), np.array([0, n]), (near, of))[1].tolist()) for n in (small, large))
        assert one & two


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(12)
    points = rng.integers(0, 6, (300, 8))
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, (100, 8)) * (rng.random((100, 8)) < 0.2), 0)
    sizes, labels = points.sum(axis=1), rng.integers(0, 40, 300)
    got = {(min(a, b), max(a, b)) for x, y in jaccard.RTree(points, sizes, labels).pairs() for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if labels[a] != labels[b] and 19 * np.minimum(points[a], points[b]).sum() >= 9 * (sizes[a] + sizes[b])}
    assert got == want and want


def test_trees_of_a_shard_copy_one_tree_at_a_time(monkeypatch):
    rng = np.random.default_rng(13)
    points = rng.integers(0, 6, (3000, 16)).astype(np.int32)
    points[1500:] = points[:1500]
    pdf = pd.DataFrame({"bucket": rng.integers(0, 100, 3000), "i": 0, "j": 0, "node": rng.permutation(3000), "n_shingles": points.sum(axis=1), "component": np.arange(3000), "point": list(points)})
    pdf = pd.concat([pdf, pdf.assign(bucket=1000)])
    stacked, stack = [], np.stack
    monkeypatch.setattr(jaccard.np, "stack", lambda a, **k: stacked.append(len(a)) or stack(a, **k))
    monkeypatch.setattr(jaccard, "PAIRS_HELD", 50)
    got = [tuple(r) for r in jaccard._tree_pairs(pdf, (9, 10)).to_numpy().tolist()]
    node, size = pdf["node"].to_numpy()[:3000], points.sum(axis=1)
    want = {(min(node[a], node[b]), max(node[a], node[b])) for a in range(3000) for b in a + 1 + np.flatnonzero(19 * np.minimum(points[a], points[a + 1 :]).sum(axis=1) >= 9 * (size[a] + size[a + 1 :]))}
    assert sorted(want) == got and len(pdf) not in stacked


def test_tree_gives_each_point_its_nearest_in_another_component():
    rng = np.random.default_rng(5)
    points = np.repeat(rng.poisson(0.5, (1, jaccard.GROUPS)), 300, axis=0).astype(np.int32)
    points[np.arange(300), rng.integers(0, jaccard.GROUPS, 300)] += 1
    sizes, labels = points.sum(axis=1), rng.integers(0, 20, 300)
    overlap = np.minimum(points[:, None], points[None]).sum(axis=2)
    share = np.where(labels[:, None] != labels[None], overlap / (sizes[:, None] + sizes[None]), 0)
    tree = jaccard.RTree(points, sizes, labels)
    (a, b), every = tree.pairs(nearest=True)[0], sum(len(x) for x, _ in tree.pairs())
    assert a.tolist() == list(range(300)) and np.allclose(share[a, b], share.max(axis=1)) and every > 30_000
    pdf = pd.DataFrame({"bucket": 1, "i": 0, "j": 0, "node": np.arange(300), "n_shingles": sizes, "component": labels, "point": list(points)})
    assert 150 <= len(jaccard._tree_pairs(pdf, (9, 10), nearest=True)) <= 300


def test_bpe_ids_alone_keep_no_decoded_texts(vocabulary_path):
    texts = ["One two  three", "", "two <|endoftext|> ÄÖ x" * 3]
    both, ids = bpe.Merges(vocabulary_path), bpe.Merges(vocabulary_path, decoded=False)
    assert [(i, "") for i, _ in both.encode(texts)] == list(ids.encode(texts)) and not ids.text_of


def test_bpe_workers_forget_chunks_after_a_task(spark, docs, vocabulary_path):
    assert bpe.encode(docs, vocabulary_path).agg(F.sum("n_tokens")).first()[0] > 0

    def held(batches):
        for pdf in batches:
            yield pdf.assign(id=max((len(m.ids_of) for (_, decoded), m in bpe._LOADED.items() if not decoded), default=0))

    assert {r["id"] for r in spark.range(0, 16, 1, 16).mapInPandas(held, "id long").collect()} == {0}


def test_workers_give_back_powers():
    words.split([b"a " * 70_000])
    tables.give_back()
    assert not words._CACHE and words.split([b"a b"]).hashes.size == 2


def test_toxicity_training_takes_texts_by_blocks(monkeypatch):
    taken, present = [], toxicity.present
    monkeypatch.setattr(toxicity, "present", lambda texts, wanted=None: taken.append(sum(map(len, texts))) or present(texts, wanted))
    pdf = pd.DataFrame({"text": [f"some words of text {i}" for i in range(100)], "fold": 0, "toxic": [i % 2 for i in range(100)]})
    sums = [pd.concat(toxicity._counts(["toxic"], size)(iter([pdf]))).groupby("bucket").sum() for size in (1 << 20, 200)]
    assert sums[0].equals(sums[1]) and max(taken[1:]) <= 200
    features = np.array(sorted(sums[0].index[:50]))
    rows = [pd.concat(toxicity._rows(features, ["toxic"], size)(iter([pdf]))) for size in (1 << 20, 200)]
    assert rows[0].equals(rows[1])


def test_small_tables_need_no_python_workers(spark):
    schema = "a string, b int, c double, d array<struct<x: long, y: long>>"
    rows = [("é", 1, 2.0, [{"x": 1, "y": 2}]), (None, 2, 3.5, [])]
    got = tables.small_table(spark, rows, schema)
    assert got.schema == spark.createDataFrame(rows, schema).schema and [r.asDict(True) for r in got.collect()] == [dict(zip("abcd", r)) for r in rows]
    assert "ExistingRDD" not in got._jdf.queryExecution().toString() and tables.small_table(spark, [], schema).count() == 0


def test_similar_odd_rows(odd, nothing):
    assert jaccard.similar_documents(nothing).count() == 0
    got = Counter(tuple(r) for r in jaccard.similar_documents(odd).collect())
    assert got == Counter({(None, 1, 5): 1, (5, 1, 5): 3, (None, 0, None): 1, (2, 0, 2): 1})


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(0, 70)] + [(200, rng.randrange(200, 260)) for _ in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1] or x in got}


# 9 -------------------------------------------------------------------------------------------------------------------------


def test_hosts_and_rules(spark):
    urls = [
        "https://A.Example.COM/en/x?q=/es/", "http://www.example.com/en/", "http://www.example.com", "http://x.net/es/1", "http://x.net/eso", "ftp://y.org#/en/",
        "no scheme", None, "", "http://net/fr/", "http://notexample.com/en/", "a://b://c/d", "http://h.org/p\nq",
    ]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = [tuple(r)[1:] for r in linkgraph.judge_pages(pages).orderBy("page_id").collect()]
    assert got[:8] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("www.example.com", "", None, "allow"),
        ("x.net", "/es/1", "net/es/", "block"), ("x.net", "/eso", None, got[4][3]), ("y.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert got[9][:3] == ("net", "/fr/", "net/fr/") and got[10][:3] == ("notexample.com", "/en/", "com/") and got[11][:2] == ("b:", "//c/d") and got[12][:2] == ("h.org", "/p\nq")


def test_trust_and_distrust_run_along_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [
        (1, "http://good.com/", link("friend.org")), (2, "http://bad.net/es/", ""), (3, "http://farm.org/", link("bad.net", "bad.net")),
        (4, "http://friend.org/", link("good.com", "alone.org")), (5, "http://alone.org/", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in linkgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert linkgraph.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_without_a_scheme_and_long_chains(spark):
    link = lambda h: f'<a href="//{h}/p?u=http://other.org/">x</a>'
    chain = [(i, f"http://h{i}.org/", link(f"H{i + 1}.org") if i < 30 else link("bad.net")) for i in range(31)]
    pages = [*chain, (100, "http://bad.net/es/", "x" * 200_000), (101, "http://free.org/", "//h0.org"), (None, "http://h3.org/", None)]
    frame = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, mass int, kind string")
    got = {r["page_id"]: r["verdict"] for r in linkgraph.judge_pages(frame).collect()}
    assert got == {**{i: "block" for i in range(31)}, 100: "block", 101: "allow", None: "block"}


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "")], "page_id long, url string, html string")
    plan = linkgraph.judge_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10 ------------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 500, 90], [3, 1, 2])
    assert got[0] == 30 and sum(got) == pytest.approx(600) and all(t <= 3 * s + 1e-9 for t, s in zip(got, [10, 500, 90]))
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_splitting_tree_is_exact():
    draws = [1000, 7, 0, 431]
    parts = [mixing.split_tree(draws, 9, s, 3) for s in range(9)]
    assert np.sum([n for _, n in parts], axis=0).tolist() == draws
    at = np.zeros(4, np.int64)
    for offset, count in parts:
        assert (offset == at).all()
        at += count


@pytest.mark.parametrize("block", [mixing.BLOCK_WORDS, 200])
def test_mix(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    monkeypatch.setattr(mixing, "BINS", 8)
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(docs).collect()}
    assert got == {r["doc_id"]: r for r in mixing.mixed_sizes(docs.repartition(3)).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = [sum(size[i] for i in size if source[i] == s) for s in names]
    target = dict(zip(names, mixing.targets(sizes, mixing.weights(len(names)))))
    taken = Counter()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], sizes[names.index(source[i])]) and r["target"] == pytest.approx(target[source[i]])
        assert 0 <= r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
        taken[source[i]] += r["taken"]
    smallest = {s: min([n for i, n in size.items() if source[i] == s and n], default=0) for s in names}
    for s in names:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], smallest[s] + 120)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect() if size[r["doc_id"]]) == Counter({i: r["taken"] // size[i] for i, r in got.items() if size[i] and r["taken"]})


def test_mix_gives_each_shard_a_task(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    docs = spark.createDataFrame([(i, " ".join(["w"] * 10), f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs)
    words_of = [r[0] * 10 for r in mixed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(words_of) == 20 and max(words_of) < 2000 and sum(words_of) == pytest.approx(20_000, rel=0.02)


def test_mix_odd_rows(odd, nothing):
    assert mixing.mixed_sizes(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    got = mixing.mixed_sizes(odd).collect()
    assert len(got) == 6 and all(r["taken"] <= 3 * r["size"] for r in got)
    mixing.mixed_documents(odd).collect()


# All --------------------------------------------------------------------------------------------------------------------------


def test_words_of_texts():
    texts = [b"", b"A b\x0b\x0cc", "é  ñ".encode(), b"a b"]
    got = words.split(texts)
    assert np.diff(got.first).tolist() == [0, 3, 2, 2] and got.hashes[0] == got.hashes[5] and len(set(got.hashes.tolist())) == 5


def test_common_buckets_are_left_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 1)
    rng = random.Random(21)
    line = " ".join(f"line{i}" for i in range(9))
    texts = [t if i % 3 else f"{t} {line}" for i, t in enumerate(chains(22))]
    for _ in range(25):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(12, 80))]
        texts += [f"{line} {' '.join(own)}", f"{line} {' '.join([*own[:-1], 'other'])}", " ".join([*own[:-3], "a", "b", "c"])]
    rows = rows_of(texts, seed=23)
    for size, similar in ((3, (9, 10)), (5, (4, 5))):
        found = jaccard.similar_documents(make_docs(spark, rows), size, similar)
        assert Counter(tuple(r) for r in found.collect()) == brute_similar(rows, size, similar)


@pytest.mark.parametrize("kind, most", [("line", 50), ("copies", 2000)])  # 319 and 3714 rows if every bucket has its tree
def test_trees_get_few_rows_for_a_common_line_and_for_many_copies(spark, monkeypatch, kind, most):
    rng = random.Random(24)
    word = lambda: f"u{rng.randrange(10**7)}"
    line, base = [f"line{i}" for i in range(12)], [word() for _ in range(150)]
    if kind == "line":
        texts = [" ".join([*line, *(word() for _ in range(200))]) for _ in range(400)]
    else:
        texts = [" ".join(word() if k in changed else w for k, w in enumerate(base)) for changed in (rng.sample(range(150), 6) for _ in range(100))]
    rows, seen, inner = rows_of(texts, seed=25), [], jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda members, *rest: seen.append(members.count()) or inner(members, *rest))
    found = jaccard.similar_documents(make_docs(spark, rows), 3, (4, 5))
    assert Counter(tuple(r) for r in found.collect()) == brute_similar(rows, 3, (4, 5))
    assert max(seen) <= most


def test_bpe_takes_few_passes_over_words_of_many_pairs(vocabulary_path, library, monkeypatch):
    rng = random.Random(26)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnoprstuvwyzäéß") for _ in range(rng.randint(3, 14))) for _ in range(100)) for _ in range(40)]
    merges, passes, inner = bpe.Merges(vocabulary_path), [], bpe.Merges.ranks
    monkeypatch.setattr(bpe.Merges, "ranks", lambda self, a, b: passes.append(len(a)) or inner(self, a, b))
    got = list(merges.encode(texts))
    assert [ids for ids, _ in got] == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert len(passes) < 300


def test_bpe_ids_by_arrow_keep_nulls_and_order(spark, vocabulary_path, library):
    rows = [(None, "a null id"), (1, None), (1, "twice"), (1, "twice"), (2, ""), (3, "  "), (4, "<|endoftext|> x"), (5, "Über ßß"), (6, "é" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = bpe.encode(docs, vocabulary_path, block=20)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_tokens:bigint,ids:array<int>>"
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert [(r["doc_id"], r["n_tokens"], list(r["ids"])) for r in got.collect()] == [(i, len(ids), ids) for i, ids in want]
