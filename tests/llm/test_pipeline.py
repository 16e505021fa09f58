"""The pipeline's stages in order over a small folder, each against what its input calls for."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from millwatch.llm import mixing
from millwatch.llm.queries import ORACLES, QUERIES
from millwatch.llm.tables import stored

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, toxic = [], set()
    for i in range(400):
        own = text(rng.randint(5, 120))
        if i % 8 == 0:
            own[rng.randrange(len(own))] = "zuxxor"
            toxic.add(i)
        rows.append((i, " ".join(own)))
    rows += [(1000 + k, rows[k][1].replace(" ", "  ")) for k in range(1, 40) if k not in toxic]
    base = text(100)
    rows += [(2000 + k, " ".join(base[:50] + [f"n{k}"] + base[51:])) for k in range(25)]
    rows += [(3000, None), (3001, ""), (3002, "one"), (3003, "one")]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents = spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(0, 400) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), toxic


def test_stages(spark, folder):
    from tokenizers import Tokenizer
    import public_tokenizers

    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), "test-stage")
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        assert docs.columns == columns or name == "bpe"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert set(texts) - set(kept["toxicity"]) == toxic
    normal = {i: re.sub("[\x20\x09-\x0d]+", " ", texts[i] or "") for i in kept["toxicity"]}
    first = {}
    for i in sorted(normal):
        first.setdefault(normal[i], i)
    assert set(kept["exact_dedup"]) == set(first.values())
    assert set(kept["near_dedup"]) == {i for i in first.values() if not 2000 < i < 3000}
    size = {i: len(WORD.findall(texts[i] or "")) for i in texts}
    source = {i: f"src{i % 3}" if i % 7 else None for i in texts}
    names = ["src0", "src1", "src2", None]
    sizes = [sum(size[i] for i in kept["near_dedup"] if source[i] == s) for s in names]
    for s, target in zip(names, mixing.targets(sizes, mixing.weights(4))):
        assert sum(size[i] * n for i, n in kept["mixing"].items() if source[i] == s) == pytest.approx(target, rel=0.03)
    assert max(kept["mixing"].values()) <= 3 and set(kept["mixing"]) <= set(kept["near_dedup"])
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert kept["bpe"] == kept["mixing"]
    for r in docs.collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)


def test_near_dedup_keeps_the_other_text_of_an_id(spark):
    from millwatch.llm import jaccard

    base = " ".join(f"w{i}" for i in range(40))
    near, other = base.replace("w39", "x39"), " ".join(f"o{i}" for i in range(30))
    rows = [(1, base), (5, near), (5, other), (5, other), (5, None), (7, near), (7, base), (None, base), (None, "alone here in this text now"), (9, near + " "), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, _gone int")
    got = jaccard.one_of_each(docs, size=5, similar=(4, 5))
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(1, base), (5, other), (5, other), (5, None), (9, ""), (None, "alone here in this text now")], key=str)


def test_run_is_the_stages_in_order(spark, folder):
    path = folder[0]
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "n_tokens", "ids"] and corpus_pipeline.ORACLE_SQL is None


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)
