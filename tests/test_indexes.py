"""Searches and pages by an index against the plain forms."""

from pyspark.sql import functions as F

from millwatch.operators import admin, paging, trigrams


def test_every_short_term_of_the_names(spark, tmp_path):
    names = ["Anna Müller", "ANNABEL O'Neil", "Bo", None, "Łukasz ßeta", "bob bobson", "a.b.c"]
    users = spark.createDataFrame([(i, n, f"{(n or 'x').split(' ')[0].lower()}@mill.example.com", "admin" if i % 2 else "operator") for i, n in enumerate(names)], "user_id long, name string, email string, role string")
    trigrams.index_texts(users, "user_id", ["name", "email"], str(tmp_path / "i"))
    rows = users.collect()
    terms = {t[i : i + k] for t in ["Anna Müller", "Łukasz", "bobson", "mill.exa", "zzzz", "annx"] for k in range(2, 7, 2) for i in range(0, len(t) - k + 1, 2)}
    for term in sorted(terms):
        want = {r["user_id"] for r in rows if term.lower() in (r["name"] or "").lower() or term.lower() in r["email"].lower()}
        assert {r["user_id"] for r in admin.search_users_indexed(users, str(tmp_path / "i"), term).collect()} == want, term
    assert {r["user_id"] for r in admin.search_users_indexed(users, str(tmp_path / "i"), "EXAMPLE", "admin").collect()} == {1, 3, 5}


def test_indexed_pages_equal_offset_pages(spark, tmp_path):
    df = spark.range(1003).select((F.col("id") * 7 % 1003).alias("id"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 17)).alias("at"), F.lit("x").alias("text"))
    order, path = [F.col("at").desc(), F.col("id").desc()], str(tmp_path / "p")
    paging.index_pages(df, "at", "id", path, rows=100)
    for page, size in ((1, 20), (2, 20), (26, 20), (51, 20), (52, 20), (1, 2000), (3, 150), (1, 0)):
        rows, summary = paging.indexed_page(spark, path, page, size)
        want, about = paging.paginate(df, order, page, size)
        assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in want.collect()], (page, size)
        assert tuple(summary.first()) == tuple(about.first())
    one = paging.indexed_page(spark, path, 26, 20)[0]
    assert len({f.split("/range=")[1].split("/")[0] for f in one.inputFiles()}) <= 2 and one.columns == df.columns
    paging.index_pages(df.limit(0), "at", "id", str(tmp_path / "e"))
    rows, summary = paging.indexed_page(spark, str(tmp_path / "e"))
    assert rows.collect() == [] and tuple(summary.first()) == (0, 1, 20, 0)


def test_index_of_small_slots_has_few_folders(spark, tmp_path, monkeypatch):
    df = spark.range(1003).select((F.col("id") * 7 % 1003).alias("id"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 17)).alias("at"))
    order, path = [F.col("at").desc(), F.col("id").desc()], str(tmp_path / "p")
    paging.index_pages(df, "at", "id", path, rows=10)
    assert spark.read.parquet(f"{path}/counts").count() == 1  # one task, file and sample for 101 slots
    monkeypatch.setattr(paging, "FOLDER_ROWS", 400)
    paging.index_pages(df, "at", "id", path, rows=10)
    assert spark.read.parquet(f"{path}/counts").count() == 3
    for page, size in ((1, 20), (15, 20), (51, 20), (52, 20), (1, 2000), (3, 250), (2, 7)):
        rows = [tuple(r) for r in paging.indexed_page(spark, path, page, size)[0].collect()]
        assert rows == [tuple(r) for r in paging.paginate(df, order, page, size)[0].collect()], (page, size)


def test_values_as_variant(spark, tmp_path):
    from millwatch.functions import texts

    given = ['{"k": 1, "b": "x"}', '{"k": "1"}', '{"k": null}', '{"k": {"z": 1}}', "{}", "[1]", "7", "{broken", "", None]
    rows = spark.createDataFrame([(i, "2024-01-01", t, None) for i, t in enumerate(given)], "log_id int, timestamp string, new_value string, old_value string")
    admin.audit_values(rows).write.parquet(str(tmp_path / "v"))
    kept = spark.read.parquet(str(tmp_path / "v"))
    assert kept.schema["new_value"].dataType.simpleString() == "variant"
    got = kept.select("log_id", texts.variant_text(F.col("new_value"), "k").alias("k"), texts.variant_fields(F.col("new_value")).alias("f")).orderBy("log_id").collect()
    assert [r["k"] for r in got[:3]] == ["1", "1", None] and [r["k"] for r in got[4:]] == [None] * 6
    assert [r["f"] for r in got] == [["b", "k"], ["k"], ["k"], ["k"], [], None, None, None, None, None]
