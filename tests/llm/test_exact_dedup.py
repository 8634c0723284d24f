import duckdb

from cases import MESSY, documents, empty
from kinrank.llm import exact_dedup as E
from pyspark.sql import functions as F


def check(docs, keep="largest", **kw):
    got = E.classes(docs, keep, **kw)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(E.exact_dedup_sql(keep)).fetchall()
    rows = [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    return rows


def test_matches_sql(spark):
    texts = [f"text {i % 37}" for i in range(300)] + MESSY + ["same"] * 150
    docs = documents(spark, texts)
    check(docs)
    check(docs, "smallest")
    assert check(empty(spark)) == []


def test_shuffled_and_hot_paths(spark, monkeypatch):
    docs = documents(spark, ["hot"] * 200 + [f"t{i // 2}" for i in range(200)] + MESSY)
    for most, hot in ((0, 1000), (500_000, 1), (0, 4)):
        monkeypatch.setattr(E, "BROADCAST", most)
        monkeypatch.setattr(E, "HOT", hot)
        check(docs)


def test_hash_collisions_are_taken_apart(spark):
    def weak(t):
        return F.unhex(F.lpad(F.hex(F.length(t)), 8, "0"))
    docs = documents(spark, ["abc", "abd", "abc", "x", "xyz", "yy", "", "yz"] * 20 + MESSY)
    check(docs, content_hash=weak)
    check(docs, "smallest", content_hash=weak)


def test_normalised_texts_and_columns(spark):
    docs = documents(spark, ["A b", "a  B", "c", "C ", "d", None, ""])
    one = E.without_duplicates(docs, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", "")))
    assert one.dtypes == docs.dtypes
    assert sorted(str(r.doc_id) for r in one.collect()) == ["0", "2", "4", "5"]
    assert E.without_duplicates(docs, "largest").count() == 6
    assert E.without_duplicates(empty(spark)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id bigint, text string")
    rows = check(docs)
    assert {(r[0], r[1], r[3]) for r in rows if r[2] == 2} == {(None, 3, False), (3, 3, True), (None, None, True)}
    assert sorted(str(r.doc_id) for r in E.without_duplicates(docs).collect()) == ["3", "None"]
