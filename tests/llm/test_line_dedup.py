import random

import duckdb

from cases import MESSY, documents, empty
from kinrank.llm import line_dedup as L
from pyspark.sql import functions as F


def both(docs, min_sites):
    got = L.dedup_lines(docs, min_sites=min_sites)
    assert got.columns == [*docs.columns, *L.added(docs)]
    names = zip(L.added(docs), ("n_lines", "n_boilerplate", "n_removed", "whole_copy"))
    rows = got.select("doc_id", *[F.col(a).alias(b) for a, b in names], F.sha2("text", 256).alias("text_sha256")).collect()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = con.execute(L.line_dedup_sql(min_sites)).fetchall()
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    clean = lambda rows: [tuple(None if x is None or x != x else x if isinstance(x, str) else int(x) for x in r) for r in rows]
    assert key(clean(rows)) == key(clean(want))
    return got


def test_matches_sql_with_near_threshold_lines(spark):
    rng = random.Random(5)
    sites = [f"s{i}" for i in range(14)] + [None]
    shared = [f"boiler {i} " + "x" * i for i in range(12)]
    texts = []
    for i in range(400):
        lines = [f"own {i} {k} " + "y" * 40 for k in range(4)] + rng.sample(shared[: 1 + i % 12], 1)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    got = both(documents(spark, texts, sites), 10)
    assert got.where("_n_removed > 0").count() > 50


def test_whole_copies_and_awkward_rows(spark):
    sites = [f"s{i}" for i in range(12)]
    copies = ["same first line of a copy\nsame second line of it"] * 12
    docs = documents(spark, copies + MESSY, sites).withColumn("_n_removed", F.lit("mine")).withColumn("_hit", F.lit(1))
    got = both(docs, 10)
    assert got.where("_whole_copy and _n_boilerplate = 2 and text = '' and _n_removed = 'mine' and _n_removed_ = 2").count() >= 12
    kept = L.dedup_lines(docs, keep_whole=True)
    assert kept.where("_whole_copy and _n_boilerplate = 2 and _n_removed_ = 0 and text like 'same first%'").count() >= 12
    both(documents(spark, MESSY, [None]), 1)
    assert L.dedup_lines(empty(spark)).count() == 0


def test_very_many_lines_in_one_document(spark):
    import time
    long = "\n".join(f"shared {i}" if i % 2 else f"own {i}" for i in range(200_000))
    small = ["\n".join(f"shared {i}" for i in range(k, 200_000, 11)) for k in range(11)]
    docs = documents(spark, [long, *small], [f"s{i}" for i in range(12)])
    began = time.time()
    got = {r.doc_id: r for r in L.dedup_lines(docs, min_sites=2).collect()}
    assert time.time() - began < 60
    assert got[0]["_n_removed"] == 100_000 and got[0].text.split("\n") == [f"own {i}" for i in range(0, 200_000, 2)]


def test_pipeline_takes_all_notices_but_from_whole_copies(spark):
    from corpus_pipeline import drop_boilerplate_lines
    notice = "the same long notice on every page " * 8
    texts = [f"{notice}\nown {chr(97 + i)}" for i in range(12)] + [notice] * 12
    got = drop_boilerplate_lines(spark, documents(spark, texts, [f"s{i}" for i in range(12)]), "").collect()
    by_id = {r.doc_id: r.text for r in got}
    assert all(by_id[i] == f"own {chr(97 + i)}" for i in range(12))
    assert all(by_id[i] == notice for i in range(12, 24))                    # whole copies wait for near-duplicate removal
