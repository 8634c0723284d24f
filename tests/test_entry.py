"""Contract checks: entry() runs; a few registered queries agree with their
DuckDB SQL on the smallest data set."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["cochange_topk", "specificity", "names", "name_sim", "content_jaccard", "content_classes",
                                  "import_refs", "php_refs", "ref_overlap", "ref_uses", "path_set_classes", "changelog_parse", "relatedness", "explain",
                                  "files_scan", "exclusions_table", "cochange_uncapped", "recent_groups"])
def test_oracle_agreement(spark, name):
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    import __spark_entry__ as E
    from oracle_check import canon, duck
    sdf = E.queries()[name](spark, SF)
    c1, r1 = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck(SF).execute(E.oracle_sql()[name])
    c2, r2 = canon([d[0] for d in res.description], res.fetchall())
    assert c1 == c2 and r1 == r2


def test_every_score_term_and_label_occurs(spark):
    import __spark_entry__ as E
    rows = E._relatedness(spark, "/root/testdata/sf0.01", E._recent_targets(spark, "/root/testdata/sf0.01"),
                          explain=True).collect()
    for term in ("feature_bonus", "cochange_bonus", "content_bonus", "recency_bonus", "domain_similarity"):
        assert any(getattr(r, term) > 0 for r in rows), term
    labels = {x.split(" ")[0] for r in rows for x in r.labels}
    assert labels >= {"direct-ref", "co-change", "same-dir", "exact-name", "stem", "domain", "filename", "content",
                      "recent"}, labels


def test_reference_pairs(spark, monkeypatch):
    """The pairs behind `ref_overlap`, with hot tokens cut into slices."""
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    import __spark_entry__ as E
    from kinrank.operators import overlap
    from oracle_check import canon, duck
    monkeypatch.setattr(overlap, "SLICE", 7)
    sdf = E.q_ref_overlap_pairs(spark, SF)
    c1, r1 = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck(SF).execute(E.REF_PAIRS_SQL)
    c2, r2 = canon([d[0] for d in res.description], res.fetchall())
    assert c1 == c2 and r1 == r2


def test_all_targets_exact_topk(spark):
    """Every item against every item (quadratic), on the smallest data set."""
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    import __spark_entry__ as E
    from oracle_check import canon, duck
    sdf = E.q_relatedness_all_topk(spark, SF)
    c1, r1 = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck(SF).execute(E.ALL_TARGETS_SQL)
    c2, r2 = canon([d[0] for d in res.description], res.fetchall())
    assert c1 == c2 and r1 == r2


def test_reference_overlap_has_every_pair(spark, tmp_path):
    """The registered query names each pair of items once, also where items have equal references or paths or ids repeat."""
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    import duckdb
    import __spark_entry__ as E
    from oracle_check import canon
    rows = [(k, name, "Brand#1", kind, size) for k, name, kind, size in [
        (1, "iron forge", "SMALL TIN", 0), (2, "iron forge", "SMALL TIN", 0), (8, "iron forge", "SMALL TIN", 3), (9, "iron forge", "SMALL TIN", 3),
        (28, "iron forge", "SMALL TIN", 3), (10, "red lamp", "LARGE OAK", 1), (11, "blue iron", "SMALL TIN", 1), (11, "red oak", "LARGE OAK", 2)]]
    (spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
     .coalesce(1).write.parquet(str(tmp_path / "part.parquet")))
    sdf = E.queries()["ref_overlap"](spark, str(tmp_path))
    assert sorted(sdf.columns) == ["bonus", "candidate", "target"]
    c1, r1 = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    res = con.execute(E.oracle_sql()["ref_overlap"])
    c2, r2 = canon([d[0] for d in res.description], res.fetchall())
    assert c1 == c2 and r1 == r2 and len({(r["target"], r["candidate"]) for r in sdf.collect()}) == len(r1) > 20
