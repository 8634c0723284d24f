import random

from pyspark.sql import functions as F

from kinrank.functions import similarity as S
from strsim_model import jaro_winkler as jw_model


def test_jaro_winkler_matches_model(spark):
    rnd = random.Random(7)
    rows = [("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))),
             "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9)))) for _ in range(400)]
    rows += [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", S.jaro_winkler(F.col("a"), F.col("b")).alias("hof"),
        S.jaro_winkler_arrow(F.col("a"), F.col("b")).alias("arrow"))
    for r in df.collect():
        want = jw_model(r.a, r.b)
        assert abs(r.hof - want) < 1e-12 and abs(r.arrow - want) < 1e-12, (r.a, r.b)


def test_levenshtein_and_dir(spark):
    df = spark.createDataFrame([("kitten", "sitting", ["a", "b"], ["a", "c", "d"]),
                                ("", "", [], [])],
                               "a string, b string, da array<string>, db array<string>")
    r = df.select(S.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"),
                  S.dir_proximity(F.col("da"), F.col("db")).alias("d")).collect()
    assert abs(r[0].l - (1 - 3 / 7)) < 1e-12 and abs(r[0].d - 1 / 3) < 1e-12
    assert r[1].l == 1.0 and r[1].d == 1.0


def test_weighted_jaccard_forms_agree(spark):
    df = spark.createDataFrame([(["src", "a", "b"], ["src", "b", "c"]), ([], []), (["x"], [])],
                               "a array<string>, b array<string>")
    ha, hb = S.hashed_set(F.col("a")), S.hashed_set(F.col("b"))
    r = df.select(S.weighted_jaccard(F.col("a"), F.col("b")).alias("w"),
                  S.weighted_jaccard_pre(ha, S.token_set_weight(ha), hb, S.token_set_weight(hb)).alias("p")
                  ).collect()
    assert abs(r[0].w - 1.2 / 3.2) < 1e-12 and abs(r[0].p - r[0].w) < 1e-12
    assert r[1].w == r[1].p == 1.0
    assert r[2].w == r[2].p == 0.0


def test_jaro_winkler_by_bits_equals_the_matrix_form():
    import random
    import numpy as np
    from kinrank.functions import similarity as S
    rng = random.Random(8)
    for alphabet, longest in (("ab", 12), ("abcdeß 中", 64), ("abcdefghijkl", 30)):
        a, b = (["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(500)] for _ in range(2))
        la, lb = (np.array([len(x) for x in y]) for y in (a, b))
        ca, cb = S._codes(a, longest), S._codes(b, longest)
        cb[cb == -1] = -2
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        for bits, plain in zip(S._matches_by_bits(ca, cb, reach), S._matches(ca, cb, reach)):
            assert bits.tolist() == plain.tolist()
    assert S._matches_by_bits(np.zeros((1, 65), np.int32), np.zeros((1, 65), np.int32), reach[:1]) is None


def test_symmetric_signals_come_in_both_orders(spark):
    from kinrank.operators.pairs import both_ways
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "target long, candidate long, s double")
    assert sorted(map(tuple, both_ways(df, "s").collect())) == [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5), (3, 1, 0.25)]
