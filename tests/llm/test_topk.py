import math
import random

from kinrank.llm import topk as K
from pyspark.sql import functions as F


def brute(rows, k, every):
    vec = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vec.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = set()
    for q, qs in vec.items():
        if q % every:
            continue
        best = []
        for i, xs in vec.items():
            s = [min(max(sum(a * b for a, b in zip(max(qs), x)), -2 ** 63), 2 ** 63 - 1) for x in xs if len(x) == len(max(qs))]
            if i != q and s:
                best.append((-max(s), i))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(best)[:k], 1)}
    return out


def run(spark, rows, k=10, every=10):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<double>, cell int, v string")
    got = K.top_k(K.integer_vectors(df), F.col("vec_id") % every == 0, k).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def rows_of(rng, n, spread):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 8]]) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    for spread in (1.0, 0.02):
        rows = rows_of(rng, 700, spread)
        rows += [(2000 + i, rows[3][1]) for i in range(120)]           # one very common vector: ties
        assert run(spark, rows) == brute(rows, 10, 10)
        monkeypatch.setattr(K, "QUERIES", 20)
        monkeypatch.setattr(K, "LEAST", 64)
        monkeypatch.setattr(K, "SLICE", 100)


def test_pruning_leaves_cells_out():
    import numpy as np
    p = {2: np.array([[0.0, 0.0], [1000.0, 0.0], [-1000.0, 0.0]])}
    data = [(2, 1, 500, 10.0, 1010.0), (2, 2, 500, 10.0, 1010.0)]
    rows = K.plan(p, data, [(2, 1, 5, 10.0, 1010.0)], 10)
    assert {r[2] for r in rows} == {1}


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 0.0]), (1, [0.0, 0.0]),
            (2, [1.0, 2.0]), (2, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0]), (50, [1.0]), (60, []), (70, [1e9, -1e9]), (71, [3e9, 2.0])]
    assert run(spark, rows) == brute(rows, 10, 10)
    assert run(spark, [(0, [1.0])]) == set()
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert K.top_k(K.integer_vectors(df), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_ids_do_not_prove_the_bound(spark):
    rng = random.Random(3)
    far = [(0, 8.0), (100, 6.0), (200, -6.0)]                # clusters: the best one is almost all one id
    rows = [(at + i, [x + rng.gauss(0, 0.01), rng.gauss(0, 0.01)]) for at, x in far for i in range(60) if at or not i]
    rows += [(7, [8.0 + rng.gauss(0, 0.01), rng.gauss(0, 0.01)]) for _ in range(40)]
    rows += [(9, [x, 0.0]) for x in (8.0, 6.0, -6.0) for _ in range(30)]           # one id in several cells
    assert run(spark, rows) == brute(rows, 10, 10)
