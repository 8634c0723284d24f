import random

import numpy as np
import xxhash

from cases import MESSY, documents, empty
from kinrank.llm import simhash as S
from kinrank.llm.graph import components
from pyspark.sql import functions as F


def slow_fingerprint(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
    v = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    return v - (1 << 64) if v >> 63 else v


def roots(values, distance):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v
    values = list(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def check_links(spark, values, **kw):
    values = {v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = {r.node: r.root for r in components(S.links(nodes, **kw)).collect()}
    want = roots(values, kw.get("distance", 3))
    assert {v: got.get(v, v) for v in values} == want


def test_fingerprints_and_components(spark):
    texts = [*MESSY, "the quick brown fox jumps " * 30, "the quick brown fox jumps " * 30 + "over", "ÀB c\x0bd\x1ce f"]
    docs = documents(spark, texts)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by_id[i].fp == slow_fingerprint(t) for i, t in enumerate(texts))
    root = roots({r.fp for r in rows}, 3)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[root[r.fp]] = min(first.get(root[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == first[root[r.fp]] for r in rows)
    kept = S.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert S.near_duplicates(empty(spark)).count() == 0 and S.representatives(empty(spark)).count() == 0
    only = documents(spark, ["x y z"]).where("doc_id is null")
    assert S.representatives(only).count() == 2


def test_links_between_random_and_dense_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(3)]
    # a dense cluster whose members share nearly all bits, so that runs of one key span many groups
    dense = [base[0] ^ (rng.getrandbits(11) << 20) for _ in range(500)]
    for group in (32, 1024):
        monkeypatch.setattr(S, "GROUP", group)
        check_links(spark, {*base, *near, *dense})
    check_links(spark, {*base, *near, *dense}, levels=2)
    check_links(spark, {*base, *near}, distance=1)


def test_near_pairs_is_complete():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, m = rng.integers(1, 700, 2)
        x = rng.integers(0, 1 << 14, n).astype(np.uint64)
        y = rng.integers(0, 1 << 14, m).astype(np.uint64)
        x, y = np.sort(x), np.sort(y)
        i, j = S.near_pairs(x, y, 3)
        want = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= 3)
        assert sorted(zip(i.tolist(), j.tolist())) == [tuple(v) for v in want.tolist()]


def test_gray_rank_orders_the_reflected_code(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    rows = spark.createDataFrame([(c,) for c in codes], "fp bigint").select("fp", S.gray_rank(F.col("fp")).alias("g")).collect()
    assert [r.g for r in rows] == list(range(64))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 190), (200, 190)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 190, 190: 190}
    assert got == want
