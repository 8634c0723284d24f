"""Quality classifier and language-model scores."""
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import MESSY, documents, empty
from kinrank.llm import lm_score as M
from kinrank.llm import quality as Q
from kinrank.llm.queries import op2_quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = op2_quality(spark, SF).toPandas()
    lab = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    x = got[got.held_out].merge(lab, on="doc_id")
    assert len(got) == 1000 and (x.predicted == x.quality).mean() >= 0.97
    p = x.score.clip(1e-6, 1 - 1e-6)
    assert -(x.quality * np.log(p) + (1 - x.quality) * np.log(1 - p)).mean() < 0.2


def test_quality_awkward_rows(spark):
    docs = documents(spark, ["good plain text here"] * 20 + ["BAD!! TEXT!! %%%"] * 20 + MESSY)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id bigint, quality int")
    model = Q.fit(docs, Q.sample(labels, "quality", F.lit(False)))
    rows = Q.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[0] > 0.5 > by_id[25]
    assert Q.scores(empty(spark), model).count() == 0
    one = Q.fit(docs, Q.sample(labels.where("quality = 1"), "quality", F.lit(False)))
    assert {r.score for r in Q.scores(docs, one).collect()} == {1.0}
    none = Q.fit(docs, Q.sample(labels.where("false"), "quality", F.lit(False)))
    assert {r.score for r in Q.scores(docs, none).collect()} == {0.5}


def test_words_of_one_document_get_context(spark):
    name = lambda n: "".join(chr(97 + n // 26 ** i % 26) for i in range(4))
    own = [[name(20 * i + k) for k in range(20)] for i in range(300)]        # 6,000 words, none in two of these texts
    anchors = [["alphaone", "alphatwo", "alphathree"], ["betaone", "betatwo", "betathree"]]
    near = [" ".join(t for k, w in enumerate(ws) for t in (anchors[i % 2][k % 3], w)) for i, ws in enumerate(own)]
    docs = documents(spark, [" ".join(ws) for ws in own] + near)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    rows = Q.scores(docs, Q.fit(docs, Q.sample(labels, "quality", F.lit(False)))).collect()
    unseen = [r for r in rows if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert sum((r.score > 0.5) == r.doc_id % 2 for r in unseen) >= 95


def test_pooled_vectors_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(Q, "SLAB", 60)
    monkeypatch.setattr(Q, "PART_BYTES", 200)
    texts = ["The cat sat on the mat", "a dog. A dog! the mat", "", None, "cat " * 50, "rare words only here 7 7", "the the the"] * 3
    docs = documents(spark, texts)
    found = [[t.lower() for t in Q.tokens(r.text)] for r in docs.collect()]
    sums = {w: np.zeros(Q.DIM) for ts in found for w in ts}
    index = {w: Q.index_vectors(Q.hashes([w], 3))[0].astype(float) for w in sums}
    for ts in found:
        for i, w in enumerate(ts):
            for j in range(max(0, i - Q.WINDOW), min(len(ts), i + Q.WINDOW + 1)):
                if i != j:
                    sums[w] += index[ts[j]]
    exact = {w: index[w] + s * np.sqrt(Q.MARKS) / max(np.linalg.norm(s), 1) for w, s in sums.items()}
    vector = {w: Q.word_vectors(Q.hashes([w], 3), s[None])[0] * Q.STEP for w, s in sums.items()}
    assert all(np.abs(vector[w] - x).max() < Q.STEP for w, x in exact.items())
    want = sorted(tuple(np.round(sum((vector[w] for w in ts), np.zeros(Q.DIM)) / max(len(ts), 1), 4)) for ts in found)
    got = Q.pooled(Q.slabs(docs, 3, told=True, ask=True), 3).collect()
    assert len(got) == docs.count()
    assert np.abs(np.sort([Q._vectors([r.x])[0][:Q.DIM] for r in got], axis=0) - np.sort(want, axis=0)).max() < 2e-3
    model = Q.fit(docs, Q.sample(spark.createDataFrame([(0, 1), (1, 0), (7, 1), (8, 0)], "doc_id bigint, quality int"), "quality", F.lit(False)))
    one = docs.where("doc_id = 1")
    assert abs(Q.scores(one, model).first().score - Q.scores(docs, model).where("doc_id = 1").first().score) < 1e-9


def test_vectors_pack_and_round_without_bias():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-7, 8, (50, Q.DIM)), rng.integers(-900, 900, (9, Q.DIM)), np.zeros((0, Q.DIM), int)):
        assert (Q.unpack_vectors(Q.pack_vectors(x)) == x).all()
    h = Q.hashes([f"w{i}" for i in range(4000)], 7)
    total = np.tile(rng.normal(0, 5, Q.DIM), (4000, 1))
    off = Q.word_vectors(h, total) * Q.STEP - Q.index_vectors(h) - total * np.sqrt(Q.MARKS) / np.linalg.norm(total[0])
    assert np.abs(off.mean(axis=0)).max() < 0.05


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))).astype(float)
    m = Q.train(x, y)
    p = 1 / (1 + np.exp(-Q._logits(m, x) / m["temperature"]))
    assert ((p > 0.5) == (y > 0)).mean() > 0.7 and m["temperature"] > 0.5


def base_scores(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [M.tokens(t) for _, t in rows]
    c = Counter(w for (i, _), ts in zip(rows, toks) if not held(i) for w in ts)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ts), sum(c[w] > 0 for w in ts), n,
             round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for (i, _), ts in zip(rows, toks)]


def as_rows(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()]


@pytest.mark.parametrize("slab,part", [(M.SLAB, M.PART_BYTES), (500, 300)])
def test_base_score_is_exact_in_any_layout(spark, monkeypatch, slab, part):
    texts = [*MESSY, *(f"the cat {i % 7} sat on the mat {i % 3} and the dog" for i in range(60))]
    docs = documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    whole = {r.doc_id: r.score for r in M.score(docs).collect()}
    monkeypatch.setattr(M, "SLAB", slab)
    monkeypatch.setattr(M, "PART_BYTES", part)
    got = M.score(docs)
    assert sorted(as_rows(got), key=str) == sorted(base_scores(rows), key=str)
    assert all(abs(whole[r.doc_id] - r.score) < 0.02 * abs(r.score) for r in got.where("doc_id is not null").collect())


def test_scores_beat_the_base_on_held_out_texts(spark):
    df = M.score(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    held = df[df.held_out]
    assert np.isfinite(df.score).all() and (df.score <= 0).all()
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.7


def test_empty_and_untrained(spark):
    assert M.score(empty(spark)).count() == 0
    docs = documents(spark, MESSY).where("crc32(cast(doc_id as string)) % 5 = 1")
    for r in M.score(docs).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(r.base_score)


def test_filter_probes():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64))
    count = rng.geometric(0.3, len(key)) + 1
    block = M.build_block(key, count)
    q = M.probe(block, key)
    assert (q >= M.level(count)).all() and (q == M.level(count)).mean() > 0.95      # never too low
    other = np.setdiff1d(rng.integers(1 << 41, 1 << 42, 20_000).astype(np.uint64), key)
    assert (M.probe(block, other) > 0).mean() < 0.03
    levels = M.level(np.arange(1, 2000))
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    counts = np.arange(1, 100_000)
    assert (M.lowest(M.level(counts)) <= counts).all() and (M.level(M.lowest(M.level(counts)).astype(int)) == M.level(counts)).all()


def test_rare_bigrams_count_in_a_larger_corpus(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 8000)) for _ in range(140)]     # a bar of 1e-5 would be 9
    texts += ["zeta eta"] * 4 + ["eta theta zeta", "zeta eta", "eta zeta"]
    docs = documents(spark, texts)
    rows = [(r.doc_id, M.tokens(r.text)) for r in docs.collect()]
    uni, bi, mass = Counter(), Counter(), Counter()
    for i, ts in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            uni.update(ts)
            bi.update(zip([ts[-1], *ts], ts))
    bi = {k: float(M.lowest(M.level(np.array([c])))[0]) - M.DISCOUNT for k, c in bi.items() if c >= M.MIN_COUNT}
    for (a, _), c in bi.items():
        mass[a] += c
    n, v = sum(uni.values()), len(uni)
    unseen = min(max(sum(c == 1 for c in uni.values()) / v, 0.1), 0.9)
    want = {i: sum(math.log10((uni[w] - unseen if uni[w] else unseen * v) / n * (1 - mass[a] / max(uni[a], 1))
                              + bi.get((a, w), 0) / max(uni[a], 1)) for a, w in zip([ts[-1], *ts], ts)) for i, ts in rows}
    assert 2 <= uni[b"zeta"] < 1e-5 * n and (b"zeta", b"eta") in bi
    got = {r.doc_id: r.score for r in M.score(docs).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(140, 147))
    assert abs(sum(got[i] for i in range(140)) / sum(want[i] for i in range(140)) - 1) < 1e-2


def test_probabilities_add_up_to_one_and_never_exceed_it():
    rng = np.random.default_rng(11)
    words = rng.choice(60, 6000, p=np.arange(1, 61) / 1830)
    words[::7] = 3                                          # a context with one heavy follower
    words[1::7] = 5
    uni = np.bincount(words, minlength=61)                  # the last word is an unseen one
    pairs = Counter(zip(words.tolist(), [*words[1:].tolist(), int(words[0])]))
    seen = uni[uni > 0]
    model = {"n": len(words), "v": len(seen), "unseen": min(max((seen == 1).sum() / len(seen), 0.1), 0.9)}
    words_of = np.append(np.flatnonzero(uni), 60)
    for v in np.flatnonzero(uni).tolist():
        n = np.array([pairs.get((v, int(w)), 0) for w in words_of])
        q = np.where(n >= M.MIN_COUNT, M.level(np.maximum(n, 1)), 0)
        mass = np.where(q > 0, M.lowest(q) - M.DISCOUNT, 0).sum()
        p = M.probability(uni[words_of], uni[v], mass, q, model)
        assert abs(p.sum() - 1) < 1e-6 and p.max() <= 1 and p.min() > 0
    for c in range(1, 3000):                                # any level, also a false one, in any context
        p = M.probability(np.array([0, 1, c]), c, M.lowest(M.level(np.array([c]))) - M.DISCOUNT, np.array([119, 40, 5]), model)
        assert (p <= 1).all()


def test_no_score_is_above_zero_on_repetitive_texts(spark):
    docs = documents(spark, ["ab " * 195, "one two " * 300, "solo"] * 5 + MESSY)
    assert all(r.score <= 0 for r in M.score(docs).collect())
