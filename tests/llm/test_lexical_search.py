import math
import random
import re
from collections import Counter

from cases import MESSY, documents, empty
from kinrank.llm import lexical_search as L


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    found = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, own in wanted.items():
        best = []
        for i, w in found:
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in own if t in tf)
            if score > 0:
                best.append((-score, i is None, i or 0))
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    frame = spark.createDataFrame([(*r, "x", 3) for r in items], "item_id bigint, text string, term string, doc_id int")
    got = L.search(docs, frame, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "x9", "ÉTÉ"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(n)]
    return texts + [texts[0]] * 40 + [t.upper() + "!" for t in texts[:20]]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = corpus(rng, 250) + MESSY
    df = documents(spark, texts)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    items = [(i, " ".join(rng.sample(texts[:250], 2))) for i in range(12)] + [(3, "w5 w5 x9"), (None, "w1 Über"), (50, ""), (51, None), (52, "unseen")]
    want = brute(docs, items)
    assert run(spark, df, items) == want
    for name, value in (("DOCS", 7), ("WIDTH", 5), ("CELLS", 200), ("SALT", 2)):
        monkeypatch.setattr(L, name, value)
    assert run(spark, df, items) == want
    assert run(spark, df, items, 3) == brute(docs, items, 3)


def test_ties_across_tiles_go_by_id():
    ids, best = list(range(1000)), L.Best(1, 10)
    random.Random(1).shuffle(ids)
    import numpy as np
    for at in range(0, 1000, 50):
        best.add(np.full((1, 50), 7, np.int64), ids[at:at + 50])
    assert [r[2] for r in sorted(best.rows[0])[:10]] == list(range(10))


def test_sums_stay_exact():
    words_ = [b"t%d" % i for i in range(3000)]
    tiles = L.Tiles(words_, [list(range(3000))], [2 ** 30] * 3000)
    assert all(2 ** 30 * L.PEAK * (b - a) < 2 ** 53 for a, b in zip(tiles.cuts, tiles.cuts[1:])) and len(tiles.cuts) > 2
    got = tiles.scores([words_ * 3, [b"t1"]], 2, 9001)
    want = [sum(2 ** 30 * (3 * 10 ** 9 // (3000 + 8 * (10 + 90 * 9000 * 2 // 9001))) for _ in words_),
            2 ** 30 * (10 ** 9 // (1000 + 8 * (10 + 180 // 9001)))]
    assert got.tolist() == [want]


def test_empty_tables(spark):
    some = documents(spark, ["a b c"])
    assert run(spark, empty(spark), [(1, "a")]) == []
    assert run(spark, some, []) == []
    assert run(spark, documents(spark, [None, "", "?!"]), [(1, "a")]) == []
