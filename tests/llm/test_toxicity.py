import random

import duckdb
from pyspark.sql import functions as F

from cases import MESSY, documents, empty
from kinrank.llm import toxicity as T
from kinrank.llm.queries import op7_toxicity


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    def rec(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (i, j, total)
        return [] if best is None else [*rec(a, best[0]), best, *rec(best[1] + 1, b)]
    return rec(0, len(scores))


def test_segments_match_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        hits = {i: rng.uniform(0.05, 2) for i in rng.sample(range(25), rng.randint(0, 9))}
        scores = [hits.get(i, -0.3) for i in range(25)]
        at = sorted(hits)
        got = T.segments(at, [hits[i] for i in at], 0.3)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def labelled_corpus(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts, labels = [], []
    for i in range(240):
        body = rng.choices(words, k=rng.randint(30, 90))
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                body.insert(rng.randrange(len(body)), rng.choice(["vilewretch", "vilewretched", "scumbag"]))
        texts.append(" ".join(body))
        labels.append((i, int(bad)))
    docs = documents(spark, texts)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id bigint, toxic int")
    return docs, lab, dict(labels)


def test_fit_and_passages(spark):
    docs, lab, truth = labelled_corpus(spark)
    model = T.fit(docs, T.sample(lab, "toxic", F.lit(False)))
    rows = T.toxic_passages(docs, model).collect()
    assert len(rows) == docs.count()
    scored = {r.doc_id: r for r in rows if r.doc_id is not None}
    wrong = [i for i, y in truth.items() if (scored[i].score >= 0.7) != bool(y)]
    assert len(wrong) <= 2
    assert all(scored[i].n_passages >= 1 for i, y in truth.items() if y and i not in wrong)
    kept = T.without_toxic(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i in truth if scored[i].score < 0.7}


def test_log_odds_and_scores_by_hand(spark):
    """Lexicon, segments and score of every text from their formulas, in plain Python."""
    import math
    from collections import Counter
    docs, lab, truth = labelled_corpus(spark)
    model = T.fit(docs, T.sample(lab, "toxic", F.lit(False)))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    seen, size = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    for i, y in truth.items():
        found = texts[i].lower().split()
        found = [w for w, b in zip(found, [None, *found]) if w != b]
        size[y] += len(found)
        seen[y].update(f for w in found for f in [*(w[:n] + "*" for n in range(3, 9) if len(w) >= n), w])
    lexicon = {}
    for f, t in seen[1].items():
        c = seen[0][f]
        a = T.FLAT + T.PRIOR * (t + c) / (size[0] + size[1])
        odds = math.log((t + a) / max(size[1] + T.PRIOR - t - a, .5)) - math.log((c + a) / max(size[0] + T.PRIOR - c - a, .5))
        error = math.sqrt(1 / (t + a) + 1 / (c + a))
        if t >= 2 and odds / error >= T.Z_MIN and odds - T.BOUND * error > math.log(3):
            lexicon[f] = odds - T.BOUND * error
    assert set(lexicon) == set(model["lexicon"]) and all(abs(model["lexicon"][f] - v) < 1e-9 for f, v in lexicon.items())
    got = {r.doc_id: r for r in T.toxic_passages(docs, model).collect()}
    for i, text in texts.items():
        found = text.lower().split()
        each = [max((lexicon.get(f, 0.0) for f in [*(w[:n] + "*" for n in range(3, 9) if len(w) >= n), w]), default=0.0) for w in found]
        total = sum({w: s for w, s in zip(found, each) if s > 0}.values())
        run = 1
        for k in range(1, len(found)):
            run = run + 1 if found[k] == found[k - 1] else 1
            each[k] /= run
        parts = brute_segments([s if s > 0 else -model["gap"] for s in each])
        expected = [model["K"] * len(found) * math.exp(-model["lambda"] * v) for _, _, v in parts]
        x = [1.0, min(sum(max(-math.log(e), 0) for e in expected), 30), min(total / math.sqrt(len(found) + 10), 30), math.log1p(total)]
        p = 1 / (1 + math.exp(-min(max(sum(a * w for a, w in zip(x, model["curve"])), -30), 30)))
        assert abs(got[i].score - p) < 1e-9
        assert [(s.first, s.last) for s in got[i].passages] == [(a, b) for (a, b, _), e in zip(parts, expected) if e <= T.MAX_E]


def test_repeated_words_and_all_passages_count(spark):
    docs, lab, _ = labelled_corpus(spark)
    judge = T._judge(T.fit(docs, T.sample(lab, "toxic", F.lit(False))))
    gap = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    once, often = judge(f"{gap} scumbag {gap}"), judge(f"{gap} {'scumbag ' * 6}{gap}")
    assert often[0] >= once[0] and often[2][0]["score"] > 2 * max([0.0, *(x["score"] for x in once[2])])
    two = judge(f"{'scumbag ' * 4}{gap} {gap} {'vilewretch ' * 4}")
    assert len(two[2]) == 2


def test_awkward_rows(spark):
    docs, lab, _ = labelled_corpus(spark)
    model = T.fit(docs, T.sample(lab, "toxic", F.lit(False)))
    rows = T.toxic_passages(documents(spark, MESSY), model).collect()
    assert len(rows) == len(MESSY) + 3 and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.n_tokens == 0}
    assert len(blank) == 1
    assert T.toxic_passages(empty(spark), model).count() == 0
    none = T.fit(docs, T.sample(lab.where("false"), "toxic", F.lit(False)))
    assert {r.score for r in T.toxic_passages(documents(spark, MESSY), none).collect()} == {0.0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op7_toxicity(spark, d).toPandas()
    lab = duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").df()
    x = got[got.held_out].merge(lab, on="doc_id")
    assert ((x.predicted == x.toxic).mean()) >= 0.95
    assert x[x.toxic == 0].predicted.sum() <= 1
