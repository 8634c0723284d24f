"""Toxic passages by maximum-scoring segments over token log-odds.

Fit (on a bounded sample of labelled rows): every word and every word prefix
of 3 to 8 letters gets a log-odds ratio between toxic and clean documents
under an informative Dirichlet prior (the pooled counts of both classes; a word
that follows itself counts once there, so that repetition is no evidence).
Features whose ratio is significant form the lexicon; a token scores the best
lower confidence bound among its features, every other token scores a small
negative constant, so that the expected score of clean text is negative.

Scan: Ruzzo and Tompa's linear-time algorithm finds every maximal scoring
segment of a whole text.  All tokens are scanned; the k-th of equal tokens in a row
scores a k-th, so a repeated word weighs more than one but repetition alone is no
passage.  Segments are kept if their expected number in clean
text of that length (an extreme-value law whose two constants are fitted on
clean sample documents) is below ``MAX_E``.  A logistic curve over the sum of the
log expectations of all segments that are rarer than one in a clean text of that
length, and over the positive score of the text's distinct words, turns them into
one probability per document.

Defined cases: a null or empty text has no tokens, no passages and the score
of the curve at "nothing found"; very long texts are scanned whole; repeated
labelled rows count once (the largest label wins); a null label is ignored; with
no toxic or no clean row in the sample every document scores the share of toxic
rows, or 0; an empty table gives an empty result.  Extra columns of the input stay
out of the result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.llm.shared import text_batches, worker_memo, written

MAX_LABELLED = 20_000     # rows of the labelled sample: bounds what is fitted and broadcast
PREFIXES = range(3, 9)
PRIOR = 50.0              # Dirichlet prior mass that is spread as the pooled counts ...
FLAT = 0.5                # ... and the pseudo-count that every feature has besides
Z_MIN = 3.0               # significance of a lexicon entry
BOUND = 1.64              # a token scores its log-odds less so many standard errors
MAX_E = 0.05              # expected chance segments per document that make one significant
MEMO = 300_000            # words whose score a worker remembers

PASSAGES = ("doc_id bigint, score double, n_tokens bigint, n_passages int, passages "
            "array<struct<first:bigint,last:bigint,score:double,expected:double>>")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    import regex
    return worker_memo("toxicity-words", lambda: regex.compile(r"\p{L}+")).findall((text or "").lower())


def features(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) >= n] + [word]


def sample(labels: DataFrame, label: str, is_held_out) -> DataFrame:
    """(doc_id, label) of at most MAX_LABELLED training rows, chosen by hash."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out)
            .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def fit(docs: DataFrame, labelled: DataFrame) -> dict:
    """The model as a small dictionary; `labelled` is what `sample` returned."""
    known = written(docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
                    .groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")))

    def count(batches):
        import pyarrow as pa
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            tokens = {0: 0, 1: 0}
            labels = iter(b.column(b.schema.get_field_index("label")).to_pylist())
            for texts in text_batches(b, "text"):
                for text in texts:
                    label, found = next(labels), words(text)
                    found = [w for w, before in zip(found, [None, *found]) if w != before]
                    tokens[label] += len(found)
                    seen[label].update(f for w in found for f in features(w))
            names = [*(seen[0] | seen[1]), ""]
            yield pa.RecordBatch.from_pydict({
                "feature": names,
                "toxic": [*(seen[1][f] for f in names[:-1]), tokens[1]],
                "clean": [*(seen[0][f] for f in names[:-1]), tokens[0]]},
                schema=pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    counts = (known.mapInArrow(count, "feature string, toxic bigint, clean bigint")
              .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    counts = written(counts)
    share = labelled.agg(F.avg("label")).first()[0] or 0.0
    total = counts.where("feature = ''").first()
    t_all, c_all = (float(total.toxic), float(total.clean)) if total else (0.0, 0.0)
    if not t_all or not c_all:
        return {"constant": float(share)}

    t, c = F.col("toxic"), F.col("clean")
    prior = FLAT + PRIOR * (t + c) / (t_all + c_all)

    def odds_of(n, all_of):
        return F.log((n + prior) / F.greatest(all_of + PRIOR - n - prior, F.lit(0.5)))
    odds, error = odds_of(t, t_all) - odds_of(c, c_all), F.sqrt(1 / (t + prior) + 1 / (c + prior))
    worth = odds - BOUND * error
    # The significant features only; the labelled sample bounds them.
    strong = (counts.where((t >= 2) & (F.col("feature") != "") & (odds / error >= Z_MIN) & (worth > math.log(3.0)))
              .select("feature", worth.alias("worth")))
    lexicon = {r.feature: r.worth for r in strong.collect()}

    model = {"lexicon": lexicon, "gap": 0.05}
    # Share of lexicon tokens in either class, and the clean documents' best segments.
    scanned = "doc_id bigint, label int, n bigint, hits bigint, best double, rare double, total double"
    rows = known.mapInArrow(_scanner(model), scanned).toPandas()     # at most MAX_LABELLED short rows
    rate = {k: (g.hits.sum() + 0.5) / (g.n.sum() + 1.0) for k, g in rows.groupby("label")}
    model["gap"] = float(max(0.02, math.log((1 - rate.get(0, 0.0)) / (1 - min(rate.get(1, 0.0), 0.9)))))
    clean, length = rows[rows.label == 0].best.to_numpy(), rows[rows.label == 0].n.to_numpy(float).clip(1)
    # Gumbel tail: P(best >= s) = 1 - exp(-K n exp(-lambda s)); clean rows without a hit are censored at 0.
    hit = clean > 0
    model["lambda"] = float(np.clip(1.0 / max(clean[hit].mean() / 2, 0.2), 0.3, 2.0)) if hit.any() else 1.0
    model["K"] = float((hit.sum() + 0.5) / length.sum()
                       * (np.exp(model["lambda"] * np.median(clean[hit])) if hit.any() else 1.0))
    rows = known.mapInArrow(_scanner(model), scanned).toPandas()     # with the fitted gap and law
    x = np.array([_evidence(*r) for r in rows[["n", "rare", "total"]].itertuples(index=False)])
    model["curve"] = _logistic(x, rows.label.to_numpy(float))
    return model


def _rarity(model: dict, n: int, found) -> float:
    """Sum of -log of the expected number in clean text over the segments where that is below one."""
    if not found or "K" not in model:
        return 0.0
    chance = math.log(model["K"] * max(n, 1))
    return sum(max(model["lambda"] * v - chance, 0.0) for _, _, v in found)


def _evidence(n, rare, total) -> list[float]:
    """What the final curve sees of one document."""
    return [1.0, min(rare, 30.0), min(total / math.sqrt(n + 10.0), 30.0), math.log1p(total)]


def _logistic(x, y, ridge=1e-2, rounds=100):
    """Ridge logistic regression by Newton steps on a handful of columns."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * max(1, len(y) / 100),
                               x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def segments(positions, scores, gap: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last, score) of a token sequence.

    `positions` are the places of positive tokens in rising order, every other
    place scores -gap.  Linear time: a candidate keeps a link to the nearest
    one on its left that starts lower, so no pair is compared twice.
    """
    kept: list[tuple] = []                    # left sum, right sum, first, last, link
    gained = 0.0
    for k, (at, s) in enumerate(zip(positions, scores)):
        low = gained - gap * (at - k)         # sum of all scores before this place
        gained += s
        high, first = low + s, at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= high:
                kept.append((low, high, first, at, j))
                break
            low, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, last, high - low) for low, high, first, last, _ in kept]


def _token_scores(model: dict):
    """A function from words to (places of positive tokens, their damped scores, sum over distinct words)."""
    lexicon, known = model["lexicon"], {}

    def score(found):
        out = [known.get(w) for w in found]
        for i, s in enumerate(out):
            if s is None:
                if len(known) > MEMO:
                    known.clear()
                w = found[i]
                out[i] = known[w] = max((lexicon.get(f, 0.0) for f in features(w)), default=0.0)
        at = [i for i, s in enumerate(out) if s > 0]
        damped, before, k = [], -2, 1
        for i in at:
            k = k + 1 if i == before + 1 and found[i] == found[before] else 1
            damped.append(out[i] / k)
            before = i
        return at, damped, sum({found[i]: out[i] for i in at}.values())
    return score


def _scanner(model: dict):
    def run(batches):
        import pyarrow as pa
        score = _token_scores(model)
        for b in batches:
            out = []
            for texts in text_batches(b, "text"):
                for text in texts:
                    found = words(text)
                    at, s, total = score(found)
                    all_of = segments(at, s, model["gap"])
                    out.append((len(found), len(at), max((x[2] for x in all_of), default=0.0),
                                _rarity(model, len(found), all_of), float(total)))
            ids, labels = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "label"))
            n, hits, *figures = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(n, pa.int64()), pa.array(hits, pa.int64()), *[pa.array(f, pa.float64()) for f in figures]],
                names=["doc_id", "label", "n", "hits", "best", "rare", "total"])
    return run


def _judge(model: dict):
    """A function from text to (score, number of tokens, significant passages)."""
    if "lexicon" not in model:
        return lambda text: (model["constant"], len(words(text)), [])
    score, gap, curve = _token_scores(model), model["gap"], model["curve"]

    def judge(text):
        found = words(text)
        at, s, total = score(found)
        all_of = segments(at, s, gap)
        x = _evidence(len(found), _rarity(model, len(found), all_of), float(total))
        p = 1 / (1 + math.exp(-min(max(sum(a * w for a, w in zip(x, curve)), -30), 30)))
        return p, len(found), [
            {"first": i, "last": j, "score": v, "expected": e} for i, j, v in all_of
            if (e := model["K"] * len(found) * math.exp(-model["lambda"] * v)) <= MAX_E]
    return judge


def toxic_passages(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: score and every significant toxic passage
    (word places first..last, score, expected number by chance)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)     # bounded by the labelled sample

    def run(batches):
        import pyarrow as pa
        judge = _judge(sent.value)
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()),
                                    ("expected", pa.float64())]))
        for b in batches:
            out = [judge(text) for texts in text_batches(b, "text") for text in texts]
            p, n, passages = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(p, pa.float64()), pa.array(n, pa.int64()),
                 pa.array([len(x) for x in passages], pa.int32()), pa.array(passages, spans)],
                names=["doc_id", "score", "n_tokens", "n_passages", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PASSAGES)


def without_toxic(docs: DataFrame, model: dict, threshold: float) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        judge = _judge(sent.value)
        for b in batches:
            yield b.filter(pa.array([judge(text)[0] < threshold for texts in text_batches(b, "text")
                                     for text in texts], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
