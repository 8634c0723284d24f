"""A quality classifier on random-indexing word vectors.

Every token has an index vector: a few +1 and -1 among ``DIM`` places, given by a
hash of the token.  Its context vector is the sum of the index vectors of its
neighbours (``WINDOW`` to either side) over all documents of the corpus, its word
vector the index vector plus the context vector scaled to the same length (the
index vector alone if the corpus does not hold the token).  All tokens take
part: documents are read once into slabs, the distinct words of about ``SLAB``
tokens with partial context vectors (classes of like frequency apart, which
packs them well) and the texts as word numbers with counts; parts of the hashed
vocabulary add the vectors up and answer every slab with the word vectors of its
words in steps of ``STEP`` (rounded up or down by a hash of word and place, in
proportion, so that sums over words are not biased).  Slabs go through these two
shuffles as packed arrays and are not written in between.  The tokens of a part (24 MB
of text) are told apart by 48-bit hashes.  A document's vector is the mean over its tokens, together with a few figures of its shape; a
network of two layers, fitted with numpy on a bounded labelled sample, scores it,
and a temperature fitted on a part of the sample that the network did not see
calibrates the probability.

Defined cases: a null or empty text has the zero vector and the score the
network gives it; a very long text may make its slab larger than others; repeated
labelled rows count once (the largest label wins, with the largest vector); a
null label is ignored; a sample of one class gives every document that class's
share; an empty table gives an empty result.  Extra columns stay out of the result.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.llm.lm_score import mix, pack, pack_bytes, pack_keys, unpack, unpack_bytes, unpack_keys
from kinrank.llm.shared import text_batches, worker_memo, written
from kinrank.llm.toxicity import sample

DIM, MARKS = 48, 6           # length of the vectors; how many places of an index vector are not zero
WINDOW = 2
SLAB = 2_000_000             # tokens of a slab
CLASSES = (2, 4, 31)         # occurrences in a slab that part its words into classes
STEP = 1.0                   # of the word vectors that are sent
KEY = (1 << 48) - 1          # bits of a token's hash within its part
PART_BYTES = 24 << 20        # bytes of text for each part of the vocabulary
CHUNK = 1 << 16              # tokens whose vectors are added up at once
HIDDEN = 24
SHAPE = 6                    # figures of a document's shape
__all__ = ["fit", "sample", "scores"]


def tokens(text: str | None) -> list[str]:
    """Runs of letters, of digits, and of other visible characters."""
    import re
    find = worker_memo("quality-tokens", lambda: re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+").findall)
    return find(text or "")


def hashes(words: list[str], parts: int):
    """Numbers of tokens whose remainder by `parts` is the token's part."""
    from xxhash import xxh3_64_intdigest
    h, n = np.fromiter((xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)), np.uint64(parts)
    return (h // n & np.uint64(KEY)) * n + h % n


def marks(h):
    """The places and signs of the index vectors behind the hashes, mark by mark."""
    h = mix(h)
    for m in range(MARKS):
        bits = (h >> np.uint64(10 * m)) & np.uint64(1023)
        yield (bits >> np.uint64(1)).astype(np.int64) % DIM, np.where(bits & np.uint64(1), 1.0, -1.0)


def index_vectors(h):
    """The sparse ternary vectors of hashed tokens, one row each."""
    out, rows = np.zeros((len(h), DIM), np.float32), np.arange(len(h))
    for place, sign in marks(h):
        out[rows, place] += sign           # a row has one place in each mark
    return out


def _shape(found: list[str], low: list[str]) -> list[float]:
    n = len(found)
    if not n:
        return [0.0] * SHAPE
    return [math.log1p(n), len(set(low)) / n, sum(map(eq, low, low[1:])) / n,
            sum(map(str.isupper, found)) / n, sum(map(len, found)) / n / 10, 1 - sum(map(str.isalnum, found)) / n]


def pack_signed(x) -> bytes:
    """Whole numbers byte by byte, lowest bytes first: the others are mostly zeros."""
    x = ((x << 1) ^ (x >> (8 * x.itemsize - 1))).ravel()
    return pack(x.view(np.uint8).reshape(-1, x.itemsize).T.ravel())


def unpack_signed(data, kind):
    """What pack_signed had of rows of DIM numbers."""
    x = np.ascontiguousarray(unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return ((x >> 1) ^ -(x & 1)).reshape(-1, DIM)


def pack_vectors(x) -> bytes:
    """Rows of DIM whole numbers: two to a byte if all are small, else byte by byte."""
    if np.abs(x).max(initial=0) > 7:
        return b"w" + pack_signed(x.astype(np.int32))
    x = (x + 8).astype(np.uint8)
    return b"n" + pack((x[:, ::2] << 4 | x[:, 1::2]).ravel())


def unpack_vectors(data):
    if data[:1] == b"w":
        return unpack_signed(data[1:], np.int32)
    x = unpack(data[1:], np.uint8).reshape(-1, DIM // 2)
    return np.stack([x >> 4, x & 15], axis=2).reshape(-1, DIM).astype(np.int32) - 8


def contexts(x, sizes, h):
    """Sums of the neighbours' index vectors over the texts of a slab, one row a word."""
    doc, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(h) * DIM, np.int32)
    spots = [(place, sign.astype(np.int32)) for place, sign in marks(h)]
    for at in range(0, len(x), CHUNK):
        for o in range(1, WINDOW + 1):
            end = min(at + CHUNK, len(x) - o)
            same = np.flatnonzero(doc[at:end] == doc[at + o:end + o]) + at
            for word, near in ((x[same], x[same + o]), (x[same + o], x[same])):
                for place, sign in spots:
                    np.add.at(out, word * DIM + place[near], sign[near])
    return out.reshape(-1, DIM)


SLABS = ("part int, slab bigint, class int, a binary, b binary, ask boolean, ids array<bigint>, sizes binary, shapes binary, "
         "words bigint")


def slabs(docs: DataFrame, parts: int, told: bool, ask: bool) -> DataFrame:
    """Two kinds of rows by part: texts (ids not null) as rising (document, word number) keys (a) with counts (b), and
    classes of vocabularies as hashes (a), with partial context vectors (b) if `told`, that `ask` for word vectors."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.binary(),
                 pa.binary(), pa.int64()]
        serial = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal index, numbers, ids, sizes, shapes, serial
            h, x = hashes(list(index), parts), np.array(numbers, np.int64)
            part, classes = (h % np.uint64(parts)).astype(np.int64), len(CLASSES) + 1
            group = part * classes + np.digitize(np.bincount(x, minlength=len(h)), CLASSES)
            order = np.lexsort((h, group))                       # words by part, class and hash
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            x, h, group = place[x], h[order], group[order]
            sums = contexts(x, sizes, h) if told else None
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(h)]
            rows = [(int(group[i]) // classes, serial, int(group[i]) % classes, pack_keys(h[i:j] // np.uint64(parts)),
                     pack_vectors(sums[i:j]) if told else None, ask, None, None, None, None) for i, j in zip(cuts, cuts[1:])]
            if ask:
                key = np.repeat(np.arange(len(sizes)) * len(h), sizes) + x
                key, n = np.unique(key, return_counts=True)
                steps = np.diff(key, prepend=0)
                # Two numbers a key: words skipped, and documents begun since the one before.
                packed = pack_bytes(steps % max(len(h), 1)), pack_bytes(steps // max(len(h), 1))
                rows.append((serial % parts, serial, None, packed[0], pack_bytes(n), None, ids, pack_bytes(np.array(sizes)),
                             pack(np.array(shapes, np.float32)), len(h)))
                rows.append((serial % parts, serial, -1, packed[1], None, None, [], None, None, None))
            index, numbers, ids, sizes, shapes = {}, [], [], [], []
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=[c.split(" ")[0] for c in SLABS.split(", ")])

        index, numbers, ids, sizes, shapes = {}, [], [], [], []
        for b in batches:
            doc = iter(b.column(0).to_pylist())
            for texts in text_batches(b, "text"):
                for text in texts:
                    found = tokens(text)
                    low, number = list(map(str.lower, found)), index.setdefault
                    numbers += [number(w, len(index)) for w in low]
                    ids.append(next(doc)), sizes.append(len(low)), shapes.extend(_shape(found, low))
                    if len(numbers) >= SLAB:
                        yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SLABS)


def word_vectors(h, total):
    """Index vectors plus context sums scaled to the same length, in whole STEPs."""
    scale = math.sqrt(MARKS) / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    up = mix(h[:, None] * np.uint64(DIM) + np.arange(DIM, dtype=np.uint64)) / 2.0 ** 64
    return np.floor((index_vectors(h) + total * scale) / STEP + up * (1 - 1e-9)).astype(np.int8)


def answered(read: DataFrame, parts: int) -> DataFrame:
    """The rows that ask, with the vectors of their words (b), and the texts as they are, for the slabs."""
    def run(t):
        import pyarrow as pa
        t = t.combine_chunks()
        vocabulary = [i for i, x in enumerate(t.column("ids").is_null().to_pylist()) if x]
        n, part = np.uint64(parts), np.uint64(t.column("part")[0].as_py())
        keys = [unpack_keys(t.column("a")[i].as_py()) * n + part for i in vocabulary]
        unique, at = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]), return_inverse=True)
        total, ends = np.zeros((len(unique), DIM), np.int64), np.cumsum([len(k) for k in keys])
        for i, k, end in zip(vocabulary, keys, ends):
            sums = t.column("b")[i].as_py()
            if sums:
                total[at[end - len(k):end]] += unpack_vectors(sums)       # a class has a word once
        sizes = [len(k) for k in keys]
        del keys
        vectors, rows = np.empty((len(unique), DIM), np.int8), []
        for i in range(0, len(unique), CHUNK):
            vectors[i:i + CHUNK] = word_vectors(unique[i:i + CHUNK], total[i:i + CHUNK].astype(float))
        del total
        place = {i: n for n, i in enumerate(vocabulary)}
        names = ("part", "slab", "class", "a", "b", "ids", "sizes", "shapes", "words")
        for i in range(len(t)):
            row = [t.column(c)[i].as_py() for c in names]
            if i in place:
                if not t.column("ask")[i].as_py():
                    continue
                of = at[ends[place[i]] - sizes[place[i]]:ends[place[i]]]
                row[3], row[4] = None, pack_vectors(vectors[of])
            rows.append(row)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds)], names=list(names))
    return read.groupBy("part").applyInArrow(
        run, "part int, slab bigint, class int, a binary, b binary, ids array<bigint>, sizes binary, shapes binary, words bigint")


def pooled(read: DataFrame, parts: int) -> DataFrame:
    """(doc_id, x): the vector of every document in the slabs, as 16-bit floats."""
    def pool(t):
        import pyarrow as pa
        t = t.combine_chunks()
        kind, part = t.column("class").to_pylist(), t.column("part").to_pylist()
        text, more = kind.index(None), kind.index(-1)
        get = lambda c, i=text: t.column(c)[i].as_py()
        sizes, n = unpack_bytes(get("sizes")).astype(np.int64), unpack_bytes(get("b")).astype(np.float32)
        width = max(get("words"), 1)
        key = np.cumsum(unpack_bytes(get("a")).astype(np.int64) + unpack_bytes(get("a", more)).astype(np.int64) * width)
        replies = sorted((part[i], kind[i], i) for i in range(len(kind)) if i not in (text, more))
        vectors = np.concatenate([np.empty((0, DIM), np.int8), *(unpack_vectors(get("b", i)).astype(np.int8) for _, _, i in replies)])
        out = np.zeros((len(sizes), DIM))
        for at in range(0, len(key), CHUNK):
            own = key[at:at + CHUNK] // width
            first = np.flatnonzero(np.diff(own, prepend=-1))
            each = vectors[key[at:at + CHUNK] % width] * n[at:at + CHUNK, None]
            out[own[first]] += np.add.reduceat(each, first, dtype=np.float64)
        shapes = unpack(get("shapes"), np.float32).reshape(-1, SHAPE)
        out = np.concatenate([out * STEP / np.maximum(sizes, 1)[:, None], shapes], axis=1).astype("<f2")
        ids = t.column("ids").slice(text, 1).combine_chunks().flatten()
        return pa.table([ids, pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "x"])
    return answered(read, parts).groupBy("slab").applyInArrow(pool, "doc_id bigint, x binary")


def _vectors(packed):
    return np.frombuffer(b"".join(packed), "<f2").astype(float).reshape(-1, DIM + SHAPE)


def fit(docs: DataFrame, labelled: DataFrame) -> dict:
    """The classifier; `labelled` is what `sample` returned, a bounded number of rows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    model = {"docs": docs, "parts": parts, "pooled": written(pooled(slabs(docs, parts, told=True, ask=True), parts))}
    rows = (model["pooled"].join(F.broadcast(labelled), "doc_id").groupBy("doc_id")
            .agg(F.max("label").alias("label"), F.max("x").alias("x"))
            .toPandas().sort_values("doc_id"))             # at most MAX_LABELLED rows
    y = rows.label.to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return model | train(_vectors(map(bytes, rows.x)), y)


def train(x, y, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3) -> dict:
    """Two layers by Adam on four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(7)
    apart = np.arange(len(y)) % 5 == 4
    mean, scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3
    z = (x - mean) / scale
    w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    a, t = z[~apart], y[~apart]
    for step in range(1, rounds + 1):
        h = np.tanh(a @ w[0] + w[1])
        off = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t) / len(t)
        back = np.outer(off, w[2]) * (1 - h * h)
        grads = [a.T @ back + decay * w[0], back.sum(axis=0), h.T @ off + decay * w[2], np.array([off.sum()])]
        for p, g, m, v in zip(w, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    out = {"mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    logits = _logits(out, x[apart])

    def loss(s):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / s, -30, 30))), 1e-9, 1 - 1e-9)
        return -(y[apart] * np.log(p) + (1 - y[apart]) * np.log(1 - p)).mean()
    if apart.any():
        out["temperature"] = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return out


def _logits(model, x):
    z = np.clip((x - model["mean"]) / model["scale"], -10, 10)
    w = model["w"]
    return np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document row."""
    if "constant" in model:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model["constant"]).alias("score"))
    vectors = model["pooled"] if docs is model["docs"] else pooled(
        slabs(docs, model["parts"], told=False, ask=True).unionByName(slabs(model["docs"], model["parts"], told=True, ask=False)),
        model["parts"])
    network = {k: model[k] for k in ("mean", "scale", "w", "temperature")}

    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = _vectors(b.column(1).to_pylist())
            z = np.clip(_logits(network, x) / network["temperature"], -30, 30)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])
    return vectors.mapInArrow(run, "doc_id bigint, score double")
