"""Benchmark decontamination by a broadcast set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words; an item's windows are its runs
of ``n`` words (an item of fewer words is one window).  The hash set of the
windows is broadcast in blocks of at most ``BLOCK`` windows and ``BYTES`` bytes of
them (one pass over the documents for each block, usually one), so what is
broadcast has a fixed bound; a worker indexes a block once.  A pass maps document words to the block's vocabulary, hashes windows of
known words with numpy, looks them up in the sorted hash set and verifies every
hit word by word.

Defined cases: a null or empty text has no words and no hits; an item without
words has no windows; equal windows of several items count for each; repeated
document rows are scanned alike; a null item_id counts as an item without a
name (no entry in the list); very long texts are scanned whole, one at a time;
an empty table gives an empty result, and documents are clean if there are no
items.  Extra columns stay out of the result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.llm.shared import latest, text_batches, worker_memo, written

N = 10
BLOCK = 250_000              # windows broadcast at once (a worker's index of them takes about 200 MB) ...
BYTES = 32 << 20             # ... and their bytes
_MULTIPLIER = 0x9E3779B97F4A7C15

HITS = "doc_id {id}, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and non-ASCII bytes."""
    import re
    find = worker_memo("decontaminate-words", lambda: re.compile(rb"[0-9a-z\x80-\xff]+").findall)
    return find((text or "").encode().lower())


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item, window): the distinct windows of every item, as space-joined words."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            items, grams = [], []
            ids = iter(b.column(b.schema.get_field_index("item")).to_pylist())
            for texts in text_batches(b, "text"):
                for text in texts:
                    item, found = next(ids), words(text)
                    for g in {b" ".join(found[i:i + n]) for i in range(max(len(found) - n, 0) + 1)} - {b""}:
                        items.append(item), grams.append(g.decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(grams, pa.string())],
                                             names=["item", "window"])
    return (benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
            .mapInArrow(run, "item string, window string").distinct())


class _Block:
    """One block of windows, indexed: vocabulary, sorted hashes by length, and the windows behind them."""

    def __init__(self, rows):
        self.items: dict[tuple, list] = {}
        self.vocabulary: dict[bytes, int] = {}
        for item, window in rows:
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.encode().split(b" "))
            self.items.setdefault(key, []).append(item)
        by_length: dict[int, list] = {}
        for key in self.items:
            by_length.setdefault(len(key), []).append(key)
        self.hashes = {n: np.unique(_window_hashes(np.array(keys, np.uint64).ravel(), n)[::n])
                       for n, keys in by_length.items()}

    def find(self, found: list[bytes]):
        """Places (first, length) of the verified hits, and the items they belong to."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        hits, items = [], set()
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])       # windows of known words only
            if not len(at):
                continue
            h = _window_hashes(ids, n)[at]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[place] == h].tolist():
                owners = self.items.get(tuple(ids[i:i + n].tolist()))   # the exact check
                if owners:
                    hits.append((i, n))
                    items.update(x for x in owners if x is not None)
        return hits, items


def _window_hashes(ids, n: int):
    """A polynomial hash of each run of n word numbers."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h + ids[i:len(ids) - n + 1 + i]) * np.uint64(_MULTIPLIER)
            h ^= h >> np.uint64(29)
    return h


def _blocks(docs: DataFrame, benchmark: DataFrame, n: int):
    """Broadcasts of the windows, at most BLOCK in each, one after the other: (broadcast, is it the last)."""
    grams = written(windows(benchmark, n))
    rows, size = grams.agg(F.count(F.lit(1)), F.sum(F.octet_length("window"))).first()
    blocks = max(1, -(-rows // (BLOCK // 2)), -(-(size or 0) // (BYTES // 2)))     # half full on average, so that both hold
    for at in range(blocks):
        own = grams.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == at)
        yield docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()]), at == blocks - 1


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items[, text]): merged word ranges hit by any window, for every document row."""
    kind, out, first = dict(docs.dtypes)["doc_id"], docs.select("doc_id", "text"), True
    for sent, last in _blocks(docs, benchmark, n):
        out = _scan(out, sent, kind, first, with_text=keep_text or not last)
        out, first = out if last else written(out), False
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of the benchmark occurs."""
    out = docs
    for sent, last in _blocks(docs, benchmark, n):
        def run(batches, sent=sent, token=uuid.uuid4().hex):
            import pyarrow as pa
            block = latest("decontaminate-block", token, lambda: _Block(sent.value))
            for b in batches:
                yield b.filter(pa.array([not block.find(words(text))[0] for texts in text_batches(b, "text")
                                         for text in texts], pa.bool_()))
        out = out.mapInArrow(run, docs.schema)
        out = out if last else written(out)
    return out


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text): the texts with every hit span cut out, from its first to its last word."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            spans = iter(b.column(b.schema.get_field_index("spans")).to_pylist())
            texts = [_cut(text, next(spans)) for some in text_batches(b, "text") for text in some]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return (contamination(docs, benchmark, n, keep_text=True).select("doc_id", "spans", "text")
            .mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string"))


def _cut(text: str | None, spans: list[dict]):
    import re
    if not spans:
        return text
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", data.lower())]
    out, at = [], 0
    for s in spans:
        out.append(data[at:places[s["first"]][0]])
        at = places[s["last"]][1]
    return b"".join([*out, data[at:]]).decode()


def _scan(docs: DataFrame, sent, kind: str, first: bool, with_text: bool) -> DataFrame:
    """One pass: adds a block's hits to those of earlier passes; the text goes along where asked for."""
    token = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        block = latest("decontaminate-block", token, lambda: _Block(sent.value))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            earlier = None if first else zip(col("spans").to_pylist(), col("items").to_pylist())
            counts, spans, items = [], [], []
            for texts in text_batches(b, "text"):
                for text in texts:
                    found = words(text)
                    hits, owners = block.find(found)
                    ranges = [(i, i + n - 1) for i, n in hits]
                    if earlier is not None:
                        before, named = next(earlier)
                        ranges += [(s["first"], s["last"]) for s in before]
                        owners |= set(named)
                    counts.append(len(found)), spans.append(_merged(ranges)), items.append(sorted(owners))
            arrays = [col("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, span),
                      pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "spans", "items"]
            if with_text:
                arrays.append(col("text")), names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return docs.mapInArrow(run, HITS.format(id=kind) + (", text string" if with_text else ""))


def _merged(ranges):
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def n_hit():
    """Column: the number of words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
