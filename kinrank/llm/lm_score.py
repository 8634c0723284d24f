"""Language-model scores from a log-frequency Bloom filter.

Documents are read once into slabs: the distinct words of about ``SLAB`` tokens
and the texts as word numbers.  Slabs and parts of the hashed vocabulary meet
in two shuffles of packed arrays (a slab sends each part its words with their
training counts, the part answers with the corpus-wide counts and discounted
masses), so every document gets the exact count of each of its words; this gives
the base score and the unigram backoff.

Before that, a slab sends its distinct bigrams, held-out ones included, as 48-bit
keys to parts of the hashed bigrams.  A part adds up the training counts and
enters the bigrams seen ``MIN_COUNT`` times or more, at any size of the corpus and
however rare their words, into its block of a Bloom filter: a bigram of quantised
log count q = 1 + floor(log_BASE c) is entered q times, as (bigram, 1) to
(bigram, q).  The filter grows with the text, so it isn't broadcast whole: each
block goes to the task that probes it, which holds all slabs' keys of that part,
finds every count by probing (bigram, 1), (bigram, 2), ... until a probe fails,
and answers the slabs with one byte a bigram.  Every bigram is probed once, so
the work is linear in the text.  With absolute discounting,

    P(w | v) = max(l(v, w) - D, 0) / c(v) + (1 - S(v) / c(v)) P(w),

where l(v, w) is the smallest count of the bigram's level, S(v) the sum of
l - D over the counted bigrams that begin with v, and P(w) gives unseen words
together the Good-Turing share of the tokens.  As l is never above the count,
S(v) < c(v): the probabilities of the known words and of an unseen one add up
to 1 in every context, but for the filter's false positives, and a false
positive's share is limited to S(v), so that no probability exceeds 1.  The
score is the sum of log10 P over the words and the end of a text; the end also
serves as the context of the first word.

Sums of packed arrays stay linear in the input: there are never more of them
than distinct (slab, word) pairs.  Words are told apart by 64-bit hashes, the
bigrams of a part (12 MB of text) by 48 bits.

Defined cases: a null or empty text has just its end token; very long texts are
slabs of their own; a null doc_id counts as training; repeated rows are scored
and counted each; without training rows both scores equal the base formula; an
empty table gives an empty result.  Extra columns stay out of the result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.llm.shared import held_out, text_batches, written

SLAB = 750_000               # tokens of a slab
PART_BYTES = 12 << 20        # bytes of text for each part of the words and bigrams
KEY = (1 << 48) - 1          # bits of a bigram's key within its part
MIN_COUNT = 2                # of a bigram, whatever the size of the corpus
BASE = 1.5                   # of the logarithm that quantises counts
DISCOUNT = 0.75
PROBES, BITS = 6, 10         # hash functions, and bits for each entry
UNIT = 0.25                  # discounted masses are whole multiples of it
END = b"\n"                  # no word holds white space


def pack(x) -> bytes:
    import pyarrow as pa
    return len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) \
        if len(x) else b""


def unpack(data, kind):
    import pyarrow as pa
    if not data:
        return np.empty(0, kind)
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def pack_sorted(x) -> bytes:
    """Rising integers as their differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data):
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(x):
    """A 64-bit finaliser: spreads integer keys over all bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between x20 and x09-x0D, and the end."""
    return [*(text or "").encode().lower().split(), END]


def slabs(docs: DataFrame, parts: int) -> DataFrame:
    """Two kinds of rows: texts as word numbers, with the words' hashes (part null), and vocabularies by part."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest
        schema = pa.schema([("slab", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()),
                            ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                            ("sizes", pa.list_(pa.int32())), ("train", pa.int64())])
        serial = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal index, numbers, ids, held, sizes, serial
            h = np.fromiter(map(xxh3_64_intdigest, index), np.uint64, len(index))
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((h, part))                       # words by part, then by hash
            place = np.empty(len(h), np.uint32)
            place[order] = np.arange(len(h), dtype=np.uint32)
            x = place[np.array(numbers, np.int64)]
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(x[train], minlength=len(h)).astype(np.uint32)
            h, part = h[order], part[order]
            rows = [(serial, None, pack(x), pack_sorted(h), ids, held, sizes, int(train.sum()))]
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows += [(serial, p, pack_sorted(h[a:b]), pack(counts[a:b]), None, None, None, None)
                     for p, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())) if b > a]
            index, numbers, ids, held, sizes = {}, [], [], [], []
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        index, numbers, ids, held, sizes = {}, [], [], [], []
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for texts in text_batches(b, "text"):
                for text in texts:
                    doc, out = next(rows)
                    number, found = index.setdefault, tokens(text)
                    numbers += [number(w, len(index)) for w in found]
                    ids.append(doc), held.append(out), sizes.append(len(found))
                    if len(numbers) >= SLAB:
                        yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held", "text").mapInArrow(
        run, "slab bigint, part int, a binary, b binary, ids array<bigint>, held array<boolean>, "
             "sizes array<int>, train bigint")


def _totals(keys: list, counts: list, kind=np.int64):
    """Sum of the counts of equal keys: distinct keys, sums, and each entry's place among them."""
    unique, at = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]), return_inverse=True)
    return unique, np.bincount(at, np.concatenate([np.empty(0, kind), *counts]), len(unique)).astype(kind), at


def answers(vocabulary: DataFrame, heads: DataFrame) -> DataFrame:
    """For each slab and part, in the slab's order, the corpus counts of its words and the discounted
    mass (in UNITs) of the bigrams that each begins; and for each part (slab null) its statistics."""
    def run(t, m):
        import pyarrow as pa
        slab = t.column("slab").to_numpy()
        keys = [unpack_sorted(x.as_py()) for x in t.column("a")]
        unique, total, at = _totals(keys, [unpack(x.as_py(), np.uint32) for x in t.column("b")])
        starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        weight, order = np.zeros(len(unique), np.int64), np.argsort(slab)
        for s, place, mass in zip(m.column("slab"), m.column("a"), m.column("b")):
            row = order[np.searchsorted(slab, unpack(s.as_py(), np.int64), sorter=order)]
            np.add.at(weight, at[starts[row] + unpack(place.as_py(), np.uint32)], unpack(mass.as_py(), np.uint32))
        rows = []
        for i, part in enumerate(t.column("part").to_pylist()):
            of = at[starts[i]:starts[i + 1]]
            rows.append((int(slab[i]), part, pack(total[of].astype(np.uint64)), pack(weight[of]), None, None, None))
        rows.append((None, None, None, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum())))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=["slab", "part", "a", "b", "n", "v", "ones"])
    return vocabulary.groupBy("part").cogroup(heads.groupBy("part")).applyInArrow(
        run, "slab bigint, part int, a binary, b binary, n bigint, v bigint, ones bigint")


def _before(x, sizes):
    """For each token the word number before it; the end stands before a text's first word."""
    before = np.empty_like(x)
    before[1:] = x[:-1]            # the token before a text's first one is the end of the text before
    if len(x):
        before[0] = x[np.sum(sizes[:1]) - 1]
    return before


def bigram_key(head, tail):
    """The 64-bit key of a bigram, from the hashes of its words."""
    with np.errstate(over="ignore"):
        return mix(mix(head) + tail)


def pack_bytes(x, kind: str = "<u4") -> bytes:
    """Whole numbers byte by byte, lowest bytes first: the others are mostly zeros."""
    return pack(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.ravel())


def unpack_bytes(data, kind: str = "<u4"):
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(x) -> bytes:
    """Rising keys of a part, as their differences byte by byte."""
    return pack_bytes(np.diff(x, prepend=x.dtype.type(0)), "<u8")


def unpack_keys(data):
    return np.cumsum(unpack_bytes(data, "<u8"), dtype=np.uint64)


def slab_bigrams(x, sizes, h, parts: int):
    """The distinct bigrams of a slab: (head, key, part, order by part and key, each token's bigram)."""
    pair, back = np.unique(_before(x, sizes) * len(h) + x, return_inverse=True)
    head = pair // max(len(h), 1)
    key = bigram_key(h[head], h[pair - head * len(h)])
    part, key = (key % np.uint64(parts)).astype(np.int64), key // np.uint64(parts) & np.uint64(KEY)
    return head, key, part, np.lexsort((key, part)), back


def bigrams(texts: DataFrame, parts: int) -> DataFrame:
    """Rows by part: a slab's bigram keys, rising (key), their training counts (n), and the place of each first
    word in the slab's vocabulary: its part (home) and its number there (place)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):                    # one slab unpacked at a time
                slab, a, b, held, sizes = (batch.column(c)[i].as_py() for c in ("slab", "a", "b", "held", "sizes"))
                x, h = unpack(a, np.uint32).astype(np.int64), unpack_sorted(b)
                head, key, part, order, back = slab_bigrams(x, sizes, h, parts)
                n = np.bincount(back[np.repeat(~np.array(held, bool), sizes)], minlength=len(key))
                word_part = (h % np.uint64(parts)).astype(np.int64)
                first = np.searchsorted(word_part, np.arange(parts))
                cut = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                rows = []
                for p, at in enumerate(order[i:j] for i, j in zip(cut, cut[1:])):
                    if len(at):
                        home = word_part[head[at]]
                        rows.append((p, slab, pack_keys(key[at]), pack(n[at].astype(np.uint32)), pack_bytes(home),
                                     pack_bytes(head[at] - first[home])))
                if rows:
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["part", "slab", "key", "n", "home", "place"])
    return texts.select("slab", "a", "b", "held", "sizes").mapInArrow(
        run, "part int, slab bigint, key binary, n binary, home binary, place binary")


def levels(pairs: DataFrame) -> DataFrame:
    """For each slab and part the levels of its bigrams (a), probed from the part's filter block; and (`home` not
    null) the discounted masses of first words by part of the vocabulary: slab, place there, and mass."""
    def run(t):
        import pyarrow as pa
        part, slab = t.column("part")[0].as_py(), t.column("slab").to_numpy()
        keys = [unpack_keys(x.as_py()) for x in t.column("key")]
        joined = np.concatenate(keys)
        key, first, at = np.unique(joined, return_index=True, return_inverse=True)
        del joined
        total = np.bincount(at, np.concatenate([unpack(x.as_py(), np.uint32) for x in t.column("n")]), len(key)).astype(np.int64)
        del at
        keep = total >= MIN_COUNT
        first, block = first[keep], build_block(key[keep], total[keep])
        mass = ((lowest(level(total[keep])) - DISCOUNT) / UNIT).astype(np.uint32)
        del key, total
        # The first slab that holds a counted bigram names its first word.
        ends = np.cumsum([len(k) for k in keys])
        row = np.searchsorted(ends, first, "right")
        home, place = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        rows = []
        for i in range(len(keys)):
            own = np.flatnonzero(row == i)
            at = first[own] - (ends[i] - len(keys[i]))
            home[own], place[own] = (unpack_bytes(t.column(c)[i].as_py())[at] for c in ("home", "place"))
            rows.append((int(slab[i]), part, pack(probe(block, keys[i]).astype(np.uint8)), None, None, None))
            keys[i] = keys[i][:0]
        order = np.argsort(home, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(own):
                rows.append((None, int(home[own[0]]), pack(place[own].astype(np.uint32)), pack(mass[own]), pack(slab[row[own]]), True))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["slab", "part", "a", "b", "slabs", "home"])
    return pairs.groupBy("part").applyInArrow(run, "slab bigint, part int, a binary, b binary, slabs binary, home boolean")


def entries(key, q):
    """What the filter is probed with for the q-th time."""
    with np.errstate(over="ignore"):
        return mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(q))


def _bits(entry, size: int):
    """The places of an entry in a block of `size` bits."""
    with np.errstate(over="ignore"):
        first, step = entry, mix(entry ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        return [((first + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(PROBES)]


def level(count):
    """Quantised log count."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def lowest(q):
    """The smallest count of a level (0 of level 0)."""
    counts = np.array([0.0, *[float(math.ceil(BASE ** (j - 1) - 1e-6)) for j in range(1, 120)]])
    return counts[q]


def probability(own, before, mass, q, model):
    """P(w | v) from the counts of w and v, the mass S(v) and the level of the bigram."""
    n, v, unseen = model["n"], model["v"], model["unseen"]
    p = np.where(own > 0, own - unseen, unseen * v) / n
    c = np.maximum(before, 1)
    gain = np.where(q > 0, np.minimum(lowest(q) - DISCOUNT, mass), 0.0) / c
    return np.minimum(gain + (1.0 - mass / c) * p, 1.0)


def build_block(key, count) -> bytes:
    """The filter block of bigram keys with their counts, as packed bits."""
    q = level(count)
    size = max(64, BITS * int(q.sum()))
    bits = np.zeros(size, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _bits(entries(key[q >= j], j), size):
            bits[at] = True
    return size.to_bytes(8, "little") + np.packbits(bits).tobytes()


def probe(block: bytes, key):
    """Quantised counts of bigram keys (0: not in the filter), by repeated membership probes."""
    size = int.from_bytes(block[:8], "little")
    data = np.frombuffer(block, np.uint8, offset=8)
    q, live, j = np.zeros(len(key), np.int64), np.arange(len(key)), 1
    while len(live) and j < 119:
        there = np.ones(len(live), bool)
        for at in _bits(entries(key[live], j), size):
            there &= (data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        live = live[there]
        q[live] = j
        j += 1
    return q


def score(docs: DataFrame, divisor: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    read = written(slabs(docs.withColumn("held", held_out(divisor)), parts))
    texts, vocabulary = read.where("part is null"), read.where("part is not null")
    n_train = texts.agg(F.sum("train")).first()[0] or 0
    found = written(levels(bigrams(texts, parts)))
    answered = written(answers(vocabulary.select("slab", "part", "a", "b"),
                               found.where("home").select("part", F.col("slabs").alias("slab"), "a", "b")))
    replies, facts = answered.where("slab is not null"), answered.where("slab is null")
    v, ones = facts.agg(F.sum("v"), F.sum("ones")).first()
    v, ones = v or 0, ones or 0
    left = texts.select("slab", "a", "b", "ids", "held", "sizes").groupBy("slab")
    right = (replies.select("slab", "part", "a", "b", F.lit(False).alias("pair"))
             .unionByName(found.where("home is null").select("slab", "part", "a", "b", F.lit(True).alias("pair"))).groupBy("slab"))
    model = {"n": n_train, "v": v, "unseen": min(max(ones / v, 0.1), 0.9) if v else 0.0, "parts": parts}
    scored = left.cogroup(right).applyInArrow(_scorer(model), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"),
                         "base_score", "score")


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scorer(model):
    def run(d, r):
        import pyarrow as pa
        x, h = unpack(d.column("a")[0].as_py(), np.uint32).astype(np.int64), unpack_sorted(d.column("b")[0].as_py())
        sizes = np.array(d.column("sizes")[0].as_py(), np.int64)
        pair, part = r.column("pair").to_numpy(zero_copy_only=False).astype(bool), r.column("part").to_numpy()

        def joined(column, rows, kind):
            at = np.flatnonzero(rows)
            at = at[np.argsort(part[at])]
            return np.concatenate([np.empty(0, kind), *(unpack(r.column(column)[i].as_py(), kind) for i in at.tolist())])
        counts, mass = joined("a", ~pair, np.uint64).astype(np.int64), joined("b", ~pair, np.int64) * UNIT
        c, before = counts[x], _before(x, sizes)
        n, v = model["n"], model["v"]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        each = base
        if n:
            _, key, _, order, back = slab_bigrams(x, sizes, h, model["parts"])
            q = np.empty(len(key), np.int64)
            q[order] = joined("a", pair, np.uint8)
            each = np.log10(probability(c, counts[before], mass[before], q[back], model))
        ends = np.cumsum(sizes) - sizes
        rows = [np.add.reduceat(y, ends) if len(ends) else np.empty(0) for y in (c > 0, base, each)]
        return pa.table([d.column("ids").combine_chunks().flatten(), d.column("held").combine_chunks().flatten(),
                         pa.array(sizes), pa.array(rows[0].astype(np.int64)), pa.array(rows[1].astype(float)),
                         pa.array(rows[2].astype(float))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run
