"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: one per text, a majority vote over the XXH64 (seed 42) values of
all word shingles; equal fingerprints become one node.

Search: two fingerprints within `distance` bits agree on at least one of
`distance + 1` blocks of bits, so every node is filed under each of its blocks
(and, on larger corpora, under a second choice of blocks among the remaining
bits; `levels` follows from the number of nodes and changes no result).  The
files are sorted by key and Gray rank over range partitions, so a hot key is
dealt over many tasks.  A run of sorted fingerprints of one key is a group:
the bits its members share form its masked pattern.  Patterns of leaves and of
upper nodes are compared first, and whole groups go when the differences on
their shared bits already exceed the distance; only surviving leaves are
compared member by member.  Groups of one key in different tasks meet through
a join of their patterns, and only members near the other group's pattern are
sent.  Each task returns a spanning set of links (as many as its members, never
all pairs), which keeps every connection.

Defined cases: null, empty or blank texts have the fingerprint zero and link
like any other; repeated rows share a fingerprint; very long texts are fingerprinted whole; a row
without doc_id gets the component of its fingerprint but never names one; an empty
table gives an empty result.  Extra columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinrank.llm.graph import components
from kinrank.llm.shared import free_name, text_batches, written

SHINGLE = 3
DISTANCE = 3
LEAF, GROUP = 16, 1024       # members of an index leaf, and of a group (a whole sorted run)
PER_KEY = 256                # a further level of blocks is used beyond so many random nodes a key


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text as a signed integer."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()    # bytes: lower-cases A-Z, splits at x20 and x09-x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    h = np.array(hashes, dtype=">u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        votes += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = [fingerprint(t, shingle) for texts in text_batches(b, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(out, pa.int64())],
                                             names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(distance: int, levels: int) -> list[int]:
    """Masks of the bits that must agree: blocks of all 64 bits, then blocks of those that are left."""
    def choose(bits: list[int], level: int) -> list[int]:
        if not level or len(bits) <= distance + 1:
            return [0]
        cut = [len(bits) * i // (distance + 1) for i in range(distance + 2)]
        out = []
        for a, b in zip(cut, cut[1:]):
            own = sum(1 << x for x in bits[a:b])
            out += [own | rest for rest in choose(bits[:a] + bits[b:], level - 1)]
        return out
    return choose(list(range(64)), levels)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the reflected Gray order."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def _span(n: int, i, j):
    """A spanning set (node, root) of links i-j among n nodes."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        live = root[i] != root[j]
        i, j = i[live], j[live]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _shared(x, starts):
    """Masked patterns of sorted runs: the bits that all members share, and where they do."""
    both, either = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    return both, ~(either ^ both)


def near_pairs(x, y, distance: int):
    """Index pairs (i, j) with x[i] and y[j] within the distance; both in Gray order.

    Leaves of LEAF members are compared by their masked patterns under upper
    nodes of LEAF leaves; a pair of groups goes when its differences exceed the
    distance.
    """
    if not len(x) or not len(y):
        return np.empty(0, int), np.empty(0, int)
    pairs = np.zeros((1, 2), int)
    for width in (LEAF * LEAF, LEAF):
        (p, m), (q, k) = (_shared(v, np.arange(0, len(v), width)) for v in (x, y))
        if width == LEAF:                      # children of the upper pairs that are left
            fan = np.stack(np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij"), -1).reshape(1, -1, 2)
            pairs = (pairs[:, None, :] * LEAF + fan).reshape(-1, 2)
            pairs = pairs[(pairs[:, 0] < len(p)) & (pairs[:, 1] < len(q))]
        else:
            pairs = np.stack(np.meshgrid(np.arange(len(p)), np.arange(len(q)), indexing="ij"), -1).reshape(-1, 2)
        a, b = pairs[:, 0], pairs[:, 1]
        pairs = pairs[np.bitwise_count((p[a] ^ q[b]) & m[a] & k[b]) <= distance]
    place = np.arange(LEAF)
    out = []
    for at in range(0, len(pairs), 2048):
        i = pairs[at:at + 2048, 0, None] * LEAF + place
        j = pairs[at:at + 2048, 1, None] * LEAF + place
        inside = (i < len(x))[:, :, None] & (j < len(y))[:, None, :]
        differ = np.bitwise_count(x[np.minimum(i, len(x) - 1)][:, :, None] ^ y[np.minimum(j, len(y) - 1)][:, None, :])
        g, a, b = np.nonzero(inside & (differ <= distance))
        out.append((i[g, a], j[g, b]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, int), np.empty(0, int))


def links(nodes: DataFrame, distance: int = DISTANCE, levels: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever lies within the distance.

    `nodes` has one row per fingerprint `fp`.
    """
    n = nodes.count()
    if levels is None:
        levels = 1
        while levels < 4 and n / 2 ** _bits(distance, levels) > PER_KEY:
            levels += 1
    masks = [_signed(m) for m in block_masks(distance, levels)]
    keyed = (nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(m).alias("k"))
                                                    for i, m in enumerate(masks)])).alias("f"))
             .select("f.t", "f.k", "fp", gray_rank(F.col("fp")).alias("g")))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 1_000_000)
    ordered = keyed.repartitionByRange(parts, "t", "k", "g").sortWithinPartitions("t", "k", "g")

    def group(batches):
        """Links inside each run of one key; the run's own pattern if it may go on elsewhere."""
        import pyarrow as pa
        from pyspark import TaskContext
        part, serial = TaskContext.get().partitionId(), 0
        rest = before = None
        for b in _then_last(batches):
            v = [np.empty(0, np.int64)] * 3 if b is None else [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                                                               for i in range(3)]
            if rest is not None:
                v = [np.concatenate(p) for p in zip(rest, v)]
            t, k, x = v
            if not len(t):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.array([0, *new.tolist()])
            starts = np.concatenate([np.arange(a, e, GROUP) for a, e in zip(starts, [*new.tolist(), len(t)])])
            ends = np.append(starts[1:], len(t))
            if b is not None:      # the last run may go on in the next batch
                rest = [c[starts[-1]:] for c in v]
                starts, ends = starts[:-1], ends[:-1]
            out, runs = _run_links(x.view(np.uint64), starts, ends, distance), []
            same = lambda i, j: 0 <= i and j < len(t) and t[i] == t[j] and k[i] == k[j]
            for a, e in zip(starts.tolist(), ends.tolist()):
                # a run meets others of its key if it fills up, or touches either end of the partition
                key = (int(t[a]), int(k[a]))
                if serial == 0 or (b is None and e == len(t)) or key == before or same(e - 1, e):
                    runs.append((a, e, part * (1 << 32) + serial))
                serial, before = serial + 1, key
            u = x.view(np.uint64)
            shared = [(int(t[a]), int(k[a]), r, *(int(np.int64(z[0])) for z in
                       ((q.view(np.int64)) for q in _shared(u[a:e], np.array([0])))), x[a:e].tolist())
                      for a, e, r in runs]
            yield pa.RecordBatch.from_pydict(
                {"a": [*out[0].tolist(), *[None] * len(shared)], "b": [*out[1].tolist(), *[None] * len(shared)],
                 **{c: [*[None] * len(out[0]), *[s[i] for s in shared]] for i, c in
                    enumerate(("t", "k", "run", "pattern", "mask", "members"))}}, schema=schema)

    import pyarrow as pa
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "t", "k", "run", "pattern", "mask")]
                       + [("members", pa.list_(pa.int64()))])
    grouped = written(ordered.select("t", "k", "fp").mapInArrow(
        group, "a bigint, b bigint, t bigint, k bigint, run bigint, pattern bigint, mask bigint, members array<bigint>"))
    inner = grouped.where("a is not null").select("a", "b")
    runs = grouped.where("run is not null").select("t", "k", "run", "pattern", "mask")
    left, right = (runs.select("t", "k", *[F.col(c).alias(f"{c}{s}") for c in ("run", "pattern", "mask")]) for s in "12")
    differ = F.bit_count(F.col("pattern1").bitwiseXOR(F.col("pattern2"))
                         .bitwiseAND(F.col("mask1")).bitwiseAND(F.col("mask2")))
    met = left.join(right, ["t", "k"]).where((F.col("run1") < F.col("run2")) & (differ <= distance))
    sides = met.select("run1", "run2", F.explode(F.array(
        F.struct(F.col("run1").alias("run"), F.col("pattern2").alias("pattern"), F.col("mask2").alias("mask"), F.lit(0).alias("side")),
        F.struct(F.col("run2").alias("run"), F.col("pattern1").alias("pattern"), F.col("mask1").alias("mask"), F.lit(1).alias("side")),
    )).alias("s")).select("run1", "run2", "s.*")
    members = grouped.where("run is not null").select("run", "members")
    close = F.filter("members", lambda x: F.bit_count(
        x.bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("mask"))) <= distance)
    sent = sides.join(members, "run").select("run1", "run2", "side", close.alias("members")).where(F.size("members") > 0)
    meeting = (sent.where("side = 0").select("run1", "run2", F.col("members").alias("x"))
               .join(sent.where("side = 1").select("run1", "run2", F.col("members").alias("y")), ["run1", "run2"]))

    def across(batches):
        for b in batches:
            a, c = [], []
            for x, y in zip(b.column(0), b.column(1)):
                x, y = (np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for v in (x, y))
                i, j = near_pairs(x, y, distance)
                at, root = _span(len(x) + len(y), i, j + len(x))
                both = np.concatenate([x, y]).view(np.int64)
                a.append(both[at]), c.append(both[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*v, np.empty(0, np.int64)])) for v in (a, c)],
                                             names=["a", "b"])

    return inner.unionByName(meeting.select("x", "y").mapInArrow(across, "a bigint, b bigint"))


def _bits(distance: int, levels: int) -> int:
    return min(m.bit_count() for m in block_masks(distance, levels))


def _then_last(batches):
    yield from batches
    yield None


def _run_links(x, starts, ends, distance):
    """Spanning links inside the runs; short ones are compared by shifting, all at once."""
    run = np.repeat(np.arange(len(starts)), ends - starts)
    size = (ends - starts)[run]
    body = x[starts[0]:ends[-1]] if len(starts) else x[:0]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in range(1, LEAF):
        if s >= len(body):
            break
        i = np.flatnonzero((run[:-s] == run[s:]) & (size[:-s] <= LEAF) & (np.bitwise_count(body[:-s] ^ body[s:]) <= distance))
        a.append(body[i].view(np.int64)), b.append(body[i + s].view(np.int64))
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s > LEAF:
            at, root = _span(e - s, *near_pairs(x[s:e], x[s:e], distance))
            a.append(x[s + at].view(np.int64)), b.append(x[s + root].view(np.int64))
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the smallest doc_id reachable."""
    marked = written(fingerprints(docs, shingle))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = (nodes.join(components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns, with one row for each near-duplicate group.

    The row with the group's smallest doc_id stays (of rows that repeat this id
    one, by text hash); in a group without any doc_id all rows of it stay.
    """
    found = written(near_duplicates(docs, shingle, distance))
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    row, fp = free_name("_row", docs), free_name("_fp", docs)
    named = (docs.join(first, "doc_id", "left_semi").withColumn(row, F.row_number().over(one))
             .where(F.col(row) == 1).select(*docs.columns))

    def keyed(batches):
        import pyarrow as pa
        for b in batches:
            out = [fingerprint(t, shingle) for texts in text_batches(b, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, fp])
    from pyspark.sql.types import LongType, StructField, StructType
    nameless = (docs.where("doc_id is null")
                .mapInArrow(keyed, StructType([*docs.schema.fields, StructField(fp, LongType())]))
                .join(found.where("component_id is null").select(F.col("fp").alias(fp)).distinct(), fp, "left_semi")
                .select(*docs.columns))
    return named.unionByName(nameless)
