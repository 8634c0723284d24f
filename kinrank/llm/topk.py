"""Exact top-k inner products as a Voronoi join.

A bounded sample of vectors (and the zero vector) serve as pivots; every vector
falls into the cell of its nearest pivot.  Per-cell summaries (count, radius,
largest norm) give, for all queries of cell i and all data of cell j with pivots
p and radii r, by the Cauchy-Schwarz inequality

    p_i.p_j - R_i |p_j| - Q_i r_j  <=  q.x  <=  p_i.p_j + R_i |p_j| + Q_i d(x, p_j)

(R_i, Q_i: radius and largest norm of the queries).  The lower bounds, taken
with the cells' counts of distinct vec_ids (each in one cell only), give a score
that each query's k-th best reaches for sure; a data vector whose upper bound stays below it is not sent to that query
cell.  Query cells are merged into groups of about ``QUERIES``, larger ones are
split, and the data sent to a group is dealt by hash into slices of ``LEAST`` to
``SLICE`` vectors (as few as keep all shuffle partitions busy, for queries go to
every slice); a task solves one group and slice exactly with numpy, a window
merges the slices' best.

Defined cases: vectors that are null, or hold a null or non-finite component,
and rows without vec_id take no part; only vectors of equal length meet; rows
that repeat a vec_id count once per query (with their best score); a query id
that is repeated with different vectors asks with its largest one, in the order
of arrays; a query with no candidate has no rows, an empty table gives none; ties go to the smaller vec_id.  Scores are
computed in double precision where that is exact, else as integers, and beyond
the range of a long count as its end; extra columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinrank.llm.shared import written

K = 10
PIVOTS = 64                 # sampled pivots: bounds what the driver holds and sends
QUERIES = 2048              # queries solved together
SLICE = 32_768              # data vectors solved together, at most about so many ...
LEAST = 512                 # ... and at least so many, if there are idle partitions
SCALE = 1024
SLACK = 1e-9                # relative allowance for rounding in the bounds


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every finite vector, whole numbers held as doubles."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (embeddings.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


def _cells(vectors: DataFrame, pivots) -> DataFrame:
    """Adds dim, cell, d (distance to the cell's pivot) and norm."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False)
            n = len(b)
            dim, cell = np.diff(offsets).astype(np.int32), np.zeros(n, np.int32)
            d, norm = np.zeros(n), np.zeros(n)
            for size in np.unique(dim):
                at = np.flatnonzero(dim == size)
                x = flat[(offsets[at][:, None] + np.arange(size))].reshape(len(at), size)
                norm[at] = np.sqrt((x * x).sum(axis=1))
                p = pivots.get(int(size))
                p = np.zeros((1, size)) if p is None else p
                square = norm[at][:, None] ** 2 - 2 * (x @ p.T) + (p * p).sum(axis=1)
                cell[at] = square.argmin(axis=1)
                d[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *map(pa.array, (dim, cell, d, norm))],
                names=["vec_id", "v", "dim", "cell", "d", "norm"])
    return vectors.mapInArrow(run, "vec_id bigint, v array<double>, dim int, cell int, d double, norm double")


def plan(pivots: dict, data: list, queries: list, k: int):
    """Where data goes: rows (dim, query cell, data cell, group, blocks, farthest).

    Data of the cell within `farthest` of its pivot must meet the queries of
    the query cell (their group, dealt into so many blocks).  The third figure of
    `data` counts vec_ids, none of them in two cells.
    """
    rows, group, filled = [], 0, 0
    for dim, i, n_q, radius, norm in sorted(queries):
        if filled + n_q > QUERIES and filled:
            group, filled = group + 1, 0
        blocks = -(-n_q // QUERIES)
        filled += n_q
        cells = [(j, n, r) for m, j, n, r, _ in data if m == dim]
        p = pivots.get(dim)
        p = np.zeros((1, dim)) if p is None else p
        middle = {j: float(p[i] @ p[j]) for j, _, _ in cells}
        loose = {j: radius * float(np.linalg.norm(p[j])) for j, _, _ in cells}
        sure, left = -np.inf, k + 1                        # one of them may be the query itself
        for low, n in sorted(((middle[j] - loose[j] - norm * r, n) for j, n, r in cells), reverse=True):
            left -= n
            if left <= 0:
                sure = low
                break
        for j, _, r in cells:
            room = sure - middle[j] - loose[j]
            room -= SLACK * (abs(sure) + abs(middle[j]) + loose[j] + norm * r + 1)
            nearest = -1.0 if room <= 0 else room / norm if norm else np.inf
            if r >= nearest:
                rows.append((dim, i, j, group, blocks, float(nearest)))
    return rows


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in sample:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {n: np.unique(np.array([[0.0] * n, *rows], float), axis=0) if n else np.zeros((1, 0))
              for n, rows in pivots.items()}
    placed = written(_cells(vectors, pivots))
    row = F.struct("v", "dim", "cell", "d", "norm")
    queries = placed.where(is_query).groupBy("vec_id").agg(F.max(row).alias("r")).select("vec_id", "r.*")

    def summary(df):         # at most (PIVOTS + 1) rows a dimension
        return [tuple(r) for r in df.groupBy("dim", "cell").agg(
            F.count("*"), F.max("d"), F.max("norm")).collect()]
    ids = {(dim, cell): n for dim, cell, n in     # an id counts in one of its cells: no sum over cells counts it twice
           placed.groupBy("dim", "vec_id").agg(F.min("cell").alias("cell")).groupBy("dim", "cell").count().collect()}
    stored = summary(placed)
    data = [(dim, cell, ids.get((dim, cell), 0), *rest) for dim, cell, _, *rest in stored]
    rows = plan(pivots, data, summary(queries), k)
    routes = spark.createDataFrame(rows, "dim int, qcell int, cell int, grp int, blocks int, nearest double")
    n = sum(n for _, _, n, _, _ in stored)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-n // SLICE), min(partitions, -(-n // LEAST)))

    asked = (queries.join(F.broadcast(routes.select("dim", F.col("qcell").alias("cell"), "grp", "blocks").distinct()),
                          ["dim", "cell"])
             .select("vec_id", "v", "dim", "grp", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"),
                     F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")))
    target = (routes.groupBy("dim", "cell", "grp")      # one route per group that needs any of its queries served
              .agg(F.min("nearest").alias("nearest"), F.max("blocks").alias("blocks")))
    sent = (placed.join(F.broadcast(target), ["dim", "cell"]).where("d >= nearest")
            .select("vec_id", "v", "dim", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                    F.pmod(F.xxhash64(F.lit("slice"), "vec_id"), F.lit(slices)).cast("int").alias("slice")))
    key = ["dim", "grp", "block", "slice"]
    asked, sent = (x.select("vec_id", "v", "dim", "grp", F.col("block").cast("int").alias("block"), "slice")
                   for x in (asked, sent))
    sent = sent.select(*[F.col(c).alias(f"x_{c}") for c in sent.columns])     # names of its own for the join

    def solve(q, x):
        import pyarrow as pa
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(q) or not len(x):
            return schema.empty_table()
        (qi, qv), (xi, xv) = _matrix(q), _matrix(x, "x_")
        exact = np.abs(qv).max(initial=0) * np.abs(xv).max(initial=0) * max(qv.shape[1], 1) < 2 ** 53
        if not exact:
            qv, xv = (np.array([[int(c) for c in r] for r in m], dtype=object) for m in (qv, xv))
        out = []
        for at in range(0, len(qi), 64):
            scores = qv[at:at + 64] @ xv.T
            if not exact:
                scores = np.clip(scores, -(2 ** 63), 2 ** 63 - 1)
            for i, row in zip(qi[at:at + 64].tolist(), scores):
                live = np.flatnonzero(xi != i)
                if len(live) > 4 * k and exact:            # keep whatever ties with the k-th of distinct ids
                    cut = np.partition(row[live], len(live) - 2 * k)[len(live) - 2 * k]
                    near = live[row[live] >= cut]
                    live = near if len(np.unique(xi[near])) >= k else live
                found = {}
                for j in live[np.lexsort((xi[live], -row[live]))].tolist() if exact else \
                        sorted(live.tolist(), key=lambda j: (-row[j], xi[j])):
                    found.setdefault(int(xi[j]), int(row[j]))
                    if len(found) == k:
                        break
                out += [(i, j, s) for j, s in found.items()]
        return pa.table(list(map(list, zip(*out))) if out else [[], [], []], schema=schema)

    best = (asked.groupBy(*key).cogroup(sent.groupBy(*[f"x_{c}" for c in key]))
            .applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _matrix(t, prefix: str = ""):
    """ids and vectors of an Arrow table."""
    ids = t.column(prefix + "vec_id").to_numpy()
    v = t.column(prefix + "v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
