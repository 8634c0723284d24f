"""Ranked lexical search by dense blocked matrix products.

Items are taken in blocks whose (items x distinct terms) matrix has at most
``CELLS`` cells, so what is broadcast has a fixed bound; each block is searched
against all documents.  Corpus statistics (documents, terms, document
frequencies of the block's vocabulary) are summed by Spark from one partial
count per task.

A task turns a tile of documents into a dense impact matrix over the terms of
the vocabulary that the tile holds at all, multiplies the items' weights by it
with float64 BLAS, vocabulary tile by vocabulary tile, and adds the products as
64-bit integers.  Weights and impacts are whole numbers; a vocabulary tile is so
narrow that no partial sum can reach 2^53, hence all products are exact.  From
each tile only scores not below the k-th best so far are looked at, equal ones
included, so ties go by document id wherever the documents lie.

Defined cases: a null or empty text has no terms, such a document is never
found and such an item finds nothing; rows that repeat an item_id are one item
with the terms of all of them; document rows that repeat an id are ranked each;
a null document id ranks behind equal scores, a null item_id is an item; very
long texts are read whole, one tile of documents is cut by their length; empty
tables give no rows; other columns are left out.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinrank.llm.shared import latest, written

K = 10
CELLS = 4_000_000            # of the weight matrix that is broadcast (32 MB of float64)
TERMS = 1_000_000            # pairs of item and term that the driver takes in at once, but for one longer item
DOCS = 512                   # documents in a tile
BYTES = 4_000_000            # of their texts
WIDTH = 2048                 # terms in a vocabulary tile, at most
EXACT = 1 << 53
PEAK = 1_000_000             # an impact is smaller
SALT = 64                    # first-level groups of the final ranking

# Fixed values of the scoring rule.
WEIGHT, IMPACT, NORM, LENGTH = 1000, 1_000_000_000, 100, 90
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


def _binary(column):
    """A text column as bytes (its UTF-8 as it stands)."""
    import pyarrow as pa
    return column.cast(pa.binary())


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ids, found = [], []
                for i, text in zip(part.column(0).to_pylist(), _binary(part.column(1)).to_pylist()):
                    own = set(terms(text))
                    ids += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(found, pa.binary())],
                                                 names=["item_id", "term"])
    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _blocks(items: DataFrame):
    """Blocks of (item ids, terms of each item) for the driver, bounded by CELLS and TERMS."""
    pairs = written(_item_terms(items))
    parts = max(1, -(-pairs.count() // (TERMS // 2)))            # half full on average, so that TERMS holds
    for at in range(parts):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == at).collect()
        by: dict = {}
        for item, term in rows:
            by.setdefault(item, []).append(bytes(term))
        block, seen = {}, set()
        for item in sorted(by, key=lambda i: (i is not None, i)):
            wider = seen | set(by[item])
            if block and (len(block) + 1) * len(wider) > CELLS:
                yield block
                block, wider = {}, set(by[item])
            block[item], seen = by[item], wider
        if block:
            yield block


def _statistics(docs: DataFrame, vocabulary) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and how many documents hold each word of the broadcast vocabulary."""
    token = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        get = latest("lexical-search", token, lambda: {w: i for i, w in enumerate(vocabulary.value)}).get
        df, with_terms, length = np.zeros(len(vocabulary.value), np.int64), 0, 0
        for b in batches:
            for start in range(0, b.num_rows, 64):
                for text in _binary(b.column(0).slice(start, 64)).to_pylist():
                    found = terms(text)
                    with_terms += bool(found)
                    length += len(found)
                    held = set(map(get, found))
                    held.discard(None)
                    df[list(held)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int32()),
                                          pa.array([with_terms, length, *df[at].tolist()], pa.int64())], names=["term", "n"])
    counts = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in counts.collect()}        # at most the vocabulary and two
    return known.pop(-1, 0), known.pop(-2, 0), known


class Tiles:
    """The weights of a block of items, as vocabulary tiles whose sums stay exact."""

    def __init__(self, words: list[bytes], lists: list[list[int]], weights: list[int]):
        self.get = {w: i for i, w in enumerate(words)}.get
        width = max(1, min(WIDTH, (EXACT - 1) // (PEAK * max([1, *weights]))))
        self.cuts = list(range(0, len(words), width)) + [len(words)]
        dense = np.zeros((len(lists), len(words)))
        for i, own in enumerate(lists):
            dense[i, own] = [weights[t] for t in own]
        self.tiles = [dense[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def scores(self, docs: list[list[bytes]], n_docs: int, n_terms: int):
        """Scores (items x documents) of a tile of documents, as 64-bit integers."""
        out = np.zeros((len(self.tiles[0]) if self.tiles else 0, len(docs)), np.int64)
        where, what, norms = [], [], []
        for j, found in enumerate(docs):
            ids = [i for i in map(self.get, found) if i is not None]
            what += ids
            where += [j] * len(ids)
            norms.append(NORM - LENGTH + (LENGTH * len(found) * n_docs) // n_terms)
        if not what:
            return out
        size = max(self.cuts[-1], 1)
        keys, tf = np.unique(np.array(where, np.int64) * size + np.array(what, np.int64), return_counts=True)
        doc, term, tf = keys // size, keys % size, tf.astype(np.int64)
        impact = (IMPACT * tf) // (1000 * tf + 8 * np.array(norms, np.int64)[doc])
        for a, b, tile in zip(self.cuts, self.cuts[1:], self.tiles):
            own = (term >= a) & (term < b)
            if not own.any():
                continue
            columns, at = np.unique(term[own], return_inverse=True)     # the terms that the documents hold
            dense = np.zeros((len(columns), len(docs)))
            dense[at, doc[own]] = impact[own]
            out += (tile[:, columns - a] @ dense).astype(np.int64)
        return out


class Best:
    """The k best (score, document id) of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, scores, ids: list):
        k = min(self.k, scores.shape[1])
        if not k:
            return
        tile = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        for i, j in zip(*np.nonzero(scores >= np.maximum(self.least, tile)[:, None])):
            self.rows[i].append((-int(scores[i, j]), ids[j] is None, ids[j] if ids[j] is not None else 0))
        for i, rows in enumerate(self.rows):
            if len(rows) > self.k:
                rows.sort()
                del rows[self.k:]
            if len(rows) == self.k:
                self.least[i] = -max(rows)[0]


def _tiles_of(ids, texts):
    """(ids, term lists) of the documents of a batch that have terms, a tile at a time."""
    names, docs, size = [], [], 0
    for start in range(0, len(texts), 64):
        for i, text in zip(ids.slice(start, 64).to_pylist(), _binary(texts.slice(start, 64)).to_pylist()):
            found = terms(text)
            if found:
                names.append(i), docs.append(found)
                size += len(text)
            if len(docs) >= DOCS or size >= BYTES:
                yield names, docs
                names, docs, size = [], [], 0
    if docs:
        yield names, docs


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark, kinds = docs.sparkSession, {"doc": dict(docs.dtypes)["doc_id"], "item": dict(items.dtypes)["item_id"]}
    docs = docs.select("doc_id", "text")
    out = spark.createDataFrame([], f"item_id {kinds['item']}, doc_id {kinds['doc']}, score bigint")
    for block in _blocks(items):
        names = list(block)
        words = sorted({w for own in block.values() for w in own})
        n_docs, n_terms, df = _statistics(docs, spark.sparkContext.broadcast(words))
        if not n_docs:
            break
        weights = [int(np.floor(WEIGHT * np.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))) for i in range(len(words))]
        place = {w: i for i, w in enumerate(words)}
        shared = spark.sparkContext.broadcast((words, [[place[w] for w in block[i]] for i in names], weights))
        out = out.unionByName(written(_search_block(docs, shared, n_docs, n_terms, k, spark.createDataFrame(
            list(enumerate(names)), f"item int, item_id {kinds['item']}"), kinds)))
    ahead = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*ahead)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs, shared, n_docs, n_terms, k, names, kinds) -> DataFrame:
    """At most k rows an item from each of SALT groups of tasks."""
    token = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        tiles = latest("lexical-search", token, lambda: Tiles(*shared.value))
        best, kind = Best(len(shared.value[1]), k), pa.null()
        for b in batches:
            kind = b.schema.field(0).type
            for ids, found in _tiles_of(b.column(0), b.column(1)):
                best.add(tiles.scores(found, n_docs, n_terms), ids)
        rows = [(i, None if none else doc, -score) for i, own in enumerate(best.rows) for score, none, doc in sorted(own)[:k]]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64()),
                 pa.array([TaskContext.get().partitionId() % SALT] * len(rows), pa.int32())],
                names=["item", "doc_id", "score", "salt"])
    found = docs.mapInArrow(run, f"item int, doc_id {kinds['doc']}, score bigint, salt int")
    ahead = Window.partitionBy("item", "salt").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= k)
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


_TERM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


def search_sql(k: int = K) -> str:
    """The `op11_lexical_search` rows as DuckDB SQL."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERM} AS w FROM documents),
    s AS (SELECT count(*) AS nd, sum(len(w)) AS l FROM d WHERE len(w) > 0),
    m AS (SELECT r, doc_id, {NORM - LENGTH} + (({LENGTH} * len(w)::HUGEINT * nd) // l)::BIGINT AS m FROM d, s WHERE len(w) > 0),
    i AS (SELECT DISTINCT item_id, unnest({_TERM}) AS term FROM benchmark),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
          WHERE term IN (SELECT term FROM i) GROUP BY r, term),
    f AS (SELECT term, floor({WEIGHT} * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term),
    p AS (SELECT item_id, r, doc_id, sum(w * (({IMPACT} * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM i JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
    o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
          FROM p WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {k}"""
