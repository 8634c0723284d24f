"""Exact duplicates by a 128-bit content hash (DataFrame functions only).

Texts are grouped by their hash; ids are reduced to the one that stays and a
count, so a group of any size is pre-aggregated before it is shuffled.  Bytes
are compared inside the groups of two and more without gathering them: the
smallest and the largest text of a group are equal only if all of its texts
are, and both are partial aggregates.  Groups in which they differ (a hash
collision) are taken apart by the texts themselves.

Texts move only for rows of such groups.  Their hashes are broadcast while
there are at most ``BROADCAST`` of them, and joined by a shuffle beyond that.
When classes are given back to rows, groups that hold more than one row in
``HOT`` are broadcast (there are fewer than ``HOT`` of those); the rows of all
other groups are shuffled by hash, without their texts.

Defined cases: a null text counts as empty; empty texts are equal to each
other; very long texts are hashed and compared whole; among rows with null ids
and others the null never stays unless all ids are null; rows that repeat an id
with an equal text count in the group's size and are marked alike, and
`without_duplicates` keeps one of them; an empty table gives an empty result;
other columns, whatever their names, pass through `without_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.shared import written

BROADCAST = 500_000          # hashes of 16 bytes
HOT = 1000


def md5(text: Column) -> Column:
    """The 16 bytes of a text's MD5."""
    return F.unhex(F.md5(text))


def _best(keep: str):
    return {"smallest": F.min, "largest": F.max}[keep]


def _suspects(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes of groups whose texts are not all equal."""
    several = groups.where("n > 1").select("h")
    small = several.limit(BROADCAST + 1).count() <= BROADCAST
    rows = texts.join(F.broadcast(several) if small else several, "h", "left_semi")
    return rows.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("h")


def classes(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None,
            content_hash: Callable[[Column], Column] = md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for every row of `docs`.

    ``normalise`` is applied to the text before hashing and comparing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text = normalise(text) if normalise else text
    # `own` is null but for texts that share a hash with another text.
    texts = docs.select("doc_id", text.alias("t"), F.lit(None).cast("string").alias("own")).withColumn("h", content_hash(F.col("t")))
    size, best = F.count(F.lit(1)).alias("n"), _best(keep)("doc_id").alias("keep_id")
    groups = written(texts.groupBy("h").agg(size, best))
    clash = written(_suspects(texts, groups))
    if not clash.isEmpty():
        apart = texts.join(clash, "h", "left_semi").withColumn("own", F.col("t"))
        texts = texts.join(clash, "h", "left_anti").unionByName(apart)
        groups = written(groups.join(clash, "h", "left_anti").withColumn("own", F.lit(None).cast("string"))
                         .unionByName(apart.groupBy("h", "own").agg(size, best)))
    else:
        groups = groups.withColumn("own", F.lit(None).cast("string"))

    several = groups.where("n > 1")
    least = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()["rows"] / HOT
    as_hot = [F.col("h"), F.col("own").alias("o"), F.col("n").alias("hot_n"), F.col("keep_id").alias("hot_id")]
    hot = F.broadcast(several.where(F.col("n") > least).select(*as_hot))
    rest = several.where(F.col("n") <= least).withColumnRenamed("own", "o")
    rows = texts.select("doc_id", "h", "own", F.sha2("t", 256).alias("text_sha256"))
    rows = rows.join(hot, (rows.h == hot.h) & rows.own.eqNullSafe(hot.o), "left").drop("o").drop(hot.h)
    # Rows of a hot group have their class; a key of their own spreads them over the shuffle.
    rows = rows.withColumn("k", F.when(F.col("hot_n").isNull(), F.col("h"))
                           .otherwise(F.concat(F.col("h"), F.unhex(F.hex(F.xxhash64("doc_id"))))))
    rows = rows.join(rest, (rows.k == rest.h) & rows.own.eqNullSafe(rest.o), "left").drop(rest.h)
    keep_id = (F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).when(F.col("n").isNotNull(), F.col("keep_id"))
               .otherwise(F.col("doc_id")))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("hot_n", "n", F.lit(1)).cast("long").alias("group_size"),
                       F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """`docs` with one row of each class of equal texts."""
    found = written(classes(docs, keep, normalise).where("kept")
                    .groupBy(F.col("doc_id").alias("_id"), "text_sha256").agg(F.count(F.lit(1)).alias("_rows")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"),
                       F.sha2(normalise(text) if normalise else text, 256).alias("_sha"))
    rows = rows.join(found, rows["_doc"].eqNullSafe(found["_id"]) & (rows["_sha"] == found["text_sha256"]))
    # Only rows that repeat an id with an equal text have to meet once more.
    once = rows.where("_rows = 1").select("_row")
    again = rows.where("_rows > 1").groupBy("_doc", "_sha").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")


def exact_dedup_sql(keep: str = "largest") -> str:
    """The `op13_exact_dedup` rows as DuckDB SQL."""
    best = {"smallest": "min", "largest": "max"}[keep]
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    c AS (SELECT doc_id, t, {best}(doc_id) OVER w AS keep_id, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY t))
    SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
           sha256(t) AS text_sha256 FROM c"""
