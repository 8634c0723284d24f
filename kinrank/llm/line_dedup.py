"""Cross-site boilerplate removal by line spread (DataFrame functions only).

Every trimmed, non-empty line is keyed by 128 hash bits.  HyperLogLog sketches
of the sites a line occurs on are built per task and merged by the
aggregation; a sketch far above or below ``min_sites`` decides at once, lines
whose estimate lies within ``BAND`` standard errors (and one site) of it get an
exact distinct count.  Lines on at least ``min_sites`` sites are boilerplate and
go from every document.  A document of which nothing is left is a whole copy of
one found elsewhere and marked as such; with ``keep_whole`` it keeps its original
text, for a near-duplicate removal that follows.

A document's lines are cut in one pass over them, whatever their number: the
positions that are no hits, by a set difference, and the lines at these.

Defined cases: a null text has no lines and stays null; empty and blank lines
are never boilerplate; a null site counts as no site; repeated rows are
decided alike; very long texts and texts of very many lines are cut whole; an
empty table gives an empty result; all columns besides text pass through, the
added ones get underscores until their names are free (`added`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.functions.similarity import let
from kinrank.llm.shared import free_name, written

MIN_SITES = 10
LG_K = 12                          # 4096 registers: standard error 1.6 %
BAND = 6 * 1.04 / 2 ** (LG_K / 2)  # six standard errors
BLANK = " \t\r"
KEY = ["_h1", "_h2"]               # of a line
DOC = ["_doc", "_t1", "_t2"]       # of a document: its id and its text
ADDED = ["_n_lines", "_n_boilerplate", "_n_removed", "_whole_copy"]


def _clean(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hashes(text: Column, names: list[str]) -> list[Column]:
    """Two independent 64-bit hashes (the second one starts from a salted seed)."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit("line"), text).alias(names[1])]


def _doc_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(DOC[0]), *_hashes(F.col("text"), DOC[1:])]


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines that occur on at least `min_sites` distinct sites."""
    lines = (docs.select(F.col(site).alias("_site"), F.explode(F.split("text", "\n")).alias("_line"))
             .withColumn("_line", _clean(F.col("_line")))
             .where((F.col("_line") != "") & F.col("_site").isNotNull())
             .select(*_hashes(F.col("_line"), KEY), "_site"))
    spread = written(lines.groupBy(*KEY).agg(F.hll_sketch_agg(F.col("_site").cast("string"), F.lit(LG_K)).alias("s"))
                     .select(*KEY, F.hll_sketch_estimate("s").alias("sites"))
                     .where(F.col("sites") >= (min_sites - 1) * (1 - BAND)))
    near = F.col("sites") <= (min_sites + 1) * (1 + BAND)
    exact = (lines.join(spread.where(near), KEY, "left_semi")
             .groupBy(*KEY).agg(F.count_distinct("_site").alias("sites")).where(F.col("sites") >= min_sites))
    return written(spread.where(~near).select(*KEY).unionByName(exact.select(*KEY)))


def added(docs: DataFrame) -> list[str]:
    """The names of the four columns that `dedup_lines` adds to `docs`."""
    return [free_name(c, docs) for c in ADDED]


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_whole: bool = False) -> DataFrame:
    """`docs` with cleaned texts and the columns `added`: lines, boilerplate lines, lines removed, whole copy."""
    found = boilerplate(docs, site, min_sites)
    keyed = docs.select(*_doc_key(), F.col("text").alias("_text"))       # hashed once a text, not once a line
    lines = (keyed.select(*DOC, F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
             .withColumn("_line", _clean(F.col("_line"))).where("_line != ''")
             .select(*DOC, "_pos", *_hashes(F.col("_line"), KEY)))
    hits = (lines.join(found, KEY, "left_semi")
            .groupBy(*DOC).agg(F.collect_set("_pos").alias("_hit")))   # at most the lines of one text
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *_doc_key())    # no name of `docs` can clash
    text, hit = F.col("_row.text"), F.col("_hit").isNotNull()

    def kept(all_lines):                           # linear: no search in `_hit` for each line
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "_hit")
        return F.transform(places, lambda i: F.get(all_lines, i))
    cleaned = (whole.join(hits, DOC, "left")
               .withColumn("_kept", F.when(hit, F.array_join(let(F.split(text, "\n"), kept), "\n")))
               .withColumn("_whole", hit & ~F.col("_kept").rlike(r"[^\t\n\f\r ]")))
    stays = F.col("_whole") if keep_whole else F.lit(False)
    count = F.coalesce(F.size("_hit"), F.lit(0))
    n_lines, n_hits, n_removed, copy = added(docs)
    return cleaned.select(
        *[F.when(hit & ~stays, F.col("_kept")).otherwise(text).alias("text")
          if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias(n_lines),
        F.when(hit, count).otherwise(0).alias(n_hits),
        F.when(hit & ~stays, count).otherwise(0).alias(n_removed),
        F.col("_whole").alias(copy))


def line_dedup_sql(min_sites: int = MIN_SITES) -> str:
    """The `op4_line_dedup` rows as DuckDB SQL, with plain distinct counts."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
    s AS (SELECT rid, doc_id, text, source, string_split(text, chr(10)) AS parts FROM d),
    e AS (SELECT rid, source, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM s WHERE text IS NOT NULL),
    l AS (SELECT rid, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM e),
    b AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL
          GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
    m AS (SELECT l.rid, l.pos, l.raw, b.line IS NOT NULL AS hit,
                 length(regexp_replace(l.raw, '\s', '', 'g')) AS size FROM l LEFT JOIN b ON l.line = b.line),
    a AS (SELECT rid, count(*) AS n_lines, sum(hit::INT) AS n_hit,
                 sum(CASE WHEN hit THEN 0 ELSE size END) AS left_size,
                 string_agg(CASE WHEN hit THEN NULL ELSE raw END, chr(10) ORDER BY pos) AS kept
          FROM m GROUP BY rid),
    r AS (SELECT d.doc_id, d.text, coalesce(a.n_lines, 0) AS n_lines, coalesce(n_hit, 0) AS n_hit, kept, left_size
          FROM d LEFT JOIN a USING (rid))
    SELECT doc_id, n_lines::BIGINT AS n_lines, n_hit::BIGINT AS n_boilerplate, n_hit::BIGINT AS n_removed,
           n_hit > 0 AND left_size = 0 AS whole_copy,
           sha256(CASE WHEN n_hit > 0 THEN coalesce(kept, '') ELSE text END) AS text_sha256
    FROM r"""
