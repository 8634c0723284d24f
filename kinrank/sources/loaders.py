"""Item and change loaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.refs import trim_ws
from ..session import written
from .files import read_tree

# Marker line that opens each commit in a name-only change log.
COMMIT_MARKER = "__COMMIT__"


def relativize(df: DataFrame, root: str | None = None, col: str = "path") -> DataFrame:
    """Strip a project root and any leading './' once, at ingest."""
    p = F.col(col)
    if root:
        prefix = root.rstrip("/") + "/"
        p = F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)
    return df.withColumn(col, F.regexp_replace(p, r"^(\./)+", ""))


def read_items(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """S1 (primary): an items table in Parquet with path[, content, mtime]; a
    table without item_id is keyed by its (relative) path."""
    df = relativize(spark.read.parquet(path), root)
    return df if "item_id" in df.columns else df.withColumn("item_id", F.col("path"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """S1 (file tree): every regular file under ``root``, hidden ones included, keyed by its path relative to
    the root; bytes that are not UTF-8 become U+FFFD (see ``files.read_tree``)."""
    return read_tree(spark, root).select("path", "mtime", "content", F.col("path").alias("item_id"))


def exclude(items: DataFrame, patterns: Sequence[str], col: str = "path", fold: int = 200) -> DataFrame:
    """Drop items whose path matches any of the regular expressions.

    The rules are folded into literal alternations, compiled once each, so the
    filter runs next to the scan."""
    for at in range(0, len(patterns), fold):
        items = items.where(~F.col(col).rlike("|".join(f"(?:{p})" for p in patterns[at:at + fold])))
    return items


RULE_CHARS = 1_000_000       # of the patterns that one pass over the items takes


def exclude_by(items: DataFrame, rules: DataFrame, col: str = "path") -> DataFrame:
    """S2 with the rules in a table: column `pattern`, one regular expression a row (nulls are no rules).

    The table's size is checked first.  Up to RULE_CHARS it is folded into one filter next to the scan; a larger
    table is taken in blocks of about half as many characters, one written pass each, so that neither the driver
    nor a plan ever holds more than one block."""
    rules = rules.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    size = rules.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = 1 if size <= RULE_CHARS else -(-2 * size // RULE_CHARS)
    for i in range(blocks):
        own = rules.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i).orderBy("pattern")
        items = exclude(items, [r.pattern for r in own.collect()], col)
        items = written(items) if blocks > 1 else items
    return items


def parse_changelog(spark: SparkSession, path: str, marker: str = COMMIT_MARKER) -> DataFrame:
    """S3: a name-only change log, newest commit first (a line that is the
    marker, then one path per line), as ``changes(group_id, ts, line_no, item)``.

    The log is read in splits.  A line's place is (file, start of its split,
    place in the split); markers and lines are counted inside each split, and
    the counts of earlier splits (one row each) are added.  So group_id, the
    number of the commit, and line_no do not depend on how the log is split.
    ``ts`` falls from commit to commit, so that ``limit_history`` keeps the
    newest ones.  Blank lines are skipped, paths trimmed, empty commits vanish.
    """
    split = ["_file", "_start"]
    place = Window.partitionBy(*split).orderBy("_at")
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_at"))
             .withColumn("_mark", (F.regexp_replace("value", "\r$", "") == marker).cast("long"))
             .withColumn("_group", F.sum("_mark").over(place)).withColumn("_line", F.row_number().over(place)))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)     # one row a split
    offsets = (lines.groupBy(*split).agg(F.sum("_mark").alias("m"), F.count(F.lit(1)).alias("n"))
               .select(*split, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_m"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n")))
    group = F.col("_group") + F.col("_m")
    return (lines.where(F.col("_mark") == 0).join(offsets, split)
            .select(group.alias("group_id"), (-group).alias("ts"), (F.col("_line") + F.col("_n")).alias("line_no"),
                    trim_ws(F.col("value")).alias("item"))
            .where(F.col("item") != ""))


def write_ranked(ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist ranked results as Parquet (scores kept as doubles)."""
    ranked.write.mode(mode).parquet(path)
