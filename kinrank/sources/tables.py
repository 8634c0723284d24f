"""Items and change groups derived from the driver's star-schema tables.

The relatedness jobs take two generic tables:

* ``items(item_id long, path string, mtime timestamp, content string)``
* ``changes(group_id long, item long, ts timestamp, change_type string)``

Here both are derived from the TPC-H-like tables with plain Spark joins so
that every job's work grows with the data: a part is an item (its path is
built from type, brand, name and size), an order is a change group, a line
item says which part the order touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_ROWS = 20_000           # of a task that derives paths and texts from parts


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of `part`, whose few bytes a row would leave the texts derived from it to a task or two, dealt over tasks."""
    df = read_table(spark, sf_dir, "part")
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    return df.select(*columns).repartition(tasks, F.xxhash64("p_partkey", F.lit("parts")))


NAMED = ("p_partkey", "p_name", "p_type", "p_brand", "p_size")


# The same SQL text is used by the Spark jobs and by the DuckDB oracle.
# The shapes cover root files, unequal depths, generic stems, dot-files, names
# without a domain, names that two items share, and PHP views and components.
_NAME, _TYPE = "replace(p_name, ' ', '_')", "lower(p_type)"
_TWIN = "CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)"
_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
PART_PATH_SQL = (
    "CASE p_partkey % 20 "
    f"WHEN 0 THEN concat({_NAME}, '.ts') "
    f"WHEN 1 THEN concat('src/', {_TYPE}, '/', replace(p_brand, '#', '-'), '/', {_NAME}, '/index.ts') "
    f"WHEN 2 THEN concat('src/', {_TYPE}, '/.', {_NAME}, 'rc.json') "
    f"WHEN 3 THEN concat('src/', {_TYPE}, '/Controller.php') "
    f"WHEN 4 THEN concat('src/', {_TYPE}, '/', {_NAME}, '/part', {_TWIN}, '.ts') "
    f"WHEN 14 THEN concat('src/', {_TYPE}, '/part', {_TWIN}, '.spec.ts') "
    f"WHEN 5 THEN concat('resources/views/', {_FIRST}, '/', {_SECOND}, '.blade.php') "
    f"WHEN 6 THEN concat('lib/', {_TYPE}, '/', {_NAME}, '.py') "
    f"WHEN 7 THEN concat('resources/views/components/', {_FIRST}, '-', {_SECOND}, '.blade.php') "
    f"ELSE concat('src/', {_TYPE}, '/', replace(p_brand, '#', '-'), '/', {_NAME}, "
    "CASE p_size % 3 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '.ts' ELSE '.d.ts' END) END"
)
_Q, _NL = "chr(39)", "chr(10)"
PART_CONTENT_SQL = (
    "CASE p_partkey % 20 "
    f"WHEN 3 THEN concat('<?php', {_NL}, 'use App', chr(92), 'Models', chr(92), {_SECOND}, ';', {_NL}, "
    f"'$page = ', {_Q}, {_FIRST}, '.', {_SECOND}, {_Q}, ';', {_NL}, 'return view($page);') "
    f"WHEN 5 THEN concat('<x-', {_FIRST}, '-', {_SECOND}, ' />', {_NL}, "
    f"'return to_route(', {_Q}, {_SECOND}, '.show', {_Q}, ');') "
    f"WHEN 6 THEN concat('from ', {_TYPE}, '.', {_NAME}, ' import Thing') "
    f"WHEN 4 THEN concat('twin ', {_TWIN}, ' of ', p_type, {_NL}, 'see the other one') "
    f"WHEN 14 THEN concat('twin ', {_TWIN}, ' of ', p_type, {_NL}, 'see this one') "
    f"ELSE concat('import Thing from ', {_Q}, './', {_TYPE}, '/', {_NAME}, {_Q}, ';', {_NL}, p_name, ' ', p_brand) END"
)

# Deletions ('D') are what the change-type filter removes.
CHANGE_TYPE_SQL = "CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END"


def item_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, path): only the part columns the path needs are read."""
    return (parts(spark, sf_dir, *NAMED)
            .select(F.col("p_partkey").alias("item_id"), F.expr(PART_PATH_SQL).alias("path")))


def item_mtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, mtime): the newest order that touched the part."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .groupBy(F.col("l_partkey").alias("item_id"))
            .agg(F.max("o_orderdate").alias("mtime")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full item table: path, last change time and content."""
    rows = parts(spark, sf_dir, *NAMED).select(
        F.col("p_partkey").alias("item_id"), F.expr(PART_PATH_SQL).alias("path"),
        F.expr(PART_CONTENT_SQL).alias("content"))
    return rows.join(item_mtimes(spark, sf_dir), "item_id", "left")


def as_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row frame holding the reference time for recency: the newest
    change in the data (a fixed, data-derived 'now')."""
    return read_table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("as_of"))


def changes(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """(group_id, item, change_type[, ts]) from line items.

    The order date is joined only when a job needs group times (history
    limit), so co-change alone never pays for the lineitem x orders join.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("item"),
        F.expr(CHANGE_TYPE_SQL).alias("change_type"))
    if not with_time:
        return li
    od = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("group_id"), F.col("o_orderdate").alias("ts"))
    return li.join(od, "group_id")


def write_changelog(spark: SparkSession, sf_dir: str, path: str, marker: str = "__COMMIT__") -> None:
    """The orders as a name-only change log, newest first: one row a line, sorted over range partitions."""
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = (read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
          .join(item_paths(spark, sf_dir).withColumnRenamed("item_id", "l_partkey"), "l_partkey"))
    items = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    key = ["o_orderdate", "o_orderkey"]
    rows = (items.select(*key, F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("k"), F.col("path").alias("line"))
            .unionByName(items.select(*key).distinct().select(
                *key, F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("k"), F.lit(marker).alias("line"))))
    rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"), "n", "k").select("line").write.text(path)


# Source files derived from parts, one language per p_size % 5, with import /
# use / view lines that name other parts' types and names.  Text built with
# chr() so the same SQL runs in Spark and DuckDB.
CODE_PATH_SQL = (
    "concat('code/', lower(p_type), '/', replace(p_name, ' ', '_'), "
    "CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.java' "
    "WHEN 3 THEN '.cs' ELSE '.php' END)"
)
CODE_CONTENT_SQL = (
    "CASE p_size % 5 "
    "WHEN 0 THEN concat('from ', lower(p_type), '.', replace(p_name, ' ', '_'), ' import Thing', chr(10), "
    "'# import skipped', chr(10), 'import ', split_part(p_name, ' ', 2), ' as alias', chr(10), "
    "'path = ', chr(39), lower(p_type), '/', replace(p_name, ' ', '/'), '.ts', chr(39)) "
    "WHEN 1 THEN concat('use crate::', lower(p_type), '::', replace(p_name, ' ', '_'), '::Item;', chr(10), "
    "'mod ', split_part(p_name, ' ', 2), ';', chr(10), '// use skipped::line;') "
    "WHEN 2 THEN concat('import static com.acme.', lower(p_type), '.', replace(p_name, ' ', '.'), ';', "
    "chr(10), 'import java.util.*;', chr(10), 'import ', lower(p_type), '.', split_part(p_name, ' ', 2), "
    "'.*;') "
    "WHEN 3 THEN concat('using ', p_type, '.', replace(p_name, ' ', '.'), ';', chr(10), 'using System;', "
    "chr(10), 'using Alias = ', split_part(p_name, ' ', 1), '.', p_type, ';') "
    "ELSE concat('<?php', chr(10), 'use App', chr(92), 'Models', chr(92), split_part(p_name, ' ', 2), ';', "
    "chr(10), '$view = ', chr(39), lower(p_type), '.', replace(p_name, ' ', '_'), chr(39), ';', "
    "chr(10), '$alias = $view;', chr(10), '$full = ', chr(39), 'admin.', chr(39), ' . $alias;', "
    "chr(10), 'return view($view);', chr(10), 'return view($alias, array_merge(foo(bar(1)), x()));', "
    "chr(10), 'return view($full);', chr(10), 'return view(', chr(39), 'ui.', chr(39), ' . $view);', "
    "chr(10), 'return view(((', chr(39), lower(p_type), '.', split_part(p_name, ' ', 2), chr(39), ')));', "
    "chr(10), '$view = trans(', chr(39), 'no.value', chr(39), ');', chr(10), 'return view($view . $tail);', "
    "chr(10), '<x-', replace(p_name, ' ', '-'), ' />', "
    "chr(10), 'Route::get(', chr(39), '/', p_size, chr(39), ', [', split_part(p_name, ' ', 2), 'Controller::class]);', "
    "chr(10), 'return to_route(', chr(39), split_part(p_name, ' ', 2), '.show', chr(39), ');') END"
)


def code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, path, content): one source file per part."""
    return parts(spark, sf_dir, *NAMED).select(
        F.col("p_partkey").alias("item_id"), F.expr(CODE_PATH_SQL).alias("path"),
        F.expr(CODE_CONTENT_SQL).alias("content"))


# The items as files, in plain, hidden and private folders; every 50th one ends in a byte that is not UTF-8.
TREE_PATH_SQL = ("concat(CASE p_partkey % 3 WHEN 0 THEN '.hidden/' WHEN 1 THEN '_private/' ELSE 'plain/' END, "
                 f"CAST(p_partkey % 40 AS STRING), '/_', CAST(p_partkey AS STRING), '/', {PART_PATH_SQL})")


def write_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One file an item below `root`, a folder that all machines share."""
    rows = parts(spark, sf_dir, *NAMED).select(
        F.expr(TREE_PATH_SQL).alias("path"), F.expr(PART_CONTENT_SQL).alias("content"), (F.col("p_partkey") % 50 == 1).alias("bad"))

    def write(rows_):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root)
        for r in rows_:
            path = f"{base}/{r.path}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(r.content.encode() + (b"\xff" if r.bad else b""))
    rows.foreachPartition(write)


RULES_SQL = ("SELECT DISTINCT concat('/', replace(p_brand, '#', '-'), '/.*[.]spec[.]ts$') AS pattern FROM part "
             "WHERE p_size % 10 = 3 UNION SELECT DISTINCT concat('^lib/', lower(p_type), '/') FROM part WHERE p_type LIKE 'S%'")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore rules, one pattern a row: test files of some brands, library folders of some types."""
    read_table(spark, sf_dir, "part").createOrReplaceTempView("kinrank_rule_parts")
    return spark.sql(RULES_SQL.replace(" FROM part", " FROM kinrank_rule_parts"))
