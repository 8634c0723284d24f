"""Session construction and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE for runtime coalescing and skew-join
# splitting, UTC so timestamps compare the same everywhere, no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "kinrank",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: list[str] = []      # what shared_dir has named so far


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all machines of a
    cluster share.

    Only a single-machine session (``local[n]``, tests) may leave the setting
    out; it gets a scratch folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
        base = tempfile.mkdtemp(prefix="kinrank-")
        spark.conf.set("spark.checkpoint.dir", base)
    _FOLDERS.append(f"{base.rstrip('/')}/kinrank-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write an intermediate table as Parquet to the shared folder and read it back.

    This cuts lineage in a form that survives lost executors, whose columns can
    still be pruned and whose size is known.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Did a write to `path` end?"""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def written_once(df: DataFrame, path: str) -> DataFrame:
    """`df` as Parquet at `path`, unless an earlier run finished writing it there."""
    if not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process, once no result that reads them is needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)
