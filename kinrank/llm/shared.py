"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import builtins
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank.session import shared_dir, written  # noqa: F401  (for the operators)

# Python workers get these modules with the functions that use them, so that
# no installed copy of the package is needed on the executors.
cloudpickle.register_pickle_by_value(sys.modules["kinrank.llm"])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(divisor: int, column: str = "doc_id") -> Column:
    """True where crc32(id as text) leaves the remainder that is kept for tests."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == 1, F.lit(False))


def worker_memo(key, build):
    """An object that a Python worker builds once and keeps between its tasks."""
    store = builtins.__dict__.setdefault("_kinrank_llm_memo", {})
    if key not in store:
        store[key] = build()
    return store[key]


def latest(name: str, token: str, build):
    """What a worker has built for one pass over the data (named by `token`); that of an earlier pass goes."""
    held = worker_memo(name, dict)
    if token not in held:
        held.clear()
        held[token] = build()
    return held[token]


def text_batches(batch, column: str, rows: int = 256):
    """The texts of a record batch as Python strings, a few rows at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(values), rows):
        yield values.slice(at, rows).to_pylist()


def free_name(name: str, df: DataFrame) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
