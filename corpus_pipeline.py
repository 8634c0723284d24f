"""A corpus cleaning pipeline of five of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
every result as Parquet to the shared folder and rereads it as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from kinrank.llm.queries import _tokenizer
from kinrank.llm.shared import held_out, table, written

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC go; the fit leaves the same labels out as op7.

    Null, empty and very long texts are scored like any other; an empty table gives an empty one."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, toxicity.sample(
        table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", held_out(3))), TOXIC)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from every text; one that holds nothing else is a copy of a whole document and keeps its
    text, so that near-duplicate removal can leave one of its kind.  Every document stays.

    Null texts stay null; an empty table gives an empty one; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs, keep_whole=True)
    removed = line_dedup.added(docs)[2]
    return cleaned.select(*[F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(c)).alias(c)
                            if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays (one row of it).

    Texts without words (null, empty) are one group; an empty table gives an empty one."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.  Null and empty texts hold none and stay; whole texts are
    scanned, however long; an empty table gives an empty one."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of the decoded text.  A null text is empty and has no ids;
    repeated rows are encoded alike; an empty table gives an empty one."""
    encoded = bpe.encode(docs, _tokenizer("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None        # fitted scores, SimHash components and BPE are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
