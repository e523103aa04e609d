"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``, and columns beyond these pass through whatever
they are called.  In every stage an empty table gives no rows and a very long text is worked on whole, in pieces; what a
stage does with nulls, empty texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.batches import column, unused
from chatloom.llm.line_dedup import line_dedup
from chatloom.llm.minhash import without_near_duplicates
from chatloom.llm.mixing import mixed_documents
from chatloom.llm.prefix_bpe import encode_and_decode
from chatloom.llm.toxicity import clean_documents
from chatloom.session import ship, written_alone


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain's last category rejects go.

    Null and empty texts are judged by the models' intercepts; each row is judged by its text alone, so rows without an
    identifier are too, and repeated rows fare alike; a probability of exactly the threshold is a rejection.
    """
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    return clean_documents(docs, labels)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut; a document of which nothing is left goes.

    Null and empty texts and rows without an identifier stay as they are; of equal passages the one of the least
    identifier stays, within a document the first; rows that repeat an identifier and a text get the same cuts.
    """
    ship(spark)
    out = line_dedup(docs)
    left = (F.col(unused(docs.columns, "removed_lines")) == 0) | (F.trim("text", F.lit(" \n\r\t\x0b\x0c")) != "")
    return out.filter(left).select(*map(column, docs.columns)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least identifier; rows that repeat an identifier are one document.

    Null and empty texts are in no group.  Rows without an identifier go if their group has one; a group of only such rows
    stays whole, as none of them can be told from the others.
    """
    ship(spark)
    return without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source in its target share: a row per document and pass over it, with the words that the mix's slots take.

    Null, empty and blank texts have no words and go; a null source is a source; repeated rows are documents of their own.
    """
    ship(spark)
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their count and digest, and the digest of what they decode to.

    A null text is empty and has no ids; rows without an identifier and repeated rows have theirs like any other.
    """
    ship(spark)
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("prefix_bpe", tokens),
]

ORACLE_SQL = None
"""SQL can't express the trained classifier, the draws or the merges; tests/llm holds a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
