"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, linededup, minmax, mixing, quality
from lodestrata.llm.queries import VOCABULARY
from lodestrata.llm.shared import materialize, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep, with their columns, whatever their names.

    Null and empty texts fail the base rules and go; repeated rows are judged alike; an empty table gives an empty one.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.fit(docs, labels), only_kept=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, without lines that a document of larger id holds too; n_chars follows the text.

    Null texts become empty; rows with a null id keep all lines; rows that share an id are one document; an empty table
    gives an empty one. Other columns, such as an own n_lines, stay as they are.
    """
    ship(spark)
    kept = linededup.dedup_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return kept
    at, text = docs.columns.index("n_chars"), docs.columns.index("text")
    named = kept.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    length = F.length(f"c{text}").cast(docs.schema["n_chars"].dataType)
    return named.withColumn(f"c{at}", length).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, with its columns.

    Texts without words link with nothing and stay, as do rows with a null id; rows that repeat an id all stay or all
    go; an empty table gives an empty one.
    """
    ship(spark)
    return minmax.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its columns, as often as the mix takes it.

    Texts without words take no part; a null source is a source; repeated rows are taken on their own; an empty table
    gives an empty one.
    """
    ship(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of the decoded bytes; a null or empty text has no tokens."""
    ship(spark)
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN, space_led=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("byte bpe", encode),
]

#: Boosted trees, hash-keyed sampling and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
