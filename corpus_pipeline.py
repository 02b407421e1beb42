"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All stages but the last return whole rows of documents.  An empty
table goes through all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, minhash_dedup, packing, source_mixing, toxicity
from tessella.llm.store import is_scan, persist

#: Successive parts of the mixture whose sequences are packed by themselves.
STRETCHES = 16
#: Code points of a source that the mixture places together.
BLOCK = source_mixing.BLOCK


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; null and empty texts and repeated rows are judged too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, labels)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; null and empty texts are one text, repeated rows one row."""
    return exact_dedup.dedup_documents(spark, docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words are in no group."""
    return minhash_dedup.dedup_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow one another in the order in which sources are mixed to their
    target weights; null sources are a source.

    The number of files is asked for, so that it does not depend on what adaptive execution makes of
    small tables: the next stage finds its stretches in them.
    """
    files = max(STRETCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return source_mixing.mixed_documents(docs, partitions=files, block=BLOCK)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences, numbered in the order of the mixture.

    The files of ``docs`` follow one another as the mixture does; each sixteenth of them is packed by
    itself, so every sixteenth of the sequences has the target weights.  What is not a table of files
    is written first, in the order of its partitions.  Null texts are empty ones.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs if is_scan(docs) else persist(docs, "mixed")
    number = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.lit(0))
    files = (docs.agg(F.max(number)).first()[0] or 0) + 1
    return packing.pack(docs, path, stretch=F.floor(number * STRETCHES / files))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("minhash_dedup", dissimilar), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: Scores, signatures and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
