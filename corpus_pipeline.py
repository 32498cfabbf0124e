"""From raw documents to packed sequences: five stages, each one operator of `tipoff.llm`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.common import shared_folder, table
from tipoff.llm.decontamination import decontaminated
from tipoff.llm.line_dedup import without_repeated_lines
from tipoff.llm.packing import pack
from tipoff.llm.quality import fit_quality, good_documents
from tipoff.llm.simhash_dedup import one_of_each_group

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of a class of like lines is kept once; `n_chars` follows the text."""
    return without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of texts linked by SimHash or a five-word Jaccard index of 0.8 or more."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more benchmark text than the contamination rule allows."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    files = [str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    return pack(docs, files[0], ranks_path=files[1])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Trained trees, MinHash, XXH64 votes and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each result is a table in the shared folder that the next one reads."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
