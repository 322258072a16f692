"""A training-corpus pipeline of four stages: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. Every stage works on all that its predecessor kept:

* ``quality``: documents that the base rules or the perplexity bands reject go;
* ``near_duplicates``: of each SimHash group the document with the least doc_id stays;
* ``secrets``: secret spans are replaced in the text; rows and other columns stay;
* ``packing``: the documents become pieces of packed sequences.

Null and empty texts have no words and go in the first stage; null languages are one language of their own, null sources one owner; rows without
a doc_id stay through all stages and are packed first; rows that repeat a doc_id are judged by their own texts in the first stage, and stay or
go together in the second. An empty table stays empty through all
stages. Extra columns come along up to the packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spinlattice.llm.common import new_path, table
from spinlattice.llm.packing import pack_documents
from spinlattice.llm.quality import keep_good
from spinlattice.llm.secrets import redact
from spinlattice.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Tokenizing, fingerprints and the language model are beyond SQL; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None
