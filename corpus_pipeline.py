"""The corpus pipeline: toxic documents go, exact and near copies go, sources are mixed, documents are packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again before the next. All but the last
return the columns of ``documents``; after mixing, a document is there as often as the mix takes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import exact, minhash, mixing, packing, toxicity
from tabweave.llm.shared import read, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
#: Models and signatures have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
