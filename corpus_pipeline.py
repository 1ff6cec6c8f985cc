"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any name. All but the last return the columns of what they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from byteloom.llm import exact, langid, mixing, packing, simhash
from byteloom.llm.common import drop_tables, table, tables_so_far


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that have no known language: null or empty texts, texts without letters or in scripts of which no document is labelled.

    Where no row has a label, all go. Repeated rows each stay or go; of languages that are equally likely any is known, so ties lose nothing; an empty table stays empty."""
    return langid.keep_known(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each text, byte by byte, that of the least id; of rows that repeat id and text one.

    Rows with a null text, and rows without an id, stay. Empty texts are one text; very long ones are compared whole. An empty table stays empty."""
    return exact.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the least id.

    Null texts, and those without words, are copies of nothing and stay, as do rows without an id. Of very long texts all words count. An empty table stays empty."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with rows of small sources repeated: a source of n documents has weight n ** 0.8, and the total is the least at which no source loses documents.

    A null source is one of its own; rows without an id occur once; rows that repeat an id within a source are as many times there as the id's copies. Texts don't matter. An empty table stays empty."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, pad_to, batch, slot) of every row. Null and empty texts have 0 tokens; a text longer than the budget is alone in its batch; equal rows each have a slot."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", dedup_exact), ("simhash_near_dedup", dedup_near), ("mixing", mix_sources), ("packing", pack)]

#: Language ID, SimHash and the rounding can't be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages make of the table of documents: the rows of ``pack``. Each stage's rows are written and read again, and deleted once the next one's are written, with all
    that the stage had written for itself; what the last stage reads stays until the session ends or ``drop_tables``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = tables_so_far(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
            drop_tables(spark, since, docs)
    return docs
