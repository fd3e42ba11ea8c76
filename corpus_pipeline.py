"""The corpus pipeline over documents: language, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents. Between stages the rows are written as Parquet to the shared folder.

Defined cases, for all stages: an empty table gives an empty result; rows that are repeated are judged each, and none of them twice; very long texts are read whole; columns besides doc_id, text, lang and source, whatever
their names, pass through untouched, nulls included. A null or empty text, or one without a letter, is rejected by the language stage. A null doc_id is never held out, is a duplicate of nothing and stays; a null lang isn't
learned from; a null source is a source of its own. Ties are settled as each stage says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from citemill.llm import language_id, mixing, near_dedup, packing, toxicity
from citemill.llm.common import materialized, table

#: No SQL can state a trained network, a sketch or a byte-pair encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network is sure enough of; all lettered ones where no language is known to learn from. Between equally probable languages the first by name counts, which changes nothing here."""
    return language_id.accepted(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labels, doesn't find toxic; all of them where either label is missing. A score of exactly the threshold is toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, and of rows that repeat it that of the smallest text. Texts without a word are duplicates of nothing."""
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order that interleaves sources by target weight; documents of one source come by hash, then by doc_id."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequences that they are packed into, which follow the order that the documents were written in: that of the mix. An empty text is its end token."""
    return packing.pack_in_order(docs)


STAGES = [("language", by_language), ("toxicity", not_toxic), ("near_dedup", one_of_each), ("mix", mixed), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reduce(lambda d, stage: materialized(stage[1](spark, d, sf_dir)), STAGES[:-1], table(spark, sf_dir, "documents"))
    return STAGES[-1][1](spark, docs, sf_dir)
