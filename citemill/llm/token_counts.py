"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Each task turns its documents into (length, count) pairs, so what moves grows with the number of distinct lengths and not
with the corpus. The suffix sums run over the distinct lengths, in ranges of them that tasks share out.

Defined cases: null text is empty and has length 0; repeated rows count each time; an empty table gives an empty histogram
and no rows. Only the text (and the group column, if one is asked for) is read, so clashing names do no harm; a null group stays a group.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import materialized, table

#: Lengths are cut into ranges of this many for the running sums.
RANGE = 1024


def histogram(docs: DataFrame, text_col: str = "text", json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents encode to each number of tokens."""
    def count(batches):
        from citemill.llm.tokens import encode

        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen[len(encode(text.as_py(), json_path, rank_path))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For every distinct length taken as the context limit: (length, n_docs, docs_longer, docs_at_most, total_tokens_at_most,
    truncated_total, total_tokens, share): documents over the limit, documents and tokens within it, tokens left when every document is cut at it,
    all tokens, and the quantile that the limit is.
    """
    parts = hist.withColumn("part", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = parts.groupBy("part").agg(F.sum("n_docs").alias("pn"), F.sum("tokens").alias("pt"))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of lengths
    whole = Window.partitionBy()
    sums = sums.select("part", F.coalesce(F.sum("pn").over(later), F.lit(0)).alias("later_n"), F.coalesce(F.sum("pt").over(later), F.lit(0)).alias("later_t"), F.sum("pn").over(whole).alias("all_n"), F.sum("pt").over(whole).alias("all_t"))
    own = Window.partitionBy("part").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    d = parts.withColumn("n_above", F.coalesce(F.sum("n_docs").over(own), F.lit(0))).withColumn("t_above", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(sums, "part")
    longer, tokens_longer = F.col("later_n") + F.col("n_above"), F.col("later_t") + F.col("t_above")
    return d.select(
        "length", "n_docs", longer.alias("docs_longer"), (F.col("all_n") - longer).alias("docs_at_most"), (F.col("all_t") - tokens_longer).alias("total_tokens_at_most"),
        (F.col("all_t") - tokens_longer + longer * F.col("length")).alias("truncated_total"), F.col("all_t").alias("total_tokens"),
        ((F.col("all_n") - longer) / F.col("all_n")).alias("share"),
    )


def truncated_total(known: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at the limit, for any limit, from answers()."""
    below = known.where(F.col("length") <= limit).agg(F.max(F.struct("length", "docs_longer", "total_tokens_at_most")).alias("b"), F.count("*").alias("n"))
    whole = known.agg(F.max(F.col("docs_longer") + F.col("docs_at_most")).alias("all_n"))
    return below.crossJoin(F.broadcast(whole)).select(  # one row each
        F.when(F.col("n") == 0, F.coalesce(F.col("all_n"), F.lit(0)) * limit).otherwise(F.col("b.total_tokens_at_most") + F.col("b.docs_longer") * limit).alias("tokens"))


def quantile(known: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents doesn't exceed; null without documents."""
    return known.where(F.col("share") >= q).agg(F.min("length").alias("length"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(materialized(histogram(table(spark, sf_dir, "documents"))))
