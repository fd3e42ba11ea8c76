"""Bottom-k sketches of five-word shingles, in DataFrame expressions only.

The sketch of a text is the k smallest distinct hashes of its shingles, sorted. Sketches merge (the k smallest of two
sketches' union are the sketch of both texts' shingles), and answer: resemblance, the share of the merged sketch that
both have; containment; and the number of distinct shingles, from the k-th smallest hash. With k or fewer distinct
shingles all answers are exact.

Defined cases: null text is the empty text, whose sketch is empty; fewer than five words are one shingle. Two empty
sketches have likeness 1, an empty and another one 0. The next document is the one with the next larger distinct doc_id, the last
one's is the first; of rows that repeat an id the smallest text counts as that id's; a hot id's rows, null included, are spread over many tasks. A very long text is one row's array of words and hashes, in the JVM. Each input row gives one row. A null doc_id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import dealt, materialized, table, words

K = 128
SHINGLE = 5
#: Hashes have this many bits; as text each takes a quarter as many hexadecimal digits.
BITS = 48
#: Ranges of doc_id for each shuffle partition, so that their sizes even out.
RANGES_A_TASK = 8


def with_sketch(df: DataFrame, text_col: str, to: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Adds the sketch of a text column. The words are a column of their own: inside the lambda they'd be split anew for each shingle."""
    w = f"{to}_words"
    df = df.withColumn(w, words(F.col(text_col)))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + j) for j in range(n))), 64 - BITS))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 64 - BITS))
    hashes = F.when(F.size(w) >= n, windows).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(to, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(w)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity."""
    both = F.array_intersect(merged(a, b, k), F.array_intersect(a, b))
    size = F.size(F.array_union(a, b))
    return F.when(size == 0, 1.0).otherwise(F.size(both) / F.least(size, F.lit(k)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: k - 1 over the k-th smallest hash as a share of the range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / F.greatest(F.element_at(a, -1), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(a: Column) -> Column:
    """Equal for equal sketches: 12 digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def merge_all(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of keys. Only the k smallest hashes of a group count, so the hashes are ranked within salted parts first."""
    parts = rows.select(*keys, F.explode(sketch_col).alias("h")).distinct().withColumn("_part", F.pmod(F.xxhash64("h"), F.lit(64)))
    least = Window.partitionBy(*keys, "_part").orderBy("h")
    top = parts.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch_col))


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) of each row. Where rows repeat an id, one text for each id goes through following(), and the rows get their next document from a join in which large groups are dealt to many tasks."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = d.groupBy("doc_id").agg(F.count("*").alias("size"))
    again = materialized(sizes.where("size > 1"))
    if again.isEmpty():
        return following(d, k)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # null is an id, too
    found = following(d.groupBy("doc_id").agg(F.min("text").alias("text")), k).select(key.alias("_id"), "next_text", "next_sketch")
    found = found.join(again.select(key.alias("_id"), "size"), "_id", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    rows = dealt(d.withColumn("_id", key), materialized(found), "_id", "text")
    return with_sketch(rows, "text", "sketch", k).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def following(d: DataFrame, k: int = K) -> DataFrame:
    """The same for rows (doc_id, text) of distinct ids and texts that aren't null. Documents are dealt out by ranges of doc_id, so each text moves once and is sketched once, where it arrives; the first document of each range also goes to the end of the range before it, that of the first range to the end of the last."""
    spark = d.sparkSession
    n = RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()["cuts"] or []  # n numbers
    bounds = F.lit(sorted(set(cuts))).cast("array<bigint>")
    d = d.withColumn("part", F.greatest(F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0)), F.lit(0)))
    firsts = d.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))  # a row for each range
    order = Window.orderBy("part")  # as many rows, of two numbers, as there are ranges
    to = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = F.broadcast(firsts.select(F.when(F.col("nulls") == 0, F.col("doc_id")).alias("first_id"), to.alias("to")))
    ends = d.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("end"))
    d = with_sketch(d.withColumn("end", F.lit(False)).unionByName(ends).repartition("part"), "text", "sketch", k)
    d = d.withColumn("next", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("part").orderBy("end", "doc_id"))).where(~F.col("end"))
    return d.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the text's code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents")).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    d = with_sketch(d, "edit", "edit_sketch")
    a, b, c = F.col("sketch"), F.col("edit_sketch"), F.col("next_sketch")
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"), distinct_count(a).alias("n_distinct"),
    )
