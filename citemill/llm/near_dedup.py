"""Near-duplicate detection: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct five-word shingles. Its sketch has T coordinates: in round i every shingle is hashed to one
of the coordinates and to a value, and a coordinate keeps the smallest (round, value) that reached it; rounds go on until every coordinate has
one. From round T on a shingle goes to coordinate i - T only, so 2 T rounds fill all of them whatever the set's size. The
share of equal coordinates of two sketches estimates the Jaccard similarity with the concentration of T independent draws.

Bands of ROWS coordinates make the buckets; at a similarity of 0.75 a pair shares none of them with probability (1 - 0.75 ** ROWS) ** BANDS, 5e-6.
Equal sets are one class and take part once. Within a bucket no pairs are made of all members. The bucket's hub is its member with the most company over
all buckets; every member is held against the hub, on full shingle sets, and those that are similar enough are linked. What is left are members x, y of one hub h, in different
components, of which one at least isn't similar enough to h. Either they share a shingle that h lacks; then the first shingle that both have, in the order of those that h lacks, by how
many members have them, before those that h has, is such a one, and is early in both (prefix filtering), so they meet in a join on it. Or they don't; then they have at most min(|x ∩ h|, |y ∩ h|) shingles in
common, which is seldom enough. All pairs that pass are verified on full sets, so no link between members of a bucket is missed. Components come from
contracting links in rounds, in hashed order, so long chains take few rounds.

Defined cases: null or blank texts have an empty set, link with nothing and are components of their own; fewer than five words are one
shingle, the whole sequence. Rows that repeat a doc_id are one document with all their links: classes of equal sets are what is compared, each by the text of one of
its rows, and classes with a doc_id in common are linked. A row with a null doc_id links with nothing, has a null
component and is kept. An empty table gives no rows. Very long texts are hashed in chunks, whole; ties (equal texts) are one class. Only id and text are read, so clashing names do no harm.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm import url_filters
from citemill.llm.common import GROUP, dealt, materialized, table

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
T, ROWS, BANDS = 128, 4, 32

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte (A-Z as a-z), which bytes are blanks, and powers of an odd number and of its inverse."""
    with np.errstate(over="ignore"):
        numbers = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
        numbers[65:91] = numbers[97:123]
        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        odd = 0x9E3779B97F4A7C15
        inverse = pow(odd, -1, 1 << 64)
        up = np.cumprod(np.full(_CHUNK + 1, odd, np.uint64)) * np.uint64(inverse)
        down = np.cumprod(np.full(_CHUNK + 1, inverse, np.uint64)) * np.uint64(odd)
    return numbers, blank, up, down


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Long texts are taken in chunks that end at a blank; a longer word is hashed in pieces of a chunk."""
    numbers, blank, up, down = _tables()
    out, at, carry = [], 0, None
    while at < len(data):
        arr = np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - at), at)
        gap = blank[arr]
        if at + len(arr) < len(data) and not blank[data[at + len(arr)]]:
            stops = np.flatnonzero(gap)
            if len(stops):
                arr, gap = arr[: stops[-1] + 1], gap[: stops[-1] + 1]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[arr] * up[: len(arr)])])
            edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            if carry is not None and len(hashes) and starts[0] == 0:  # the rest of a word that is longer than a chunk
                hashes[0] = mix64(np.array([carry], np.uint64) * _GOLD + hashes[:1])[0]
                out[-1] = out[-1][:-1]
            elif carry is not None:
                carry = None
        out.append(hashes)
        at += len(arr)
        carry = hashes[-1] if len(hashes) and ends[-1] == len(arr) and at < len(data) and not blank[data[at]] else None
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        n = min(SHINGLE, len(h))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            acc = mix64(acc * _GOLD + h[j : len(h) - n + 1 + j])
    return np.unique(acc)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty: the round in the bits from 48 on, the value below."""
    full = np.iinfo(np.uint64).max
    out = np.full(T, full, np.uint64)
    step = max(1, min(T, 1024 // len(shingles)))
    with np.errstate(over="ignore"):
        for first in range(0, T, step):
            rounds = np.arange(first, min(T, first + step), dtype=np.uint64)[:, None]
            h = mix64(shingles[None, :] ^ mix64((rounds + np.uint64(1)) * _GOLD))
            np.minimum.at(out, (h >> np.uint64(57)).astype(np.intp).ravel(), ((rounds << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))).ravel())
            if not (out == full).any():
                return out
        for i in np.flatnonzero(out == full):
            h = mix64(shingles ^ mix64(np.uint64(T + i + 1) * _GOLD))
            out[i] = np.uint64(T + i) << np.uint64(48) | (h & np.uint64((1 << 48) - 1)).min()
    return out


def _describe(text: str | None) -> tuple[int, bytes | None, list | None]:
    """(set size, class of equal sets, band keys)."""
    import xxhash

    s = shingle_set(text)
    if not len(s):
        return 0, None, None
    k = sketch(s)
    with np.errstate(over="ignore"):
        mixed = mix64(k)
        acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
        for j in range(ROWS):
            acc = mix64(acc * _GOLD + mixed.reshape(BANDS, ROWS)[:, j])
    return len(s), xxhash.xxh3_128_digest(s.tobytes()), acc.view(np.int64).tolist()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, bands) of each row; text_key tells the texts of one doc_id apart."""
    names, kinds = ["doc_id", "text_key", "n_shingles", "cls", "bands"], [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def one(batches):
        for batch in batches:
            found = [_describe(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(one, "doc_id long, text_key long, n_shingles long, cls binary, bands array<long>")


def held_against(pairs: DataFrame, classes: DataFrame, docs: DataFrame, with_lacking: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, both, lacking) for pairs (a, b) of nodes: sizes of the full sets and of their intersection, and, if asked for, the shingles of a that b lacks.

    classes has the row (doc_id, text_key) whose text stands for a node. A node that is in many pairs is a hot key of the second join: its pairs are dealt to as many salts as they are thousands, and its text is copied to each.
    """
    ids = materialized(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node").select("node", "doc_id", "text_key"))
    n_blocks = url_filters.blocks_for(ids.count())
    once = Window.partitionBy("node").orderBy(F.col("text"))
    rows = docs.select("doc_id", "text")
    if n_blocks <= url_filters.MAX_BROADCAST_BLOCKS:  # most documents are in no pair; a filter of a checked size keeps their texts out of the shuffle
        rows = url_filters.possible_hits(rows, "doc_id", url_filters.bloom(ids, "doc_id", n_blocks), n_blocks)
    rows = rows.withColumn("text_key", F.xxhash64("text")).join(ids, ["doc_id", "text_key"]).select("node", "text")
    texts = materialized(rows.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r"))
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).select("a", "b", "salt")
    right = texts.join(salts.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("b_text"))
    joined = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(right, ["b", "salt"])
    names, kinds = ["n_a", "n_b", "both", "lacking"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def compare(batches):
        last: tuple = (None, None)
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1), batch.column(3), strict=True):
                b_text = b.as_py()
                if last[0] != b_text:
                    last = (b_text, shingle_set(b_text))
                s, t = shingle_set(a.as_py()), last[1]
                lacking = s[~np.isin(s, t, assume_unique=True)]
                rows.append((len(s), len(t), len(s) - len(lacking), lacking.view(np.int64).tolist() if with_lacking else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["a", "b", *names])

    return joined.select("a", "a_text", "b", "b_text").mapInArrow(compare, "a long, b long, n_a long, n_b long, both long, lacking array<long>")


def _linked(both: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * both >= PERCENT * (n_a + n_b - both)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is its smallest reachable node.

    Every round each node points to the neighbour that comes first in hashed order, itself included, and links are
    redrawn between the nodes pointed to, until none is left. Pointers are then followed back from the last round to the first.
    """
    links = materialized(links.where("a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "to")
        first = F.min(F.struct(F.xxhash64("to").alias("h"), F.col("to").alias("id")))
        to = both.union(both.select("node", "node").distinct()).groupBy("node").agg(first.alias("m")).select("node", F.col("m.id").alias("to"))
        to = materialized(to)
        rounds.append(to)
        links = links.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        links = materialized(links)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = rounds[-1]
    for to in reversed(rounds[:-1]):  # to's targets are the nodes of later rounds, or have none left
        roots = to.join(roots.toDF("_n", "_root"), F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_root", "to").alias("to"))
    roots = materialized(roots)
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return materialized(roots.join(least, "to").select("node", "component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = materialized(described(docs))
    full = d.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class's node is a number of its own, as one doc_id can be the smallest of many classes
    classes = full.groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    classes = materialized(classes.select("cls", "r.doc_id", "r.text_key", F.monotonically_increasing_id().alias("node")))
    # rows that repeat a doc_id with different texts are one document: their classes link through it
    again = full.groupBy("doc_id").agg(F.count_distinct("cls").alias("n")).where("n > 1")
    members = full.join(again, "doc_id", "left_semi").select("doc_id", "cls").distinct().join(classes.select("cls", "node"), "cls")
    own_links = members.join(members.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    reps = full.join(classes, ["cls", "doc_id", "text_key"]).dropDuplicates(["cls"]).select("node", F.explode("bands").alias("key"))
    shared = reps.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialized(reps.join(shared, "key"))
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = buckets.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    stars = buckets.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    star = materialized(held_against(materialized(stars), classes, docs, with_lacking=True))
    links = star.where(_linked(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b").union(own_links)
    found = components(links)

    # members of one hub that aren't linked yet; hubs of one component are done
    rows = materialized(star.join(found.toDF("a", "c"), "a", "left").withColumn("c", F.coalesce("c", "a")).select("b", "a", "c", "n_a", "n_b", "both", "lacking"))
    open_hubs = rows.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n_a").alias("least"), F.count("*").alias("size")).where("lo <> hi").select("b", "least", "size")
    rows = materialized(dealt(rows, materialized(open_hubs), "b", "a"))
    tokens = rows.select("b", "a", "c", "n_a", F.explode("lacking").alias("token"))
    common = tokens.groupBy("b", "token").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("df > 1")
    common = common.select("b", "token", "df", (F.col("lo") != F.col("hi")).alias("between"))
    order = Window.partitionBy("b", "a").orderBy("df", "token")  # a document's shingles
    tokens = tokens.join(common, ["b", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("pos", F.row_number().over(order) - 1)
    # a shingle that members of one component alone have can't link two
    tokens = materialized(tokens.where(F.col("between") & (F.col("pos") <= F.col("n_a") - F.ceil(PERCENT * F.col("n_a") / 100))).select("b", "a", "c", "n_a", "pos", "token"))
    x, y = tokens.toDF("b", "x", "x_c", "x_n", "x_pos", "token"), tokens.toDF("b2", "y", "y_c", "y_n", "y_pos", "token2")
    # both have this shingle and at most what comes after it in both
    room = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    early = x.join(y, (F.col("b") == F.col("b2")) & (F.col("token") == F.col("token2")) & (F.col("x") < F.col("y")) & (F.col("x_c") != F.col("y_c")) & _linked(room, F.col("x_n"), F.col("y_n"))).select("x", "y")
    # x can be linked, by shingles of the hub alone, to y of at most so many shingles
    most = F.floor((100 + PERCENT) * F.col("both") / PERCENT) - F.col("n_a")
    bounded = materialized(rows.select("b", "a", "c", "n_a", most.alias("most"), "least").where("most >= least").drop("least"))
    left = materialized(bounded.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("b", "size"))
    salts = left.select("b", F.ceil(F.col("size") / GROUP).cast("int").alias("salts"))
    x = dealt(bounded, left, "b", "a").select("b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / GROUP)).cast("int").alias("salt"), F.col("a").alias("x"), F.col("c").alias("x_c"), F.col("n_a").alias("x_n"), F.col("most").alias("x_most"))
    y = bounded.join(salts, "b").select(F.col("b").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt2"), F.col("a").alias("y"), F.col("c").alias("y_c"), F.col("n_a").alias("y_n"), F.col("most").alias("y_most"))
    by_hub = x.join(y, (F.col("b") == F.col("b2")) & (F.col("salt") == F.col("salt2")) & (F.col("x") < F.col("y")) & (F.col("x_c") != F.col("y_c")) & (F.col("y_n") <= F.col("x_most")) & (F.col("x_n") <= F.col("y_most"))).select("x", "y")
    cross = materialized(early.union(by_hub).distinct().toDF("a", "b"))
    more = held_against(cross, classes, docs)
    found = components(links.union(more.where(_linked(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")))

    named = classes.select("cls", "node", F.col("doc_id").alias("least")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialized(named)
    least = materialized(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    named = dealt(named, least, "component", "node").select("cls", F.col("component_id").alias("found"))
    out = d.join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each component, one row of each document, with the columns that came in."""
    spark, names = docs.sparkSession, docs.columns
    kept = materialized(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    once = Window.partitionBy("doc_id").orderBy("text")
    place = "_row"
    while place in names:
        place += "_"
    rows = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return rows.select(names).union(docs.where(F.col("doc_id").isNull()).select(names))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
