"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Full pieces have a sequence to themselves. The others are packed by classes of length, longest first; a class reaches from its longest piece down to an eighth of it. In a round every gap (the room left in an open
sequence) offers as many places as it has room for pieces of the class, each as long as the longest piece left, the last one longer. Pieces and places are sorted by size and swept upwards: a piece waits for its
successor, the next larger place that no longer piece takes. Which one that is follows from ranks: a piece's level is how many wait when it joins them, a place's is how many wait
when it takes the last of them; on a level, each piece's successor is the row after it. Levels are running sums, from the numbers of pieces and places of each size (at most the capacity, on the driver) and the ranks
within a size (by many tasks), so the sweep is a window over levels, of two rows for each size at most, and conflicts can't occur. Gaps then shrink by what went in, and the next round starts from them. When nothing fits, as many
sequences are opened as the rest of the class needs at least.

Every round writes what it placed and the gaps that are left, so a lost executor costs a part of one round. On real lengths there are about a dozen rounds, whatever the number of rows, and within a sequence or two as
many sequences as row-by-row best fit makes.

``pack_in_order`` keeps the order of the documents, such as a source mix: best fit runs within each window of WINDOW_DOCS consecutive documents, and
sequences are numbered by window and, within it, by their first document. So the sequences up to the end of a window hold exactly the documents up to there.

Defined cases: null text is empty; an empty document is its end token alone. Very long texts are cut to pieces, whole. Repeated rows are packed each, ties in
length go by an arbitrary number of the row. An empty table gives no rows. Only id and text are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citemill.llm.common import materialized, table

CAPACITY = 1024
END_ID = 2
#: Rows of one size that a task ranks; more are dealt to several.
RANKED = 1_000
#: A class of lengths reaches down to this part of its longest; from SMALLEST tokens down there is one class.
CLASS, SMALLEST = 8, 64
#: Windows whose first sequence numbers one task adds up.
RANGES = 256
#: Documents that are packed together where their order counts.
WINDOW_DOCS = 1024


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of the capacity but the first, which may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, json_path: str | None = None, rank_path: str | None = None, with_ids: bool = False, place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids and the document's place from the column of that name."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["place"] * (place is not None)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids + [pa.int64()] * (place is not None)

    def tokenize(batches):
        import numpy as np

        from citemill.llm.tokens import encode

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, *at in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                ids = np.append(encode(text.as_py(), json_path, rank_path), np.uint32(end_id)).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + n]
                    rows.append((doc_id, i, start, n, zlib.crc32(own.tobytes())) + ((own.astype("int32").tolist(),) if with_ids else ()) + tuple(at))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", place long" * (place is not None)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(place)] if place else [])).mapInArrow(tokenize, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Row-by-row best fit of what one task holds, over runs of equal length: (length, first rank, end rank, first sequence, offset, documents for each sequence).

    counts: documents of each length. A run of c sequences with q documents of the length each takes c q ranks; rank r goes to sequence
    first + (r - first rank) div q, at offset + (r - first rank) mod q times the length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences [from, to)
    sizes: list[int] = []  # sorted
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def add(size: int, run: tuple[int, int]) -> None:
        if size > 0:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append(run)

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                lo, hi = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            else:
                size, lo = capacity, opened
                hi = opened = opened + -(-(end - rank) // (capacity // length))
            fit = size // length
            full = min(hi - lo, (end - rank) // fit)
            if full:
                plan.append((length, rank, rank + full * fit, lo, capacity - size, fit))
                add(size - fit * length, (lo, lo + full))
                rank += full * fit
                lo += full
            if lo < hi and rank < end:  # fewer documents than one more sequence takes
                plan.append((length, rank, end, lo, capacity - size, end - rank))
                add(size - (end - rank) * length, (lo, lo + 1))
                rank = end
                lo += 1
            if lo < hi:
                add(size, (lo, hi))
    return plan


def ranked(rows: DataFrame, size: str, row: str, counts: dict[int, int]) -> DataFrame:
    """Adds rank, the place of each row among those of its size in the order of hash ranges and then of the row's number; a size that many rows have is ranked by many tasks. counts: rows of each size."""
    ranges = F.broadcast(rows.sparkSession.createDataFrame([(s, -(-n // RANKED)) for s, n in counts.items()], "_size long, _ranges long"))  # capacity rows at most
    d = rows.join(ranges, F.col(size) == F.col("_size")).withColumn("_range", F.pmod(F.xxhash64(row), F.col("_ranges"))).drop("_size", "_ranges")
    before = Window.partitionBy(size).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = d.groupBy(size, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(size, "_range").orderBy(row)
    return d.withColumn("_i", F.row_number().over(own) - 1).join(offsets, [size, "_range"]).withColumn("rank", F.col("_before") + F.col("_i")).drop("_range", "_before", "_i")


def waiting(pieces_of: dict[int, int], places_of: dict[int, int]) -> list[tuple[int, int, int]]:
    """(size, pieces that wait before those of the size come, pieces that wait before places of the size take any), given how many there are of each size; at most the capacity rows."""
    out, now = [], 0
    for size in sorted({*pieces_of, *places_of}):
        out.append((size, now, now + pieces_of.get(size, 0)))
        now = max(0, out[-1][2] - places_of.get(size, 0))
    return out


def matched(some: DataFrame, places: DataFrame, left: dict[int, int], places_of: dict[int, int]) -> DataFrame:
    """(pid, length, seq): pieces (pid, length, rank) with the places (seq, size, rank) that they take, the longest piece first and each the smallest place that is free."""
    told = F.broadcast(some.sparkSession.createDataFrame([(s, p, q, left.get(s, 0)) for s, p, q in waiting(left, places_of)], "_size long, _pieces long, _places long, _left long"))  # capacity rows at most
    waits = some.join(told, F.col("length") == F.col("_size")).where(F.col("rank") < F.col("_left"))
    waits = waits.select((F.col("_pieces") + F.col("rank") + 1).alias("level"), F.col("length").alias("size"), F.lit(0).alias("kind"), "pid", F.lit(None).cast("long").alias("seq"))
    takes = places.join(told, F.col("size") == F.col("_size")).select((F.col("_places") - F.col("rank")).alias("level"), "size", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pid"), "seq").where("level > 0")
    sweep = Window.partitionBy("level").orderBy("size", "kind")
    d = waits.unionByName(takes).withColumn("seq", F.lead("seq").over(sweep))
    return d.where("kind = 0 AND seq IS NOT NULL").select("pid", F.col("size").alias("length"), "seq")


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to the capacity. Full ones have negative sequence numbers."""
    spark, names = parts.sparkSession, parts.columns
    parts = materialized(parts.withColumn("pid", F.monotonically_increasing_id()))
    some = parts.where(F.col("length") < capacity).select("pid", "length")
    left = {r["length"]: r["n"] for r in some.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    some = materialized(ranked(some, "length", "pid", left)) if left else some
    done: list[DataFrame] = []
    gaps, opened, longest = spark.createDataFrame([], "seq long, gap long"), 0, max(left, default=0)
    while left:
        least = min(n for n in left if n > (longest // CLASS if longest > SMALLEST else 0))
        own = {n: count for n, count in left.items() if n >= least}  # of this class; of a size, those of the lowest ranks are left
        top = max(own)
        room = F.greatest(F.lit(1), F.floor(F.col("gap") / top))
        places = gaps.where(F.col("gap") >= least).select("seq", "gap", room.alias("_m"), F.explode(F.sequence(F.lit(0), room - 1)).alias("j"))
        places = places.select("seq", (F.col("seq") * capacity + F.col("j")).alias("place"), F.when(F.col("j") < F.col("_m") - 1, top).otherwise(F.col("gap") - top * (F.col("_m") - 1)).alias("size"))
        places_of = {r["size"]: r["n"] for r in places.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
        if max(places_of, default=0) < least:
            need = -(-sum(n * count for n, count in own.items()) // capacity)
            gaps = materialized(gaps.union(spark.range(opened, opened + need).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))))
            opened += need
            continue
        new = matched(some.where(F.col("length").between(least, top)), ranked(places, "size", "place", places_of), own, places_of).join(gaps, "seq")
        so_far = Window.partitionBy("seq").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # capacity rows at most
        new = materialized(new.select("pid", "length", "seq", (capacity - F.col("gap") + F.coalesce(F.sum("length").over(so_far), F.lit(0))).alias("offset")))
        done.append(new)
        used = new.groupBy("seq").agg(F.sum("length").alias("used"))
        gaps = materialized(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
        for r in new.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
            left[r["length"]] -= r["n"]
        left = {n: count for n, count in left.items() if count}
        if max(left, default=0) < least:
            longest = max(left, default=0)
    found = [parts.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    found += [d.select("pid", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset")) for d in done]
    return parts.join(reduce(DataFrame.union, found), "pid").select(*names, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, json_path: str | None = None, rank_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return placed(pieces(docs, capacity, end_id, json_path, rank_path, with_ids), capacity)


def with_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): the place of each row in the order of the files, by part number, and of their rows. What isn't read from files is written first, in its order."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    try:
        d = docs.select("doc_id", "text", docs.metadataColumn("_metadata").alias("m"))
        d = d.select("doc_id", "text", F.col("m.file_path").alias("file"), F.col("m.row_index").alias("row"))
    except AnalysisException:
        return with_places(materialized(own))

    def order(path: str) -> tuple:
        folder, _, name = path.rpartition("/")
        part = re.match(r"part-(\d+)", name)
        return folder, int(part[1]) if part else -1, name

    files = {r["file"]: r["n"] for r in d.groupBy("file").agg((F.max("row") + 1).alias("n")).collect()}  # a row for each file
    names = sorted(files, key=order)
    before = list(zip(names, accumulate((files[x] for x in names), initial=0)))
    told = F.broadcast(docs.sparkSession.createDataFrame(before, "_file string, _before long"))
    return d.join(told, F.col("file") == F.col("_file")).select("doc_id", "text", (F.col("_before") + F.col("row")).alias("place"))


def pack_window(part: pa.Table, capacity: int = CAPACITY) -> pa.Table:
    """Adds sequence and offset to the pieces of one window; sequences are numbered by their first piece in order."""
    place, piece, length = (part.column(c).to_pylist() for c in ("place", "piece", "length"))
    rows = sorted(range(len(place)), key=lambda i: (place[i], piece[i]))
    of_length: dict[int, list[int]] = {}
    for i in rows:
        of_length.setdefault(length[i], []).append(i)
    sequence, offset = [0] * len(rows), [0] * len(rows)
    for n, first, end, seq, at, fit in best_fit({n: len(x) for n, x in of_length.items()}, capacity):
        for r in range(first, end):
            i = of_length[n][r]
            sequence[i], offset[i] = seq + (r - first) // fit, at + (r - first) % fit * n
    number: dict[int, int] = {}
    for i in rows:
        number.setdefault(sequence[i], len(number))
    return part.append_column("sequence", pa.array([number[x] for x in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, json_path: str | None = None, rank_path: str | None = None, window_docs: int | None = None) -> DataFrame:
    """One row for each piece, as from pack, of documents whose order counts: as read from Parquet files, without steps in between that change it."""
    parts = pieces(with_places(docs), capacity, end_id, json_path, rank_path, place="place").withColumn("window", F.floor(F.col("place") / (window_docs or WINDOW_DOCS)))
    schema = StructType([*parts.schema, StructField("sequence", LongType()), StructField("offset", LongType())])
    d = materialized(parts.groupBy("window").applyInArrow(lambda part: pack_window(part, capacity), schema))
    # sequences of the windows before, in two steps, so that no task has to read a row for each window
    sizes = d.groupBy("window").agg((F.max("sequence") + 1).alias("n")).withColumn("span", F.floor(F.col("window") / RANGES))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("n").over(earlier.orderBy("span")), F.lit(0)).alias("base"))
    sizes = sizes.select("window", "span", F.coalesce(F.sum("n").over(earlier.partitionBy("span").orderBy("window")), F.lit(0)).alias("own"))
    first = sizes.join(spans, "span").select("window", (F.col("base") + F.col("own")).alias("first"))
    return d.join(first, "window").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
